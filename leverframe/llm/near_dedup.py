"""Near-duplicates by BagMinHash signatures over multisets of five-word shingles.

1. Copies of one text are collapsed by digest, so a group of copies counts as one text.
2. A text is the multiset of its shingles. Every shingle drives Poisson processes over its weight axis, discretised at
   the whole numbers and split into dyadic blocks (0,1], (1,2], (2,4], (4,8]...; a block's process has points at rate
   (components x block length), each with a component and a level; points above the shingle's own count don't count for
   it. A component of the signature is the earliest point it gets, so two texts agree in it with a probability that is
   their weighted Jaccard similarity. Points come in order of time, so a process stops once it is past the latest
   component: about (shingles + components x log components) draws for each text.
3. Signatures are banded. Each text in a bucket meets the bucket's hub (its least digest): one pair for each text, never
   all pairs. While a bucket has more than ``HUB_FROM`` texts outside its largest component, another of these becomes its
   hub, up to ``HUBS`` times and as long as that joins a fifth of them. Where a bucket then still holds several components, blocks of the texts outside its largest
   one meet blocks of all of them in one task each: as signatures first, and with those texts that agree with another.
   Two texts are compared if their signatures agree in at least 76 of 128 components, which a pair of similarity 0.8
   misses with a probability of 3e-8; nothing is left out by a cap.
4. Pairs are compared on the whole texts: weighted Jaccard of the shingle multisets, at least the threshold for a link.
   In a block, pairs go in order of their agreement, and not if links found before join them; only links leave the task.
5. Classes are the connected components; the largest doc_id of each stays.

With 16 bands of 4 a pair of similarity 0.8 shares a bucket with probability 0.9998.

Results for odd input: null counts as empty; texts without words are only grouped with equal texts; texts of one to
four words have one shingle, all their words; very long texts are sketched and compared whole; repeated rows form a
class; rows that repeat an id over different texts are told apart by their texts, and ``dedup`` keeps one row of each
class, of rows with the kept id that with the greatest digest; empty tables give empty results. ``classes`` has columns
of its own only; ``dedup`` keeps the columns of ``docs`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverframe.llm.common import brought_back, cut, drop, join_grouped, keep_decided, partitions, set_aside, small_batches

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 4
#: Components of a signature; the first BANDS x ROWS are banded. Texts of similarity 0.8 agree in fewer than AGREE of
#: them with a probability of 3e-8.
COMPONENTS, AGREE = 128, 76
#: Texts of a bucket on either side of a comparison in step 3, most further hubs of a bucket, and pairs that one copy of a hub's text meets.
BLOCK, HUBS, COPIES = 192, 8, 500
#: From how many texts apart on a bucket gets further hubs before it is compared in blocks.
HUB_FROM = 4096

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
_BYTES = np.zeros(256, bool)
_BYTES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of all texts, and where each text's words begin (one more entry than texts)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = np.flatnonzero(~_BYTES[buf])
    if not len(inside):
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    lengths = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, 0x100000001B3, U), dtype=U)
    letters = mix(np.arange(1, 257, dtype=U) * GOLDEN)
    hashes = mix(np.add.reduceat(letters[buf[inside]] * powers[place], first) + lengths.astype(U))
    return hashes, np.concatenate([[0], np.searchsorted(inside[first], ends)])


def shingles(texts: list[str], k: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingle hashes, sorted, and their counts."""
    words, at = word_hashes(texts)
    odd = [mix(np.array([i + 1], U) * GOLDEN)[0] | U(1) for i in range(k)]
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, U)
    for i in range(k):
        rolled += words[i : i + n] * odd[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1], return_counts=True))
        elif b > a:
            short = mix(np.array([(words[a:b] * np.array(odd[: b - a], U)).sum() + U(b - a)], U))
            out.append((short, np.ones(1, np.int64)))
        else:
            out.append((np.empty(0, U), np.empty(0, np.int64)))
    return out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash signatures, one row of ``m`` (a power of two) times for each bag; inf throughout for an empty bag."""
    sig = np.full((len(bags), m), np.inf)
    if not sum(len(h) for h, _ in bags):
        return sig
    owner = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    key, weight = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags])
    blocks = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    owner, key, weight = (np.repeat(x, blocks) for x in (owner, key, weight))
    size = np.where(block > 0, 1 << np.maximum(block - 1, 0), 1)
    low = np.where(block > 0, size, 0)
    seed = mix(key + block.astype(U) * U(0xD1B54A32D192ED03))
    time = np.zeros(len(seed))
    flat, draw = sig.reshape(-1), 0
    while len(seed):
        a, b = (mix(seed + U((2 * draw + i) * int(GOLDEN) & 2**64 - 1)) for i in (1, 2))
        draw += 1
        time = time - np.log(((a >> U(11)) + U(1)) * 2.0**-53) / (m * size)
        live = time < sig.max(axis=1)[owner]
        level = low + 1 + ((b >> U(16)) % size.astype(U)).astype(np.int64)
        hit = live & (level <= weight)
        np.minimum.at(flat, owner[hit] * m + (b[hit] & U(m - 1)).astype(np.int64), time[hit])
        owner, weight, size, low, seed, time = (x[live] for x in (owner, weight, size, low, seed, time))
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(sig[:, : bands * ROWS]).view(U).reshape(len(sig), bands, -1)
    key = np.arange(1, bands + 1, dtype=U)[None, :] * GOLDEN
    for i in range(bits.shape[2]):
        key = mix(key * U(0x100000001B3) + bits[:, :, i])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags: sum of lesser counts by sum of greater ones; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum()
    return both / (a[1].sum() + b[1].sum() - both)


def _slices(frame: pd.DataFrame, text: str, chars: int = 400_000) -> Iterator[pd.DataFrame]:
    sizes = frame[text].str.len().fillna(0).cumsum() // chars
    for _, part in frame.groupby(sizes, sort=False):
        yield part


def sketch(docs: DataFrame) -> DataFrame:
    """digest, doc_id, the band keys (8 bytes each) and 16 bits of each component of each row (null for a text without words)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _slices(frame, "text"):
                bags = shingles(list(part["text"]))
                sig = signatures(bags)
                keys, short = band_keys(sig), (mix(sig.view(U)) >> U(48)).astype("<u2")
                raw = lambda rows: [k.tobytes() if len(bag[0]) else None for k, bag in zip(rows, bags, strict=True)]
                yield pd.DataFrame({"doc_id": part["doc_id"], "digest": part["digest"], "bands": raw(keys), "sig": raw(short)})

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("doc_id"), digest(), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, digest binary, bands binary, sig binary")


def digest():
    """128 bits of the text's SHA-256: what names a text in here."""
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("digest")


def candidates(docs: DataFrame, texts: DataFrame, members: DataFrame, bound: int = 200_000) -> DataFrame:
    """digest and text of every text that is in a bucket with another; texts outside buckets are not shuffled."""
    named = cut(members.select("digest").distinct().join(texts.select("digest", "max_id"), "digest"))
    few = named.limit(bound + 1).count() <= bound
    mine = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("max_id"), digest(), F.coalesce("text", F.lit("")).alias("text"))
    found = mine.join(F.broadcast(named) if few else named, ["digest", "max_id"], "left_semi")
    return cut(found.select("digest", "text").dropDuplicates(["digest"]))


def by_digest(sigs: DataFrame, name: str, *columns: str) -> DataFrame:
    return sigs.select(F.col("digest").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])


def agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least AGREE components. ``sigs``: digest, sig."""

    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(c), "<u2").reshape(len(c), -1) if len(c) else np.empty((0, 1)) for c in (x, y))
        return pd.Series((left == right).sum(axis=1))

    both = pairs.join(by_digest(sigs, "a", "sig"), "a")
    hubs = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).join(by_digest(sigs, "b", "sig"), "b"))
    both = join_grouped(both, hubs, "b", "n", pairs.count())
    return both.where(agree("sig_a", "sig_b") >= AGREE).select("a", "b")


def similarities(bags: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and sim, the weighted Jaccard similarity of the whole texts (``bags``: digest, text), for each pair (a, b).

    A text is in few pairs as a; as b, a hub may be in very many: its text is copied once for every COPIES of them, to be
    met in different tasks.
    """
    hubs = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("copies", F.ceil(F.col("n") / COPIES).cast("int")))
    salted = join_grouped(pairs.select("a", "b"), hubs, "b", "n", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    texts = hubs.join(bags.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b")
    copies = texts.select("b", "text_b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    both = salted.select("a", "b", "salt").join(bags.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a").join(copies, ["b", "salt"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(size=frame["text_a"].str.len() + frame["text_b"].str.len())
            for _, part in frame.groupby(frame["size"].cumsum() // 600_000, sort=False):
                names = list(dict.fromkeys([*part["text_a"], *part["text_b"]]))
                bag = dict(zip(names, shingles(names), strict=True))
                yield part[["a", "b"]].assign(sim=[similarity(bag[x], bag[y]) for x, y in zip(part["text_a"], part["text_b"], strict=True)])

    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a binary, b binary, sim double")


def components(edges: DataFrame) -> DataFrame:
    """digest, comp: each node of the edges (a, b) with the least digest that it is connected to.

    Labels fall to the least label among neighbours, then to their label's label, until nothing changes. A node with very
    many neighbours, and a label that very many nodes have, are joined apart from the others (``join_grouped``).
    """
    links = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = links.count()
    labels = cut(links.groupBy(F.col("a").alias("digest")).agg(F.least(F.min("b"), F.first("a")).alias("comp"), F.count(F.lit(1)).alias("n")))
    nodes = labels.count()
    while True:
        theirs = join_grouped(links, labels.select(F.col("digest").alias("b"), F.col("comp").alias("theirs"), "n"), "b", "n", total)
        seen = theirs.groupBy("a").agg(F.min("theirs").alias("theirs"))
        low = cut(labels.join(seen, labels["digest"] == seen["a"], "left").select("digest", "n", F.col("comp").alias("was"), F.least("comp", "theirs").alias("low")))
        jump = low.groupBy("low").agg(F.count(F.lit(1)).alias("n_low")).join(labels.select(F.col("digest").alias("low"), F.col("comp").alias("further")), "low")
        jump = join_grouped(low.select(F.hex("digest").alias("digest"), "n", "was", F.hex("low").alias("low")), jump.withColumn("low", F.hex("low")), "low", "n_low", nodes)
        new = cut(jump.select(F.unhex("digest").alias("digest"), "n", "was", F.least(F.unhex("low"), F.coalesce("further", F.unhex("low"))).alias("comp")))
        done = new.where("comp <> was").limit(1).count() == 0
        drop(labels, low)
        labels = new
        if done:
            drop(links)
            return new.select("digest", "comp")


def merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` after more edges: components of the graph between components, and their members renamed."""
    old = comps.withColumnRenamed("digest", "_d").withColumnRenamed("comp", "_c")
    ends = edges
    for end in ("a", "b"):
        ends = ends.join(old, ends[end] == old["_d"], "left").withColumn(end, F.coalesce("_c", end)).drop("_d", "_c")
    joined = components(ends.where("a <> b"))
    names = joined.select(F.col("digest").alias("comp"), F.col("comp").alias("new"))
    moved = comps.join(names, "comp", "left").select("digest", F.coalesce("new", "comp").alias("comp"))
    return cut(moved.unionByName(joined.join(comps.select("digest"), "digest", "left_anti")))


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """A sorted partition's rows, cut between groups only."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        last = (frame[keys] != frame[keys].iloc[-1]).any(axis=1).to_numpy()
        begin = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if begin:
            yield frame.iloc[:begin]
        rest = frame.iloc[begin:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def split(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members (digest, band, bucket) of buckets that hold several components, with comp, whether they are apart from the largest one, and how many are in all and apart."""
    named = cut(members.select("digest", "band", "bucket").join(comps, "digest", "left").withColumn("comp", F.coalesce("comp", "digest")))
    parts = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    parts = cut(parts.agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1"))
    out = join_grouped(named, parts, "bucket", "n", named.count()).where("k > 1")
    out = cut(out.select("digest", "band", "bucket", "comp", (F.col("comp") != F.col("main")).alias("apart"), "n", (F.col("n") - F.col("n_main")).alias("n_apart")))
    drop(named, parts)
    return out


def next_hubs(open_: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of each member of a bucket with many texts apart and another hub, one of these."""
    many = open_.where(F.col("n_apart") > HUB_FROM)
    one = F.min_by(F.struct("digest", "comp"), F.xxhash64("digest", F.lit(number)))
    hubs = cut(many.where("apart").groupBy("bucket").agg(one.alias("hub"), F.max("n").alias("n_in")))
    met = join_grouped(many.select("digest", "bucket", "comp"), hubs, "bucket", "n_in", many.count())
    return met.where("comp <> hub.comp").select(F.greatest("digest", "hub.digest").alias("a"), F.least("digest", "hub.digest").alias("b")).distinct()


def remaining(open_: DataFrame, sigs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between texts of one bucket that lie in different components.

    ``open_``: ``split``; ``sigs``: digest, bands, sig. The texts outside a bucket's largest component are dealt into
    blocks, and so are all of its texts; a task compares a block of the ones with a block of the others. A first pass
    finds the texts that agree with another, a second one has these texts only. A pair is left to the first band in
    which it shares a bucket.
    """
    spread = lambda n, salt: F.pmod(F.xxhash64("digest", F.lit(salt)), F.ceil(F.col(n) / BLOCK)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / BLOCK).cast("int") - 1))
    own = ["digest", "band", "bucket", "comp", "bands", "sig"]
    both = cut(open_.join(sigs, "digest"))
    ones = both.where("apart").withColumn("p", spread("n_apart", 1)).select(*own, "p", every("n").alias("q"), F.lit(True).alias("one"))
    others = both.withColumn("q", spread("n", 2)).select(*own, every("n_apart").alias("p"), "q", F.lit(False).alias("one"))
    keys = ["bucket", "p", "q"]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def groups(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of a block's rows, and agreement, x, y of its pairs by these numbers."""
        sig = np.frombuffer(b"".join(frame["sig"]), "<u2").reshape(len(frame), -1)
        bands = np.frombuffer(b"".join(frame["bands"]), np.int64).reshape(len(frame), -1)
        one, band, comp = frame["one"].to_numpy(bool), frame["band"].to_numpy(), pd.factorize(frame["comp"])[0]
        change = np.flatnonzero((frame[keys] != frame[keys].shift()).any(axis=1).to_numpy())
        for begin, end in zip(change, [*change[1:], len(frame)], strict=True):
            mine = slice(begin, end)
            found = block_pairs(sig[mine], bands[mine, : band[begin]], comp[mine], one[mine])
            if len(found):
                yield np.arange(begin, end), found + np.array([0, begin, begin])

    def agreeing_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            hit = [np.unique(found[:, 1:]) for _, found in groups(frame)]
            yield frame.iloc[np.concatenate(hit) if hit else []]

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            names, texts, comp, out = frame["digest"].to_numpy(), frame["text"].to_numpy(), pd.factorize(frame["comp"])[0], []
            for _, found in groups(frame):
                out += [(max(names[x], names[y]), min(names[x], names[y])) for x, y in linked(found, comp, texts, threshold)]
            yield pd.DataFrame(out, columns=["a", "b"])

    kind = "digest binary, band int, bucket string, comp binary, bands binary, sig binary, p int, q int, one boolean"
    near = cut(dealt(ones.unionByName(others)).mapInPandas(agreeing_rows, kind))
    return dealt(near.join(bags, "digest")).mapInPandas(links, "a binary, b binary").distinct()


def block_pairs(sig: np.ndarray, earlier: np.ndarray, comp: np.ndarray, one: np.ndarray) -> np.ndarray:
    """agreement, x, y of the pairs of a one and another in different components that share none of the ``earlier`` band keys."""
    right, out = np.flatnonzero(~one), []
    for x in np.flatnonzero(one):
        some = right[comp[right] != comp[x]]
        same = (sig[some] == sig[x]).sum(axis=1)
        some, same = some[same >= AGREE], same[same >= AGREE]
        if len(some) and earlier.shape[1]:
            first = ~(earlier[some] == earlier[x]).any(axis=1)
            some, same = some[first], same[first]
        if len(some):
            out.append(np.column_stack([same, np.full(len(some), x), some]))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def linked(found: np.ndarray, comp: np.ndarray, texts: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Of the pairs (agreement, x, y), in order of agreement, those that link parts which the ones before left apart."""
    root: dict[int, int] = {}
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = []

    def top(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in known:
            known[i] = shingles([texts[i]])[0]
        return known[i]

    for _, x, y in found[np.lexsort((found[:, 2], found[:, 1], -found[:, 0]))].tolist():
        a, b = top(int(comp[x])), top(int(comp[y]))
        if a != b and similarity(bag(x), bag(y)) >= threshold:
            root[a] = b
            out.append((x, y))
    return out


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, digest, class_id (the doc_id of its class that stays), class_size, kept."""
    with small_batches(docs.sparkSession):
        return _classes(docs, threshold)


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    rows = cut(sketch(docs))
    texts = cut(rows.groupBy("digest").agg(F.max("doc_id").alias("max_id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    total = texts.count()
    key = lambda i: F.hex(F.substring("bands", 8 * i + 1, 8))
    buckets_of = F.array(*[F.struct(F.lit(i).alias("band"), F.concat(F.lit(f"{i:x}:"), key(i)).alias("bucket")) for i in range(BANDS)])
    banded = texts.where("bands is not null").select("digest", F.explode(buckets_of).alias("_b")).select("digest", "_b.band", "_b.bucket")
    buckets = cut(banded.groupBy("bucket").agg(F.min("digest").alias("hub"), F.count(F.lit(1)).alias("n_in")).where("n_in > 1"))
    members = cut(join_grouped(banded, buckets, "bucket", "n_in", total * BANDS).where("hub is not null"))
    bags = candidates(docs, texts, members)
    sigs = texts.select("digest", "bands", "sig")
    similar = lambda pairs: cut(similarities(bags, cut(agreeing(cut(pairs), sigs))).where(F.col("sim") >= threshold))
    comps = components(similar(members.where("digest <> hub").select(F.col("digest").alias("a"), F.col("hub").alias("b")).distinct()))
    open_ = split(members, comps)
    many = lambda: open_.where(F.col("n_apart") > HUB_FROM).where("apart").count()
    apart = many()
    for number in range(HUBS):
        if not apart:
            break
        comps = merged(comps, similar(next_hubs(open_, number)))
        drop(open_)
        open_, before = split(members, comps), apart
        apart = many()
        if apart > 0.8 * before:
            break
    more = cut(remaining(open_, sigs, bags, threshold))
    if more.limit(1).count():
        comps = merged(comps, more)

    named = cut(texts.select("digest", "max_id", "n").join(comps, "digest", "left").withColumn("comp", F.coalesce("comp", "digest")))
    whole = cut(named.groupBy("comp").agg(F.max(F.struct("max_id", "digest")).alias("top"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n_texts")))
    drop(buckets, members, bags, open_, more)
    placed = join_grouped(named.withColumn("comp", F.hex("comp")), whole.withColumn("comp", F.hex("comp")), "comp", "n_texts", total)
    placed = cut(placed.select(F.hex("digest").alias("digest"), F.col("n").alias("copies"), F.col("top.max_id").alias("class_id"), "class_size", (F.col("digest") == F.col("top.digest")).alias("stays")))
    drop(texts, named, whole)
    out = join_grouped(rows.select("doc_id", F.hex("digest").alias("digest")), placed, "digest", "copies", rows.count())
    none = F.lit(-(2**63)).cast("long")
    real = lambda c: F.when(F.col(c) != none, F.col(c)).alias(c)
    return out.select(real("doc_id"), F.unhex("digest").alias("digest"), real("class_id"), "class_size", ((F.col("doc_id") == F.col("class_id")) & F.col("stays")).alias("kept"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, one of each class, with all their columns."""
    found = classes(docs, threshold).where("class_size > 1")
    decided = cut(found.groupBy("digest").agg(F.max("class_id").alias("_keep"), F.max("kept").alias("_stays")).withColumnRenamed("digest", "_digest"))
    aside = set_aside(docs, "doc_id", "text")
    return brought_back(keep_decided(aside.withColumn("_digest", digest()), decided), aside, docs)
