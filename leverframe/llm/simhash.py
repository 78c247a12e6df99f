"""SimHash near-duplicates by bit-sliced comparison.

1. A fingerprint has 64 bits: a bit is set if more than half of the hashes (XXH64, seed 42) of a text's three-word
   shingles, repeats included, have it set. Documents with one fingerprint count as one from here on.
2. Fingerprints that differ in at most ``RADIUS`` = 2 bits agree in at least one of three parts of their bits; each part
   is a key. Fingerprints that share a key are compared. A key with more than ``CROWDED`` fingerprints is split by the
   same rule: the bits outside its part are cut in three again, and these parts are further keys below it. What is
   crowded even then is dealt into tiles of which every two meet; nothing is left out by a cap.
3. A task compares a block of fingerprints (keys with few are put together) in bit planes: plane b holds bit b of all of
   the block, 64 fingerprints a machine word. For a strip of queries, each plane that differs is added to two carry-save
   counters for all fingerprints at once; a third word remembers who is beyond the radius, and a query is abandoned as
   soon as that holds for all of the block.
4. Of the pairs found in a block those leave the task that link its parts: a forest, so a crowd of like fingerprints
   gives one link for each, with the same components. Components come from label propagation over the links.

Results for odd input: null and empty texts and texts without words have fingerprint zero, which is linked like any other;
one or two words are one shingle; very long texts are hashed whole, a window at a time; ties (a bit set in exactly half
of the hashes) give 0; repeated rows get a row each; a component of rows that all lack an id has a null id, else the
least id that is there; an empty table gives an empty result. ``components_of`` has columns of its own and the id; other
columns of ``docs``, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverframe.llm.common import cut, drop, join_grouped, partitions, small_batches
from leverframe.llm.near_dedup import components

WORDS, SEED, BITS, RADIUS = 3, 42, 64, 2
#: Fingerprints of a key beyond which it is split, of a tile of what stays crowded, of a block that small keys fill, and queries of a strip.
CROWDED, TILE, BLOCK, STRIP = 4096, 2048, 512, 512
#: Shingles hashed at once.
WINDOW = 100_000
#: Bits outside a part, checked after so many planes for queries that can be abandoned.
PLANES = 6

U = np.uint64


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0d
    if not words:
        return 0
    grams = map(b" ".join, zip(*[words[i:] for i in range(WORDS)], strict=False)) if len(words) >= WORDS else iter([b" ".join(words)])
    n, ones = 0, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    while window := [digest(g, SEED) for g in islice(grams, WINDOW)]:
        n += len(window)
        bits = np.unpackbits(np.frombuffer(b"".join(window), np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp, the fingerprint as 8 bytes, of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()).to_bytes(8, "big") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["k", "fp"])

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"k {kind}, fp binary").withColumnRenamed("k", id_col)


def parts_of(bits: list[int], n: int = RADIUS + 1) -> list[list[int]]:
    """The bits' numbers in ``n`` parts of nearly equal length."""
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


FIRST = parts_of(list(range(BITS)))
SECOND = [parts_of([b for b in range(BITS) if b not in part]) for part in FIRST]


def mask(bits: list[int]) -> int:
    """The signed 64-bit number with these bits set, bit 0 being the lowest."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def keyed(fps: DataFrame) -> DataFrame:
    """fp, word (the fingerprint as a long), part and value: three rows for each fingerprint."""
    word = F.conv(F.hex("fp"), 16, -10).cast("long")
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("word").bitwiseAND(F.lit(mask(p))).alias("value")) for i, p in enumerate(FIRST)])
    return fps.select("fp", word.alias("word")).select("word", F.explode(keys).alias("k")).select("word", F.concat_ws(":", "k.part", "k.value").alias("key"), F.col("k.part").alias("part"))


def crowded(rows: DataFrame) -> DataFrame:
    """key and n of the keys with more than CROWDED rows."""
    return cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED))


def blocks(fps: DataFrame) -> DataFrame:
    """word, key: fingerprints that share a key must be compared, and no key has more than CROWDED of them."""
    rows = keyed(fps)
    many = crowded(rows)
    if not many.limit(1).count():
        return rows.select("word", "key")
    rows = cut(rows)
    marked = cut(join_grouped(rows, many, "key", "n", rows.count()))
    below = lambda part: F.array(*[F.concat_ws(":", F.lit(str(i)), F.col("word").bitwiseAND(F.lit(mask(p))).cast("string")) for i, p in enumerate(SECOND[part])])
    subs = F.when(F.col("part") == 0, below(0)).when(F.col("part") == 1, below(1)).otherwise(below(2))
    split = cut(marked.where("n IS NOT NULL").select("word", "key", F.explode(subs).alias("s")).select("word", F.concat_ws("/", "key", "s").alias("key")))
    many = crowded(split)
    tiled = cut(join_grouped(split, many, "key", "n", split.count()))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("word"), tiles).cast("int")
    pairs = tiled.where("n IS NOT NULL").select("word", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    pairs = pairs.select("word", F.concat_ws("/", "key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    return marked.where("n IS NULL").select("word", "key").unionByName(tiled.where("n IS NULL").select("word", "key")).unionByName(pairs)


def planes_of(words: np.ndarray) -> np.ndarray:
    """Bit planes: row b has bit b of every word, 64 words to a machine word (the first in its lowest bit)."""
    n = -(-len(words) // 64) * 64
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.zeros((BITS, n), np.uint8)
    full[:, : len(words)] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view(U)


def near(words: np.ndarray, at: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the queries words[at] are left, and for each of these, as bits over all words, which lie within RADIUS."""
    ones, twos, beyond = (np.zeros((len(at), planes.shape[1]), U) for _ in range(3))
    pad = np.zeros(planes.shape[1] * 64, np.uint8)
    pad[len(words) :] = 1
    beyond |= np.packbits(pad, bitorder="little").view(U)
    flips = U(0) - ((words[at][:, None] >> np.arange(BITS, dtype=U)) & U(1))
    for b in range(BITS):
        differ = planes[b] ^ flips[:, b : b + 1]
        carry = ones & differ
        ones ^= differ
        twos ^= carry  # two bits: a fourth difference comes only after the third, which is remembered
        beyond |= twos & ones
        if b % PLANES == PLANES - 1:
            # A query meets itself; it is abandoned once nothing else is left.
            left = np.flatnonzero(np.bitwise_count(~beyond).sum(axis=1) > 1)
            if len(left) < len(at):
                at, ones, twos, beyond, flips = at[left], ones[left], twos[left], beyond[left], flips[left]
            if not len(at):
                break
    return at, ~beyond


def forest(words: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of numbers of words within RADIUS that link all that such pairs link: a spanning forest."""
    planes, rows = planes_of(words), {}
    for begin in range(0, len(words), STRIP):
        at, bits = near(words, np.arange(begin, min(begin + STRIP, len(words))), planes)
        rows |= zip(at.tolist(), bits, strict=True)
    free, out = np.full(planes.shape[1], ~U(0), U), []
    for root in rows:
        if not int(free[root >> 6]) >> (root & 63) & 1:
            continue
        free[root >> 6] &= ~(U(1) << U(root & 63))
        todo = [root]
        while todo:
            x = todo.pop()
            new = rows[x] & free
            free &= ~new
            found = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little")).tolist()
            out += [(x, y) for y in found]
            todo += found
    return out


def links(rows: DataFrame) -> DataFrame:
    """a, b (8 bytes each): links between fingerprints that share a key, of each block a spanning forest. ``rows``: ``blocks``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """The words of whole keys with several, those of small keys together."""
        rest_word, rest_key, block, size = np.empty(0, np.int64), np.empty(0, object), [], 0
        for batch in batches:
            rest_word = np.concatenate([rest_word, batch.column(0).to_numpy(zero_copy_only=False)])
            rest_key = np.concatenate([rest_key, batch.column(1).to_numpy(zero_copy_only=False)])
            change = np.flatnonzero(rest_key[1:] != rest_key[:-1]) + 1
            for part in np.split(rest_word, change)[:-1]:
                if len(part) > 1:
                    if size and size + len(part) > BLOCK:
                        yield np.concatenate(block)
                        block, size = [], 0
                    block.append(part)
                    size += len(part)
            if len(change):
                rest_word, rest_key = rest_word[change[-1] :], rest_key[change[-1] :]
        if len(rest_word) > 1:
            block.append(rest_word)
        if block:
            yield np.concatenate(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in packed(batches):
            words = np.unique(words.view(U))
            raw = words.astype(">u8").tobytes()
            name = [raw[8 * i : 8 * i + 8] for i in range(len(words))]
            pairs = forest(words)
            a, b = [max(name[x], name[y]) for x, y in pairs], [min(name[x], name[y]) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, fingerprint (16 hexadecimal digits), component_id, the least id that links of RADIUS bits at most lead to."""
    with small_batches(docs.sparkSession):
        rows = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = cut(links(blocks(fps)))
    comps = cut(components(found))
    named = cut(fps.join(comps.withColumnRenamed("digest", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")))
    least = cut(named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_fps")))
    placed = join_grouped(named.select(F.hex("fp").alias("fp"), "n", F.hex("comp").alias("comp")), least.withColumn("comp", F.hex("comp")), "comp", "n_fps", fps.count())
    placed = cut(placed.select("fp", "n", "component_id"))
    drop(fps, found, comps, named, least)
    out = join_grouped(rows.select("doc_id", F.hex("fp").alias("fp")), placed, "fp", "n", rows.count())
    return out.select(F.col("doc_id").alias(id_col), F.lower("fp").alias("fingerprint"), "component_id")
