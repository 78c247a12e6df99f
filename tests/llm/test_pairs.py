"""Hard negatives, SimHash components and tokenizer alignment against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leverframe.llm import align, hard_negatives, queries, simhash
from tests.oracle import SF, connect, same

SPEC, MODEL = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.path(queries.PIECES)


def brute_negatives(rows, every, positives=5, negatives=3):
    """``rows``: id, label, vector of whole numbers."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        dot = lambda u: sum(x * y for x, y in zip(v, u, strict=False))  # noqa: B023, E731
        ranked = sorted((-dot(u), i, other) for i, other, u in rows if i != a)
        for ps, p, _ in [r for r in ranked if r[2] == label][:positives]:
            fit = [(s, n) for s, n, other in ranked if other != label and 50 * -ps <= 100 * -s <= 95 * -ps][:negatives]
            out += [(a, p, k, n, -ps, -s) for k, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=50):
    df = spark.createDataFrame(rows, "id long, label int, v array<long>").withColumn("Len", F.lit("clash"))
    got = hard_negatives.mine(df, F.col("id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("blocks", [(2048, 512, 16), (16, 4, 2)])
def test_negatives_in_many_dimensions_of_many_lengths(spark, monkeypatch, blocks):
    for name, n in zip(("ROWS", "ANCHORS", "SIDE"), blocks, strict=True):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(size=6) * rng.choice([5, 50, 500])).astype(int).tolist()) for i in range(300)]
    rows += [(300 + i, 1, rows[0][2]) for i in range(40)]  # one vector many times: ties by id
    rows += [(400, 2, [0] * 6), (450, 7, [1] * 6), (401, 2, [1, 1])]  # zero vector, label of its own, shorter vector
    assert mined(spark, rows, 25) == brute_negatives(rows, 25)


def test_coordinates_prune():
    rng = np.random.default_rng(1)

    def side(v, windows=None):
        r = SimpleNamespace()
        r.ids, r.labels, r.vectors, r.n, r.width = np.arange(len(v)).tobytes(), np.zeros(len(v), np.int64).tobytes(), v.tobytes(), len(v), v.shape[1]
        r.longest = np.sqrt((v.astype(float) ** 2).sum(axis=1)).max()
        r.lows, r.highs = (np.full((len(v), 1), w, np.int64).tobytes() if windows else b"" for w in (windows or (0, 0)))
        return hard_negatives.Side(r)
    v = rng.normal(size=(1500, 8))
    v = (1000 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    bucket, asked = side(v), side(v[:40], (880_000, 1 << 40))
    asked.labels = np.ones(40, np.int64)
    bucket.lists()
    best = hard_negatives.Best(asked, 3, 1)
    made, of = hard_negatives.probe(asked, bucket, best, False)
    assert made < of / 5
    for i in range(40):
        want = sorted((-int(s), j) for j, s in enumerate(v @ v[i]) if s >= 880_000)[:3]
        assert [(-s, j) for s, j in zip(best.score[0, i].tolist(), best.id[0, i].tolist(), strict=True) if s > hard_negatives.LEAST] == want


def test_odd_vectors(spark):
    big = 1 << 30
    rows = [(0, 1, [big, 1]), (1, 1, [big, 2]), (2, 2, [big // 2, 5]), (3, 2, [-big, 0])]
    assert mined(spark, rows) == brute_negatives(rows, 50)
    assert mined(spark, [(0, 1, [1 << 62]), (1, 1, [1 << 62]), (2, 2, [1])])[0:0] == []
    assert mined(spark, []) == [] and mined(spark, [(None, 1, [1]), (0, None, [1]), (50, 1, None), (100, 1, [])]) == []
    x = spark.createDataFrame([([0.5, None],), ([float("nan")],), ([float("inf")],), (None,), ([0.999, -0.001],), ([1e300],)], "e array<double>")
    assert [r[0] for r in x.select(hard_negatives.quantised(F.col("e"))).collect()] == [None, None, None, None, [255, -1], [(1 << 63) - 1]]


def test_negatives_match_sql(spark):
    same(queries.op11_hard_negatives(spark, SF), connect(), queries.oracle_sql()["op11_hard_negatives"])


def plain_fingerprint(text):
    table = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in (text or "").translate(table)).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """``rows``: id, fingerprint as a number."""
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(rows):
        for j, (_, y) in enumerate(rows[:i]):
            if (x ^ y).bit_count() <= 2:
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[top(i)].append(doc)
    return [(doc, f"{x:016x}", min((d for d in least[top(i)] if d is not None), default=None)) for i, (doc, x) in enumerate(rows)]


ODD = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one  "), (6, "one two"), (7, "A b C d"), (8, "a\tb\x0bc\nd"), (8, "a\tb\x0bc\nd"), (None, "alone in here, without id"), (10, "é É ñ"), (11, "x y " * 40_000), (12, "\x1c a b")]


def test_fingerprints_and_components_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + ODD
    df = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).selectExpr("doc_id", "text", "'c' AS fp", "1 AS Word")
    got = simhash.components_of(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = brute_components([(doc, plain_fingerprint(t)) for doc, t in rows])
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert simhash.components_of(df.where("false")).count() == 0


def test_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 40)
    monkeypatch.setattr(simhash, "TILE", 25)
    rng = random.Random(9)
    base = rng.getrandbits(64)
    near = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    tail = lambda x: x ^ sum(1 << b for b in rng.sample(range(12), 5))  # noqa: E731  agree in most of the bits
    words = sorted({*(near(base, rng.randint(1, 8)) for _ in range(300)), *(tail(base) for _ in range(300)), *(rng.getrandbits(64) for _ in range(100))})
    fps = spark.createDataFrame([(bytearray(w.to_bytes(8, "big")),) for w in words], "fp binary")
    keys = simhash.blocks(fps).groupBy("key").count()
    assert keys.where("key LIKE '%/%/%'").count() and keys.agg(F.max("count")).first()[0] < 100
    comps = {bytes(r["digest"]): bytes(r["comp"]) for r in simhash.components(simhash.links(simhash.blocks(fps))).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for w, (_, _, c) in zip(words, brute_components([(w, w) for w in words]), strict=True):
        theirs[c].add(w)
        mine[comps.get(w.to_bytes(8, "big"), w.to_bytes(8, "big"))].add(w)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_forest_links_what_pairs_link():
    rng = random.Random(2)
    base = rng.getrandbits(64)
    words = np.array(sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(700)}), np.uint64)
    found = simhash.forest(words)
    assert all((int(words[a]) ^ int(words[b])).bit_count() <= 2 for a, b in found)
    want = len({c for _, _, c in brute_components([(i, int(w)) for i, w in enumerate(words)])})
    assert len(words) - len(found) == want


def whole_tokens(texts):
    """A's and B's (id, bytes) of whole texts, by the libraries."""
    library, pieces = Tokenizer.from_file(SPEC), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    library.encode_special_tokens = True
    from leverframe.llm.bpe import byte_alphabet

    alphabet = byte_alphabet()
    names = {i: bytes(alphabet[c] for c in t) for t, i in library.get_vocab().items() if t != "<|endoftext|>"}
    for t in texts:
        a = [(i, names[i]) for i in library.encode(" " + t, add_special_tokens=False).ids]
        b = [(i, align.piece_bytes(pieces.id_to_piece(i))) for i in pieces.encode(t)]
        yield (a, b) if t and b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode() else ([], [])


def brute_alignment(texts):
    def spans(tokens):
        at = 0
        for i, raw in tokens:
            yield i, at, at + len(raw)
            at += len(raw)

    out, count = [], Counter()
    for a, b in whole_tokens(texts):
        a, b = list(spans(a)), list(spans(b))
        links = [(i, k) for i, s, e in a for k, f, g in b if s < g and f < e]
        count.update(links)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([i for i, _, e in a if low < e <= high], [i for i, _, e in b if low < e <= high]) for low, high in zip([0, *ends], ends, strict=False)]
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, k), n in count.items():
        best[k] = max(best[k], n)
    return [(na, nb, ng, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), sha) for na, nb, ng, ls, sha in out]


ODD_TEXTS = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b\n c", "tab\t x", "▁under", "<|endoftext|> x <s> </s> <unk> <0x41>", "日本語 テスト 🙂🙂", "it's we'll don't", "x" * 500, "1234567 ½ ²", "\xa0 nb\xa0 sp", "\x1c \x85 y", "trail \n", " " * 40 + "x", "a　 b", "é́ ñ", "\x00", "end.\r\n  next"]


def test_alignment(spark):
    rng = random.Random(4)
    words = "the then thentien inéd 日本 a, b. it's 12 \n 🙂 <s>".split(" ")
    texts = [*ODD_TEXTS, *(rng.choice(["", " "]).join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(150)), "a b", "a b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (1 << 53 | 1, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'c' AS batch", "2 AS Pair")
    got = align.align(df, SPEC, MODEL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment([t or "" for _, t in rows])
    assert Counter(tuple(r) for r in got.collect()) == Counter((doc, *w) for (doc, _), w in zip(rows, want, strict=True))
    assert align.align(df.where("false"), SPEC, MODEL).count() == 0


def test_alignment_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(align, "CHARS", 300)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 2000").orderBy("doc_id").limit(40)
    rows = docs.collect()
    want = brute_alignment([r["text"] or "" for r in rows])
    got = {r["doc_id"]: tuple(r)[1:] for r in align.align(docs, SPEC, MODEL).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}
