"""Exact and near dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leverframe.llm import exact_dedup, near_dedup
from leverframe.llm.common import keep_decided
from tests.oracle import SF


def test_cuckoo_inserts_deletes_and_grows():
    index = exact_dedup.CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    assert all(index.insert(k, i) for i, k in enumerate(keys)) and index.resizes > 3
    assert not index.insert(keys[5], 9999) and index.get(keys[5])[1:] == [9999, 2]
    assert all(index.delete(k) for k in keys[:1000]) and not index.delete(keys[0])
    assert index.find(keys[0]) is None and all(index.get(k) for k in keys[1000:])
    assert len(list(index.items())) == 2000


def test_cuckoo_tells_equal_fingerprints_apart():
    index = exact_dedup.CuckooIndex(4)
    a, b = (b"\x01\x02" + bytes(8) + bytes([i]) for i in (1, 2))
    assert index.insert(a, 1) and index.insert(b, 2) and index.get(a)[1] == 1 and index.get(b)[1] == 2


CASES = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (7, "c"), (8, "x" * 100_000), (9, " a")]


def frame(spark):
    return spark.createDataFrame(CASES, "doc_id long, text string").selectExpr("*", "'z' AS digest", "'y' AS n", "1 AS keep_id")


def test_exact_groups(spark):
    rows = exact_dedup.groups(frame(spark)).collect()
    assert len(rows) == len(CASES)
    by = {(r["doc_id"], r["text_sha256"]): r for r in rows}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert by[(1, sha("a"))]["keep_id"] == 2 and not by[(1, sha("a"))]["kept"] and by[(2, sha("a"))]["kept"]
    assert by[(3, sha(""))]["keep_id"] == 4 and by[(3, sha(""))]["group_size"] == 2
    assert by[(5, sha("b"))]["kept"] and by[(5, sha("b"))]["group_size"] == 2
    assert by[(None, sha("c"))]["keep_id"] == 7 and by[(9, sha(" a"))]["group_size"] == 1


def test_exact_dedup_keeps_one_of_each(spark):
    out = exact_dedup.dedup(frame(spark))
    assert out.columns == frame(spark).columns
    assert sorted((r["doc_id"] for r in out.collect())) == [2, 4, 5, 7, 8, 9]
    assert exact_dedup.dedup(frame(spark).where("false")).count() == 0 and exact_dedup.groups(frame(spark).where("false")).count() == 0


def test_hot_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    rows = exact_dedup.groups(df).collect()
    assert sum(r["kept"] for r in rows) == 2001 and max(r["group_size"] for r in rows) == 1000


def test_apply_changes(spark):
    d = lambda t: hashlib.sha256(t.encode()).digest()
    index = spark.createDataFrame([(d("a"), 1, 1), (d("b"), 2, 3)], "digest binary, keep_id long, group_size long")
    ins = spark.createDataFrame([(d("c"), 7, 1), (d("a"), 5, 2)], "digest binary, doc_id long, n long")
    dele = spark.createDataFrame([(d("b"),)], "digest binary")
    got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.apply_changes(index, ins, dele).collect()}
    assert got == {d("a"): (5, 3), d("c"): (7, 1)}


# near-dedup ---------------------------------------------------------------------------------------------------------


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low) if low else 0.0


def brute_classes(rows):
    """Classes of (id, text) rows: equal texts, and texts of similarity 0.8 or more, transitively."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bags, by_shingle, first = [bag(t) for _, t in rows], defaultdict(list), {}
    for i, (_, t) in enumerate(rows):
        if (t or "") in first:
            parent[root(i)] = root(first[t or ""])
        else:
            first[t or ""] = i
            for s in bags[i]:
                by_shingle[s].append(i)
    for group in by_shingle.values():
        for x in range(len(group)):
            for y in range(x):
                if root(group[x]) != root(group[y]) and jaccard(bags[group[x]], bags[group[y]]) >= 0.8:
                    parent[root(group[x])] = root(group[y])
    out = defaultdict(set)
    for i, (k, _) in enumerate(rows):
        out[root(i)].add(k)
    return {frozenset(v) for v in out.values()}


def spark_classes(df):
    out = defaultdict(set)
    for r in near_dedup.classes(df).collect():
        out[r["class_id"]].add(r["doc_id"])
    assert all(k == max(v) for k, v in out.items())
    return {frozenset(v) for v in out.values()}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6):
        pairs = []
        for _ in range(20):
            keys = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
            a = rng.integers(1, 9, len(keys))
            b = np.where(rng.random(len(keys)) < share, rng.integers(1, 9, len(keys)), a)
            sig = near_dedup.signatures([(keys, a), (keys, b)], 1024)
            pairs.append(((sig[0] == sig[1]).mean(), near_dedup.similarity((keys, a), (keys, b))))
        got, want = np.mean(pairs, axis=0)
        assert abs(got - want) < 0.02


def test_word_and_shingle_rules():
    same = near_dedup.shingles(["a b c d e f", "a  b\tc\nd e f", "a b c", "a b  c", "", "a b c d e a b c d e"])
    assert np.array_equal(same[0][0], same[1][0]) and np.array_equal(same[2][0], same[3][0])
    assert len(same[0][0]) == 2 and len(same[2][0]) == 1 and not len(same[4][0]) and same[5][1].max() == 2


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_documents_match_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert spark_classes(df) == brute_classes([tuple(r) for r in df.collect()])


def planted(n=60):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(300)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 14)):  # similarities on both sides of the threshold, linked through others
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(word() for _ in range(200))) for i in range(20)]
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "one  two"), (2004, "x " * 20_000), (2005, "x " * 19_000), (2006, rows[0][1]), (2006, rows[0][1])]
    return rows


def test_chains_and_odd_rows_match_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'e' AS digest", "2 AS bands")
    assert spark_classes(df) == brute_classes(rows)


def test_near_dedup_keeps_one_of_each(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'e' AS digest")
    out = near_dedup.dedup(df)
    assert out.columns == df.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(ids) == sorted(max(c) for c in brute_classes(rows))
    assert near_dedup.dedup(df.where("false")).count() == 0


def test_repeated_ids_over_near_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a"), (7, text, "b"), (7, text + " tail", "c"), (7, text + " tail", "c"), (7, "quite another text", "d"), (None, "no id", "e"), (None, "no id", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    out = near_dedup.dedup(df).collect()
    assert sorted((str(r["doc_id"]), r["text"] == rows[4][1]) for r in out) == [("7", False), ("7", True), ("None", False)]
    kept = [r for r in near_dedup.classes(df).collect() if r["kept"]]
    assert len({bytes(r["digest"]) for r in kept}) == 3


@pytest.mark.parametrize("hubs", [0, 2])
def test_split_buckets_lose_no_link(spark, monkeypatch, hubs):
    """Texts that share a hub which none of them is near to: all links are found, by further hubs and by blocks."""
    monkeypatch.setattr(near_dedup, "HUBS", hubs)
    monkeypatch.setattr(near_dedup, "HUB_FROM", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "COPIES", 3)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(150)]
    rows = []
    for g in range(12):
        own = common + [f"g{g}x{i}" for i in range(rng.randint(20, 60))]
        for j in range(5):
            rows.append((100 * g + j, " ".join(own + [f"t{g}y{j}z{i}" for i in range(rng.randint(1, 12))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert spark_classes(df) == brute_classes(rows)


def test_whole_groups_are_never_cut():
    frame = pd.DataFrame({"k": np.repeat(np.arange(7), [1, 5, 2, 9, 1, 1, 3]), "v": range(22)})
    for step in (1, 2, 5, 22):
        got = list(near_dedup.whole_groups((frame.iloc[i : i + step] for i in range(0, 22, step)), ["k"]))
        assert pd.concat(got)["v"].tolist() == list(range(22)) and all(set(a["k"]).isdisjoint(b["k"]) for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("bound", [0, 100_000])
def test_both_joins_of_decided_rows_agree(spark, monkeypatch, bound):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    keyed = df.withColumn("_digest", F.xxhash64("text"))
    groups = keyed.groupBy("_digest").agg(F.max("doc_id").alias("_keep"), F.lit(True).alias("_stays"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    got = {r["doc_id"] for r in keep_decided(keyed, groups, bound).collect()}
    assert got == {r[0] for r in df.groupBy("text").agg(F.max("doc_id")).select("max(doc_id)").collect()}


def test_shuffled_candidates_agree(spark, monkeypatch):
    rows = planted(20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup.candidates, "__defaults__", (0,))
    assert spark_classes(df) == brute_classes(rows)


def test_shards_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD", 100)
    df = spark.range(2500).selectExpr("id AS doc_id", "concat('t', id % 2000) AS text")
    assert exact_dedup.shards(df) == 25 and sum(r["kept"] for r in exact_dedup.groups(df).collect()) == 2000


@pytest.mark.parametrize("n", [0, 1])
def test_tiny_tables(spark, n):
    df = spark.createDataFrame([(1, "a b c d e f")][:n], "doc_id long, text string")
    assert near_dedup.classes(df).count() == n
