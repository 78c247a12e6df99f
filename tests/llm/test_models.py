"""Quality rules against brute force, classifiers by held-out results, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leverframe.llm import langid, quality_model, quality_rules
from leverframe.llm.queries import queries
from tests.oracle import SF

TEXTS = [
    None, "", " \n ", "one", "a b c d e f g h " * 5, "l1 x\nl1 x\n\n\n \nl1 x\nl2", "w " * 30, "#a $b <c> | d",
    " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i % 25}" for i in range(60)), "a b c d e f g h i a b c d e f g h", "x\u00a0y z\x0bq", " ".join(f"k{i % 4000}" for i in range(20_000)),
]


def base(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_counts_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality_rules.judged(df, labels).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(TEXTS[r["doc_id"]]), r["doc_id"]
        assert r["kept"] is (not r["base_failed"])


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hash_word(w):
    return signed(xxhash.xxh64_intdigest(w.encode(), seed=42))


def hash_pair(a, b):
    """Spark chains the columns: the first's hash seeds the second."""
    raw = lambda v: (v % 2**64).to_bytes(8, "little")
    return signed(xxhash.xxh64_intdigest(raw(b), seed=xxhash.xxh64_intdigest(raw(a), seed=42)))


def grams(text):
    h = [hash_word(w) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return [x % quality_rules.BUCKETS for x in [*h, *map(hash_pair, h, h[1:])]]


def shrunk(g, raw, best, own):
    """Mean log ratio of the buckets ``g``, without ``own`` in the trusted counts."""
    n, n_raw, c = sum(best.values()) - sum(own.values()), sum(raw.values()), quality_rules.EVIDENCE
    return sum(math.log((best[b] - own[b] + c) / (n * raw[b] / n_raw + c)) for b in g) / len(g)


@pytest.mark.parametrize("broadcast", [quality_rules.BROADCAST, 3])
def test_verdicts_match_brute_force_without_own_counts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST", broadcast)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "a b c")], "doc_id long, text string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: grams(r["text"]) for r in docs.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    raw = Counter(b for g in rows.values() for b in g)
    best = Counter(b for i, g in rows.items() if i in good for b in g)
    got = quality_rules.judged(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        g = rows[r["doc_id"]]
        want = shrunk(g, raw, best, Counter(g if r["doc_id"] in good else ())) if g else None
        assert r["llr"] == pytest.approx(want, abs=1e-9) and r["kept"] == (not r["base_failed"] and (want or 0) >= quality_rules.LEAST)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_verdict_depends_on_neither_size_nor_own_label(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    for shown in (0, 1):  # half of the labels are shown, the other half's rows are held out of the target
        rows = quality_rules.judged(docs, labels.where(F.expr(f"doc_id % 2 = {shown}"))).join(labels, "doc_id").where("NOT base_failed").collect()
        for part in (0, 1):
            good = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0 and r["doc_id"] % 2 == part]
            assert len(good) > 10 and len(good) - sum(good) <= 0.1 * len(good)
        bad = [r["kept"] for r in rows if r["quality"] == 0]
        assert sum(bad) < 0.4 * len(bad)


def test_only_trusted_document_gives_no_ratio(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    (row,) = quality_rules.judged(docs, labels).collect()
    assert row["llr"] == 0 and row["kept"]


def test_rules_keep_their_columns(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"llr": F.lit("mine"), "kept": F.lit(1), "_words": F.lit("w"), "_own_0": F.lit("o")})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_rules.keep(df, labels)
    assert out.columns == df.columns and 0 < out.count() < df.count() and {tuple(r) for r in out.select("llr", "_words", "_own_0").collect()} == {("mine", "w", "o")}
    assert quality_rules.keep(df.where("false"), labels).count() == 0
    whole = quality_rules.judged(df, labels)
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "_words", "_own_0", *quality_rules.RESULTS] and dict(whole.dtypes)["kept"] == "boolean"
    assert quality_rules.judged(df.where("false"), labels).count() == 0


def test_language_is_learned_and_held_out(spark):
    rows = queries()["op8_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = rows.join(truth, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_language_of_odd_texts(spark):
    model = langid.fit(["the cat and the dog", "der hund und die katze"] * 20, ["en", "de"] * 20)
    assert langid.predict(model, "the dog")[0] == "en" and langid.predict(model, "die katze")[0] == "de"
    assert [langid.predict(model, t) for t in (None, "", "12 34!")] == [("und", 0.0)] * 3 and langid.predict(None, "x") == ("und", 0.0)
    assert (model["weights"] == 0).mean() > 0.5 and langid.fit([], []) is None
    df = spark.createDataFrame([(1, None, "x"), (2, "the", "x")], "doc_id long, text string, score string")
    assert langid.identify(df, None).select("lang_pred").distinct().collect()[0][0] == "und"


def test_ftrl_matches_step_by_step(monkeypatch):
    """The weights against follow-the-regularised-leader written out coordinate by coordinate."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(3, 30))) + "x" for _ in range(40)]
    langs = [rng.choice(["de", "en", "fr"]) for _ in texts]
    model = langid.fit(texts, langs)
    names, rows = sorted(set(langs)), [langid.features(t) for t in texts]
    df = Counter(i for at, _ in rows for i in at.tolist())
    idf = {i: math.log((1 + len(rows)) / (1 + n)) + 1 for i, n in df.items()}
    data = []
    for (at, counts), lang in zip(rows, langs, strict=True):
        x = {i: (1 + math.log(c)) * idf[i] for i, c in zip(at.tolist(), counts.tolist(), strict=True)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        data.append(({i: v / norm for i, v in x.items()} | {langid.DIMS: 1.0}, names.index(lang)))
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        v = z[i, k]
        return 0.0 if abs(v) <= langid.L1 else -(v - math.copysign(langid.L1, v)) / ((langid.BETA + math.sqrt(n[i, k])) / langid.RATE + langid.L2)

    seen, order = [d for i, d in enumerate(data) if i % 5], np.random.default_rng(0)
    for _ in range(langid.EPOCHS):
        for j in order.permutation(len(seen)):
            x, y = seen[j]
            w = {(i, k): weight(i, k) for i in x for k in range(3)}
            e = [math.exp(sum(v * w[i, k] for i, v in x.items())) for k in range(3)]
            for i, v in x.items():
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / langid.RATE * w[i, k]
                    n[i, k] += g * g
    want = np.array([[weight(i, k) for k in range(3)] for i in range(langid.DIMS + 1)])
    assert np.allclose(model["weights"], want[:-1], atol=1e-9) and np.allclose(model["bias"], want[-1], atol=1e-9)


def test_temperature_is_the_best_and_inside_its_grid():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(200, 3)) * 4
    labels = [int(np.argmax(z / 3 + rng.gumbel(size=3))) for z in logits]  # drawn at temperature 3
    assert 2 < langid.temperature(list(logits), labels) < 4.5
    apart = [np.array([9.0, 0.0]) if i % 2 else np.array([0.0, 9.0]) for i in range(100)]
    t = langid.temperature(apart, [1 - i % 2 for i in range(100)])
    assert abs(1 / (1 + math.exp(-9 / t)) - 101 / 102) < 0.002 and langid.temperature([], []) == 1.0


def test_scores_are_calibrated_on_noisy_labels(spark):
    rng = random.Random(6)
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"] and r["lang"]]
    noisy = [(t, rng.choice(["en", "de", "fr", "es"]) if rng.random() < 0.3 else lang) for t, lang in rows]
    model = langid.fit(*map(list, zip(*noisy[::2], strict=True)))
    got = [(langid.predict(model, t), lang) for t, lang in noisy[1::2]]
    right, score = sum(p[0] == lang for p, lang in got) / len(got), sum(p[1] for p, _ in got) / len(got)
    assert 0.65 < right < 0.9 and abs(right - score) < 0.08


def test_identify_replaces_its_columns(spark):
    model = langid.fit(["the cat and the dog", "der hund und die katze"] * 20, ["en", "de"] * 20)
    df = spark.createDataFrame([(1, "the " * 100_000, "x", 2, 3)], "doc_id long, text string, lang_pred string, SCORE int, `a.b` int")
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "a.b", "lang_pred", "score"] and out.first()["lang_pred"] == "en"
    assert langid.identify(df.where("false"), model).count() == 0 and langid.train(df.where("false").withColumn("lang", F.lit("x"))) is None


def test_quality_classifier_separates(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), "doc_id")
    half = labels.where("doc_id % 2 = 0")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_model.classify(docs, half.select("doc_id", "quality")).join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got) > 0.95


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [("big", "big/a", -6.0)] * 300 + [("small", "small/a", -6.0)] + [("good", "good/a", 6.0)] * 300 + [("big", "big/new", 6.0)]
    rates = {r["path"]: r["prior"] for r in quality_model.site_rates(spark.createDataFrame(rows, "host string, path string, evidence double"), 0.8).collect()}
    assert rates["big/a"] < 0.1 and rates["good/a"] > 0.9 and rates["big/a"] < rates["small/a"] < 0.8 and rates["big/a"] < rates["big/new"]


def brute_priors(rows, rate):
    """Shrunk rates of the paths of (host, path, evidence) rows, written out."""
    logit = math.log(rate / (1 - rate))
    good, n = defaultdict(float), Counter()
    for host, path, e in rows:
        for key in (host, (host, path)):
            good[key] += 1 / (1 + math.exp(-(e + logit)))
            n[key] += 1

    def strength(keys, mean):
        total, mm = sum(n[k] for k in keys), sum(n[k] * mean(k) * (1 - mean(k)) for k in keys)
        beyond = sum(n[k] * (good[k] / n[k] - mean(k)) ** 2 for k in keys) - sum(mean(k) * (1 - mean(k)) for k in keys)
        return min(1e4, max(1.0, mm / total / max(1e-9, beyond / total) - 1))

    hosts, paths = [k for k in n if isinstance(k, str)], [k for k in n if isinstance(k, tuple)]
    kh = strength(hosts, lambda k: rate)
    host_rate = {k: (good[k] + kh * rate) / (n[k] + kh) for k in hosts}
    kp = strength(paths, lambda k: host_rate[k[0]])
    return {k: (good[k] + kp * host_rate[k[0]]) / (n[k] + kp) for k in paths}


def test_shrinkage_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"h{h}", f"h{h}/p{p}", rng.gauss(1 - h + p / 2, 2)) for h in range(5) for p in range(4) for _ in range(rng.randint(1, 30))]
    got = {(r["host"], r["path"]): r["prior"] for r in quality_model.site_rates(spark.createDataFrame(rows, "host string, path string, evidence double"), 0.7).collect()}
    want = brute_priors(rows, 0.7)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_posteriors_match_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, labels)
    base = math.log(model["rate"] / (1 - model["rate"]))
    rows = {r["doc_id"]: r for r in docs.collect()}
    evidence = {i: float(model["w"][at] @ x) - base for i, r in rows.items() for at, x in quality_model.features([r["text"] or ""])}
    site = {i: (r["source"] or "", f"{r['source'] or ''}/{r['lang'] or ''}") for i, r in rows.items()}
    priors = brute_priors([(*site[i], e) for i, e in evidence.items()], model["rate"])
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        p = priors[site[r["doc_id"]]]
        z = evidence[r["doc_id"]] + math.log(p / (1 - p))
        assert abs(r["evidence"] - evidence[r["doc_id"]]) < 1e-6 and abs(r["posterior"] - 1 / (1 + math.exp(-z))) < 1e-6 and r["kept"] == (r["posterior"] >= 0.5)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {r["doc_id"] for r in quality_model.keep(docs, labels).collect()} == kept == {r["doc_id"] for r in quality_model.keep(docs, labels, bound=0).collect()}


def test_features_are_written_out():
    text = "one two one two é\nlast"
    (at, x), (none, y) = quality_model.features([text, ""])
    assert at[-quality_model.SHAPE - 1 :].tolist() == list(range(quality_model.DIMS, quality_model.DIMS + quality_model.SHAPE + 1)) and x[-1] == 1
    grams = x[: -quality_model.SHAPE - 1]
    assert abs(grams @ grams - 1) < 1e-9 and len(none) == quality_model.SHAPE + 1 and y[-1] == 1
    # equal texts have equal features wherever they stand in a batch
    again = quality_model.features(["x y z", "", text])[2]
    assert np.array_equal(at, again[0]) and np.array_equal(x, again[1])


def test_fit_is_written_out(monkeypatch):
    """AdaGrad steps on dense vectors, one row after the other in the same order, the constant without penalty."""
    monkeypatch.setattr(quality_model, "UPDATES", 60)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["good", "fine", "text", "bad", "spam", "word"], weights=[3, 3, 2, 1, 1, 2] if i % 2 else [1, 1, 2, 3, 3, 2], k=15)) for i in range(14)]
    y = np.array([float(i % 2) for i in range(14)])
    n = quality_model.DIMS + quality_model.SHAPE + 1
    dense, has = np.zeros((14, n)), np.zeros((14, n), bool)
    for i, (at, x) in enumerate(quality_model.features(texts)):
        dense[i, at], has[i, at] = x.astype(np.float32), True
    w, past, order = np.zeros(n), np.full(n, 1e-6), np.random.default_rng(0)
    for _ in range(max(quality_model.EPOCHS, 60 // 14)):
        for i in order.permutation(14):
            rate = 1 / (1 + math.exp(-float(w @ dense[i])))
            g = (rate - y[i]) * dense[i] + np.where(has[i] & (np.arange(n) < n - 1), quality_model.RIDGE * w, 0)
            past += g * g
            w -= quality_model.RATE * g / np.sqrt(past)
    got = quality_model.fit(quality_model._packed(texts), y)
    assert got["rate"] == 0.5 and np.allclose(got["w"], w, atol=1e-6) and np.abs(w).max() > 0.1


def test_repeated_labelled_ids_are_learned_once(spark):
    rows = [(i, f"word{i % 7} good text {i}") for i in range(40)] + [(i, "$$ ## %% junk " * 3) for i in range(40, 60)]
    docs = spark.createDataFrame(rows + [(40, "zz")] * 50 + [(41, "$$ ## %% junk " * 3)] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)], "doc_id long, quality int")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    model = quality_model.train(docs, labels)
    assert model["rate"] == pytest.approx(40 / 60)
    quality_model.keep(docs.withColumns({"source": F.lit("s"), "lang": F.lit("l")}), labels).count()
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("bound", [100_000, 0])
def test_evidence_is_worked_out_in_one_place_of_a_plan(spark, bound):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality_model.keep(docs, labels, bound=bound)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_levels_are_named_where_they_are_described():
    assert "source stands in for the host and lang for the path" in " ".join(quality_model.__doc__.split())


def test_quality_classifier_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, "", "s", "en"), (2, "x " * 50_000, None, "en")], "doc_id long, text string, source string, lang string").withColumn("prior", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["kept"] for r in quality_model.classify(df, none).collect()] == [True] * 3
    assert quality_model.keep(df, none).columns == df.columns and quality_model.keep(df, none).count() == 3
    assert quality_model.classify(df.where("false"), none).count() == 0


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    sizes = []
    for name, stage in P.STAGES:
        out = stage(spark, seen, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
            sizes.append(out.count())
        seen = out
    whole = P.run(spark, SF)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, seen.collect())) == sorted(map(key, whole.collect()))
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < docs.count()
    assert whole.select("doc_id").distinct().count() == sizes[-1]


def test_stages_with_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, clashing columns and no rows pass through every stage."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-2, None, None, "s", None)] + [(-3, "w " * 50_000, "en", "s", 1)] * 2, docs.schema)
    clash = ["digest", "_digest", "_keep", "kept", "n", "host", "_host", "prior", "evidence", "llr", "_own_0", "class_id", "bands", "k", "t"]
    for table in (docs.unionByName(odd).withColumns({c: F.lit(c) for c in clash}), docs.where("false")):
        seen = table
        for name, stage in P.STAGES:
            out = stage(spark, seen, SF)
            path = str(tmp_path / f"{name}{len(table.columns)}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
            if name != "packing":
                assert out.columns == table.columns and out.count() <= seen.count()
                assert name == "packing" or not out.count() or {tuple(r) for r in out.select(*table.columns[5:]).distinct().collect()} == {tuple(table.columns[5:])}
            seen = out
