"""Small cases of the operators that have no SQL, and of special rules."""

import itertools
import math
import random

import numpy as np
import pytest

from leverframe.codebook import FACTORS
from leverframe.functions.textsim import bleu, lcs_length, questions_scored, report, rouge
from leverframe.operators import effects as E
from leverframe.operators import information as I
from leverframe.operators import models as M
from leverframe.operators import retrieval as R
from leverframe.operators import studies as S
from leverframe.operators import trials as D
from leverframe.sources.files import parse_records, read_csv, read_lines, write_csv
from pyspark.sql import functions as F


def lcs_table(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_matches_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert lcs_length(a, b) == lcs_table(a, b)


def answers(spark, rows):
    """Rows of (id, type, answers, labels, entities, predicted answer, predicted label)."""
    refs = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in rows], "id long, question_type string, answers array<string>, yesno_answers array<string>, entity_answers array<array<string>>")
    preds = spark.createDataFrame([(r[0], [r[5]], [r[6]] if r[6] else []) for r in rows if r[5] is not None], "id long, answers array<string>, yesno_answers array<string>")
    return questions_scored(preds, refs)


def test_rouge_takes_best_precision_and_recall(spark):
    got = rouge(answers(spark, [(1, "DESCRIPTION", ["abcd", "c"], [], [], "abc", None), (2, "DESCRIPTION", ["x"], [], [], "", None), (3, "DESCRIPTION", [], [], [], "x", None)])).first()
    assert got["n_questions"] == 2 and abs(got["rouge_l"] - 0.5) < 1e-9  # precision 1 and recall 1, from two references


def test_bonuses_by_hand(spark):
    """The answer shares ab and b with a reference of its label, and the entity bc; the third one is not predicted."""
    rows = [(1, "YES_NO", ["ab", "bx"], ["Yes", "No"], [[]], "a b", "Yes"), (2, "ENTITY", ["bcd"], [], [["b c", "zz"], ["bc"]], "abc", None), (3, "YES_NO", ["q"], ["Yes"], [[]], None, None)]
    got = {r["id"]: r for r in answers(spark, rows).collect()}
    assert (got[1]["matched"], got[1]["total"], got[1]["bonus"]) == ([2, 1, 0, 0], [2, 1, 0, 0], [2.0, 1.0, 0.0, 0.0])
    assert (got[2]["matched"], got[2]["bonus"], got[2]["ref_len"]) == ([2, 1, 0, 0], [2.0, 1.0, 0.0, 0.0], 3)
    assert (got[3]["cand_len"], got[3]["ref_len"], got[3]["rouge"]) == (0, 1, 0.0)
    assert got[1]["rouge"] == pytest.approx(1.0)  # both with the bonus: 4 of 4
    p, r = (2 + 2) / (3 + 2), (2 + 2) / (3 + 2)
    assert got[2]["rouge"] == pytest.approx((1 + 1.44) * p * r / (r + 1.44 * p))
    whole = bleu(answers(spark, rows), bonus=True).first()
    p1, p2 = (4 + 4) / (5 + 4), (2 + 2) / (3 + 2)
    bp = math.exp(min(0.0, 1 - 6 / 5))
    assert whole["bleu_1"] == pytest.approx(p1 * bp) and whole["bleu_2"] == pytest.approx(math.sqrt(p1 * p2) * bp)


def test_report_is_in_percent(spark):
    got = report(answers(spark, [(i, "DESCRIPTION", ["abcdef"], [], [], "abcdeg", None) for i in range(3)])).first()
    assert got["rouge_l"] == 83.33 and got["bleu_4"] == round(100 * (5 / 6 * 4 / 5 * 3 / 4 * 2 / 3) ** 0.25, 2)


@pytest.mark.parametrize(("do", "ei"), [([0.0, 1.0], 1.0), ([0.5, 0.5], 0.0), ([0.2, 0.8, 0.5], None)])
def test_effective_information(spark, do, ei):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(do)], "factor string, level int, p double")
    got = I.effective_information(df).first()
    mix = sum(do) / len(do)
    kl = lambda p, q: sum(a * math.log2(a / b) for a, b in ((p, q), (1 - p, 1 - q)) if a > 0)
    want = sum(kl(p, mix) for p in do) / len(do)
    assert abs(got["EI"] - want) < 1e-9 and (ei is None or abs(want - ei) < 1e-9)
    assert abs(got["EI"] - (got["determinism"] - got["degeneracy"])) < 1e-9


def test_single_level_has_no_information(spark):
    assert I.effective_information(spark.createDataFrame([("f", 0, 0.5)], "factor string, level int, p double")).count() == 0


#: Trials and selections of each (query, level of S2): a three-valued confounder that raises both the level and the rate.
CELLS = {("a", 0): (60, 6), ("a", 1): (20, 6), ("b", 0): (30, 9), ("b", 1): (30, 18), ("c", 0): (10, 6), ("c", 1): (50, 40)}


def cells(spark):
    rows = [(q, x, int(i < k)) for (q, x), (n, k) in CELLS.items() for i in range(n)]
    return spark.createDataFrame(rows, "query_id string, S2 int, y int")


def test_stratification_is_the_g_formula(spark):
    """By hand: 0.4 x 0.1 + 0.3 x 0.3 + 0.3 x 0.6 at level 0, 0.4 x 0.3 + 0.3 x 0.6 + 0.3 x 0.8 at level 1; the plain rates are 0.21 and 0.64."""
    df = cells(spark)
    weight = {q: sum(n for (r, _), (n, _) in CELLS.items() if r == q) / 200 for q in "abc"}
    want = {x: sum(weight[q] * CELLS[q, x][1] / CELLS[q, x][0] for q in "abc") for x in (0, 1)}
    assert want == {0: pytest.approx(0.31), 1: pytest.approx(0.54)}
    assert {r["level"]: r["p"] for r in I.stratified_do(df, "S2", ["query_id"]).collect()} == {x: pytest.approx(p) for x, p in want.items()}
    plain = {r["level"]: r["p"] for r in I.stratified_do(df, "S2", []).collect()}
    assert plain == {0: pytest.approx(0.21), 1: pytest.approx(0.64)}


def test_gcomp_averages_the_fitted_rates(spark):
    """Against the same model fitted by plain gradient ascent on the six cells."""
    df = cells(spark)
    beta = {"x": 0.0, "a": 0.0, "b": 0.0, "c": 0.0}
    rate = lambda q, x: 1 / (1 + math.exp(-(beta[q] + beta["x"] * x)))
    for _ in range(20_000):
        for q in "abc":
            beta[q] += 0.02 * sum(k - n * rate(r, x) for (r, x), (n, k) in CELLS.items() if r == q)
        beta["x"] += 0.02 * sum(x * (k - n * rate(q, x)) for (q, x), (n, k) in CELLS.items())
    for row in M.gcomp(df, "S2", "query_id", [0, 1]).collect():
        want = sum(n * rate(q, row["level"]) for (q, _), (n, _) in CELLS.items()) / 200
        assert row["p"] == pytest.approx(want, abs=1e-5)


def test_saturated_logit_is_the_cells_log_odds(spark):
    got = {r["term"]: r for r in M.logit_with_clusters(cells(spark), ["S2"], position=None).collect()}
    logit = lambda p: math.log(p / (1 - p))
    assert got["Intercept"]["coef"] == pytest.approx(logit(0.21)) and got["S2"]["coef"] == pytest.approx(logit(0.64) - logit(0.21))
    # the sandwich by hand: scores of each query summed before they are squared
    x = np.array([[1.0, lv] for (_, lv), (n, _) in CELLS.items() for _ in range(n)])
    y = np.array([float(i < k) for (n, k) in CELLS.values() for i in range(n)])
    g = np.array([q for (q, _), (n, _) in CELLS.items() for _ in range(n)])
    p = np.where(x[:, 1] == 1, 0.64, 0.21)
    bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    sums = np.array([((y - p)[:, None] * x)[g == q].sum(axis=0) for q in "abc"])
    cov = bread @ sums.T @ sums @ bread * (3 / 2) * (199 / 198)
    assert [got[t]["se"] for t in ("Intercept", "S2")] == [pytest.approx(v) for v in np.sqrt(np.diag(cov))]


def test_logit_interaction_and_separation(spark):
    df = cells(spark).withColumn("S3", F.when(F.col("query_id") == "c", 1).otherwise(0))
    got = {r["term"]: r["coef"] for r in M.logit_with_clusters(df, ["S2", "S3"], [("S2", "S3")], position=None).collect()}
    logit = lambda k, n: math.log(k / (n - k))
    want = logit(40, 50) - logit(6, 10) - (logit(24, 50) - logit(15, 90))
    assert got["S2:S3"] == pytest.approx(want, abs=1e-6)
    apart = spark.createDataFrame([(str(i % 4), i % 2, i % 2) for i in range(40)], "query_id string, S2 int, y int")
    rows = M.logit_with_clusters(apart, ["S2"], position=None).collect()
    assert {r["method"] for r in rows} == {"ridge(separation)"} and all(math.isnan(r["se"]) for r in rows) and rows[1]["coef"] > 1


def test_cluster_bootstrap_has_the_ratio_estimators_spread(spark):
    """Against the linearised variance of a ratio of sums over clusters."""
    rng = np.random.default_rng(5)
    n = rng.integers(1, 6, 400)
    total = n * 0.3 + rng.normal(0, 1, 400)
    sums = spark.createDataFrame([("S1", f"q{i}", float(t), int(k)) for i, (t, k) in enumerate(zip(total, n, strict=True))], "factor string, query_id string, sum_diff double, n_pairs long")
    got = E.cluster_bootstrap(sums).first()
    mean = total.sum() / n.sum()
    se = math.sqrt(((total - mean * n) ** 2).sum()) / n.sum()
    assert got["ATE"] == pytest.approx(mean) and got["n_pairs"] == n.sum()
    assert got["ci_low"] == pytest.approx(mean - 1.96 * se, abs=0.25 * se) and got["ci_high"] == pytest.approx(mean + 1.96 * se, abs=0.25 * se)


def test_poisson_draws_have_mean_and_variance_one(spark):
    got = spark.range(20_000).select(E.poisson(F.col("id").cast("string")).alias("w")).agg(F.avg("w").alias("m"), F.variance("w").alias("v")).first()
    assert abs(got["m"] - 1) < 0.03 and abs(got["v"] - 1) < 0.05


def test_pair_bootstrap_has_the_means_spread(spark):
    rng = np.random.default_rng(6)
    rows = [("f", f"p{i}", lv, 1, int(rng.random() < (0.7 if lv else 0.4))) for i in range(600) for lv in (0, 1)]
    df = spark.createDataFrame(rows, "factor string, pair_key string, level int, top int, y int")
    diffs = np.array([rows[2 * i + 1][4] - rows[2 * i][4] for i in range(600)])
    got, se = E.pair_bootstrap(df).first(), diffs.std() / math.sqrt(600)
    assert got["ATE"] == pytest.approx(diffs.mean())
    assert got["ci_low"] == pytest.approx(diffs.mean() - 1.96 * se, abs=0.3 * se) and got["ci_high"] == pytest.approx(diffs.mean() + 1.96 * se, abs=0.3 * se)


def test_one_pass_adjustment_is_the_factor_by_factor_one(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), *[rng.choice([0, 1, None, 1, 0]) for _ in range(8)], rng.choice([0, 1, 1, None])) for _ in range(600)]
    df = spark.createDataFrame(rows, "query_id string, S1 int, S2 int, S3 int, S4 int, O1 int, O2 int, O3 int, O4 int, y int")
    got = {(r["factor"], r["level"]): r["p"] for r in I.backdoor_do(df).collect()}
    want = {(r["factor"], r["level"]): r["p"] for f in ("S1", "S3", "O2", "O4") for r in I.stratified_do(df, f).collect()}
    assert all(got[k] == pytest.approx(p) for k, p in want.items()) and {f for f, _ in got} == set(FACTORS)


def test_adjustment_dispatch(spark):
    df = cells(spark)
    by = lambda d: {r["level"]: pytest.approx(r["p"]) for r in d.collect()}
    assert by(I.backdoor_adjust(df, "S2", "stratify")) == by(I.stratified_do(df, "S2", ["query_id"]))
    assert by(I.backdoor_adjust(df, "S2")) == by(M.gcomp(df, "S2", "query_id", [0, 1]))
    assert by(I.backdoor_adjust(df, "S2", adjustment=["weather"])) == by(I.stratified_do(df, "S2", []))
    with pytest.raises(ValueError, match="no such method"):
        I.backdoor_adjust(df, "S2", "magic")
    apart = df.withColumn("y", F.col("S2"))  # no finite fit: stratification takes over
    assert by(I.backdoor_adjust(apart, "S2")) == by(I.stratified_do(apart, "S2", ["query_id"])) == {0: 0.0, 1: 1.0}


def dense_gcomp(x, y, n_levels, steps=60):
    """Newton steps on all columns at once; x: level dummies first."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.clip(np.linalg.lstsq((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu), rcond=None)[0], -3, 3)
    out = []
    for v in range(n_levels):
        z = x.copy()
        z[:, : n_levels - 1] = 0
        if v:
            z[:, v - 1] = 1
        out.append((1 / (1 + np.exp(-z @ beta))).mean())
    return out


def test_gcomp_of_many_categories_numbers_and_two_text_columns(spark):
    """Against a dense fit: 60 groups, some of them all or none, a number and a second text column."""
    rng = np.random.default_rng(12)
    rows = [(f"q{g}", int(rng.integers(0, 3)), float(rng.integers(0, 3)), "abc"[rng.integers(0, 3)]) for g in range(60) for _ in range(12)]
    lift = {f"q{g}": rng.normal() for g in range(60)}
    p = [1 / (1 + np.exp(-(lift[q] + 0.7 * t - 0.4 * z + {"a": 0, "b": 0.5, "c": -0.5}[c]))) for q, t, z, c in rows]
    y = [0 if q in ("q0", "q1") else 1 if q == "q2" else int(rng.random() < r) for (q, *_), r in zip(rows, p, strict=True)]
    df = spark.createDataFrame([(*r, v) for r, v in zip(rows, y, strict=True)], "query_id string, S1 int, z double, c string, y int")
    x = np.column_stack([[float(r[1] == v) for r in rows] for v in (1, 2)] + [[r[2] for r in rows]] + [[float(r[3] == c) for r in rows] for c in "bc"] + [[float(r[0] == f"q{g}") for r in rows] for g in range(60)])
    got = {r["level"]: r["p"] for r in M.gcomp(df, "S1", ["query_id", "z", "c"], [0, 1, 2]).collect()}
    assert [got[v] for v in range(3)] == pytest.approx(dense_gcomp(x, np.array(y, float), 3), abs=1e-6)
    numbers = {r["level"]: r["p"] for r in I.backdoor_adjust(df, "S1", adjustment=["z", "S1", "weather"]).collect()}
    assert [numbers[v] for v in range(3)] == pytest.approx(dense_gcomp(np.column_stack([x[:, :3], np.ones(len(y))]), np.array(y, float), 3), abs=1e-6)


@pytest.mark.parametrize("sd", [0.0, 1.2])
def test_mixed_logit_finds_the_groups_deviation(spark, sd):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(300):
        u = sd * rng.normal()
        rows += [(f"q{g}", int(i % 2), int(rng.random() < 1 / (1 + np.exp(-(-0.5 + 0.8 * (i % 2) + u))))) for i in range(30)]
    got = {r["term"]: r for r in M.mixed_logit(spark.createDataFrame(rows, "query_id string, S2 int, y int"), ["S2"]).collect()}
    assert got["S2"]["coef"] == pytest.approx(0.8, abs=0.12) and {r["method"] for r in got.values()} == {"group_intercepts"}
    assert got["S2"]["group_sd"] == pytest.approx(sd, abs=0.15)


def test_slope_is_the_logits(spark):
    """Two places saturate the model: the slope is the difference of the log odds."""
    df = spark.createDataFrame([(p, int(i < k)) for p, n, k in ((0, 50, 30), (1, 40, 10)) for i in range(n)], "target_position int, y int")
    assert M.slope(df) == pytest.approx(math.log(10 / 30) - math.log(30 / 20))
    assert math.isnan(M.slope(df.where("y = 1")))


def test_interaction_with_categories_is_saturated(spark):
    df = cells(spark)
    got = {r["term"]: r["coef"] for r in M.interaction_test(df, "S2", "query_id", cluster="query_id").collect()}
    odds = {k: math.log(s / (n - s)) for k, (n, s) in CELLS.items()}
    assert got["S2"] == pytest.approx(odds["a", 1] - odds["a", 0], abs=1e-6)
    assert got["S2:query_id[c]"] == pytest.approx(odds["c", 1] - odds["c", 0] - odds["a", 1] + odds["a", 0], abs=1e-6)


def test_mixed_logit_lies_between_pooled_and_separate(spark):
    """With a tight prior the groups' intercepts vanish, with a wide one they are free."""
    df = cells(spark)
    coef = lambda d: {r["term"]: r["coef"] for r in d.collect()}["S2"]
    pooled = coef(M.logit_with_clusters(df, ["S2"], position=None))
    free = coef(M.logit_with_clusters(df.withColumns({"b": (F.col("query_id") == "b").cast("int"), "c": (F.col("query_id") == "c").cast("int")}), ["S2", "b", "c"], position=None))
    tight, wide, mid = (coef(M.mixed_logit(df, ["S2"], prior=p)) for p in (0.001, 100.0, 1.0))
    assert tight == pytest.approx(pooled, abs=1e-3) and wide == pytest.approx(free, abs=1e-3) and free < mid < pooled
    apart = spark.createDataFrame([(str(i % 4), i % 2, i % 2) for i in range(40)], "query_id string, S2 int, y int")
    assert {r["method"] for r in M.mixed_logit(apart, ["S2"]).collect()} == {"fallback:ridge(separation)"}


def test_power_closed_form(spark):
    df = spark.createDataFrame([(0.2, 0.2727272727), (0.5, 0.45), (0.5, 0.5), (None, 0.5)], "p1 double, p2 double")
    sized = df.withColumn("n", F.when(F.col("p1") != F.col("p2"), D.n_for_power(F.col("p1"), F.col("p2"))).otherwise(100))
    got = [r["power"] for r in M.power_table(sized).collect()]
    assert 0.8 <= got[0] < 0.802 and 0.8 <= got[1] < 0.802 and got[2] == pytest.approx(0.025, abs=1e-6) and got[3] is None


def test_average_linkage_keeps_close_models_together():
    x = np.array([[1, 2, 3, 4.0], [4, 3, 2, 1.0], [1.1, 2, 3, 4.2], [4, 3.1, 2, 0.9]])
    order = I.average_linkage(x)
    assert sorted(order) == [0, 1, 2, 3] and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    assert sorted(I.average_linkage(np.zeros((3, 4)))) == [0, 1, 2]


def test_normalized_arrays(spark):
    df = spark.createDataFrame([([1.0, 3.0, -2.0],), ([-1.0, 0.0],)], "p array<double>")
    assert [r[0] for r in df.select(I.normalized(F.col("p"))).collect()] == [[0.25, 0.75, 0.0], [0.5, 0.5]]


def test_assembled_articles_show_their_levels(spark):
    """Every point of the full factorial is detected as it was asked for."""
    from leverframe.functions.text import detect_profile

    q = spark.createDataFrame([("q1", "health", "Than heor onera"), ("q2", "travel", "Et laou")], "query_id string, domain string, core string")
    points = D.full_factorial(spark, ["S1", "S2", "S3", "S4"]).unionByName(D.fractional_design(spark)).unionByName(D.full_factorial(spark, ["O1", "O2", "O3", "O4"]))
    points = points.select(F.lit("x").alias("label"), F.lit("point").alias("role"), F.lit(None).cast("string").alias("target_dim"), F.lit("fake").alias("authenticity"), *FACTORS)
    for authenticity in ("fake", "genuine"):
        rows = S.build_targets(q, points.withColumn("authenticity", F.lit(authenticity))).withColumn("p", detect_profile(F.col("text"))).collect()
        assert len(rows) == 2 * points.count() and all([r["p"][f] for f in FACTORS] == [r[f] for f in FACTORS] for r in rows)


def test_distractors_fill_up_what_passages_lack(spark):
    q = spark.createDataFrame([("q1", "d", "one"), ("q2", "d", "two")], "query_id string, domain string, core string")
    passages = spark.createDataFrame([("q1", f"passage {i}") for i in range(6)] + [("q2", "only one")], "query_id string, text string")
    rows = S.distractor_pool(q, 4, passages).collect()
    real = {k: sum(r["text"].startswith(("passage", "only")) for r in rows if r["query_id"] == k) for k in ("q1", "q2")}
    assert real == {"q1": 4, "q2": 1} and len(rows) == 8 and len({r["article_id"] for r in rows}) == 8


def test_studies_five_and_six(spark):
    """Their tables against the frames that they come from."""
    words = [f"w{i}" for i in range(60)]
    rng = random.Random(2)
    corpus = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([(f"q{i}", "health", f"w{i} w{i + 7}") for i in range(4)], "query_id string, domain string, core string")
    found, frame, tables = S.run_study5(q, corpus, ["m"], k=4)
    assert found.count() == 64 and frame.count() == 64 * 4
    e2e = {r["factor"]: r for r in tables["e2e"].collect()}
    rows, trials = found.collect(), frame.collect()
    rate = lambda rs, y, f, role: np.mean([r[y] for r in rs if r["target_dim"] == f and r["role"] == role])
    assert len(e2e) == 8 and all(e2e[f]["P_e2e_treated"] == pytest.approx(rate(rows, "retrieved", f, "treatment") * rate(trials, "y", f, "treatment")) for f in e2e)
    rewrites = q.selectExpr("query_id", "array(core, ' ', concat(core, ' w3')) AS texts").where("query_id <> 'q3'")
    found6, frame6, tables6 = S.run_study6(q, corpus, rewrites, ["m"], k=4)
    rows6, trials6 = {r["article_id"]: r for r in found6.collect()}, frame6.collect()
    assert len(rows6) == 64 and tables6["ate_e2e"].count() == 8
    assert all(t["y"] == 0 for t in trials6 if not rows6[t["target_id"]]["retrieved"]) and any(t["y"] for t in trials6)
    assert all((t["target_position"] >= 0) == bool(rows6[t["target_id"]]["retrieved"]) for t in trials6)


def test_single_rewrite_is_plain_retrieval_and_ties_favour_the_target(spark):
    docs = spark.createDataFrame([(0, "a b c"), (1, "a b c"), (2, "x y"), (3, "z a d e f g")], "doc_id long, text string")
    queries = spark.createDataFrame([(5, "a b", None)], "query_id long, text string, embedding array<float>")
    targets = spark.createDataFrame([(9, [5], "a b c", None), (10, [5], "", None)], "target_id long, query_ids array<long>, text string, embedding array<float>")
    index = R.Index(docs)
    plain = {r["target_id"]: r for r in R.search(index, queries.drop("embedding"), targets.drop("embedding"), k=2).collect()}
    assert plain[9]["target_rank"] == 0 and plain[9]["top_k_ids"] == ["0", "1"] and plain[10]["target_rank"] == 3 and plain[10]["retrieved"] == 0
    one = "array<struct<query_id:bigint,text:string,embedding:array<float>>>"
    rewritten = targets.select("target_id", "text", "embedding", F.when(F.col("target_id") == 9, F.array(F.struct(F.lit(5).cast("long").alias("query_id"), F.lit("a b").alias("text"), F.lit(None).cast("array<float>").alias("embedding")), F.struct(F.lit(6).cast("long").alias("query_id"), F.lit("  ").alias("text"), F.lit(None).cast("array<float>").alias("embedding")))).otherwise(F.array().cast(one)).alias("rewrites"))
    asked, own = R.queries_of_targets(rewritten)
    multi = {r["target_id"]: r for r in R.search(index, asked.select("query_id", "text"), own.drop("embedding"), k=2, pool="mean").collect()}
    assert multi[9]["target_rank"] == plain[9]["target_rank"] and multi[9]["top_k_ids"] == plain[9]["top_k_ids"]
    assert {r["query_id"]: r["text"] for r in asked.collect()} == {5: "a b", -11: ""}
    with pytest.raises(ValueError, match="no such mode"):
        R.search(index, queries, targets, mode="sparse")


def test_tokens_agree_with_their_python_form(spark):
    texts = ["a  b\tc", "中文 分词x y", "字", "", None, "mixed中"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert {r["i"]: r["w"] for r in df.select("i", R.tokens(F.col("t")).alias("w")).collect()} == {i: R.words_of(t) for i, t in enumerate(texts)}


def test_parsing_of_scores_and_ranking(spark):
    replies = ['x {"choice": "b", "scores": {"A": 1, "b": "2.5", "C": null, "Z": 1}, "ranking": ["B", "A", "B", "?"]} y', '{"cited": ["A", "q", "a"]}', '{"cited": ["q"]}', '{"cited": []}', "none", '{"choice": ""}']
    df = spark.createDataFrame([(i, r, ["k1", "k2", "k3"]) for i, r in enumerate(replies)], "i long, r string, ids array<string>").withColumn("o", D.extract_json(F.col("r")))
    got = {r["i"]: r["d"] for r in df.select("i", D.parse_decision(F.col("o"), F.col("ids")).alias("d")).collect()}
    assert (got[0]["chosen_ids"], got[0]["scores"], got[0]["ranks"], got[0]["parse_ok"]) == (["k2"], {"k1": 1.0, "k2": 2.5}, {"k2": 2, "k1": 1}, True)
    assert [(got[i]["chosen_ids"], got[i]["parse_ok"]) for i in range(1, 6)] == [(["k1"], True), ([], False), ([], True), ([], False), ([], False)]


def test_permutations_and_designs(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "ids array<string>")
    assert sorted(df.select(D.permutations(F.col("ids"))).first()[0]) == sorted(map(list, itertools.permutations("abc")))
    assert len({tuple(p) for p in df.select(D.permutations(F.col("ids"), 4)).first()[0]}) == 4
    assert D.fractional_design(spark, ["S1", "S2", "O1"]).count() == 8 and D.fractional_design(spark, n_points=20).distinct().count() == 20
    assert D.fractional_design(spark, ["S1", "S2"]).agg({"O4": "max"}).first()[0] == 0


def test_records_of_both_schemas(spark):
    lines = ['{"k": 1, "question": "q", "documents": [{"paragraphs": ["a", "b"]}, {"paragraphs": null}], "passages": ["no"]}', '{"k": 2, "question": " q ", "passages": ["a", {"text": "b", "x": 1}]}', '{"k": 3, "question": "", "passages": ["a"]}', '{"k": 4, "question": "q", "documents": []}', "no json", '{"k": 5, "question": "q"}']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r["k"]: r["passages"] for r in parse_records(df, "k LONG").collect()} == {1: ["a", "b"], 2: ["a", "b"]}
    mixed = spark.createDataFrame([('[{"k": 1}, {"k": 2}]',), (' {"k": 3}',), ("{oops",), ("[]",)], "line string")
    assert sorted(r["k"] for r in read_lines(mixed, "k LONG").collect()) == [1, 2, 3]


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "f" / "model=m 1").mkdir(parents=True)
    (tmp_path / "f" / "model=m 1" / "x.csv").write_text("\ufeffa,b\n1,x\n", encoding="utf-8")
    assert read_csv(spark, str(tmp_path / "f"), "a STRING, b STRING, model STRING").collect() == [("1", "x", "m 1")]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, m string")
    write_csv(df, str(tmp_path / "g"), "m")
    assert sorted(read_csv(spark, str(tmp_path / "g"), "a STRING, m STRING").collect()) == [("1", "x"), ("2", "y")]


def test_paired_ate_needs_both_sides(spark):
    rows = [("f", "a", 0, 1, 0), ("f", "a", 1, 1, 1), ("f", "b", 1, 1, 1)]
    df = spark.createDataFrame(rows, "factor string, pair_key string, level int, top int, y int")
    both = E.ate_table(df).first()
    assert both["paired_ate"] == 1.0 and both["marginal_ate"] == 1.0
    got = E.paired_ate(df).first()
    assert (got["ATE"], got["n_pairs"], got["n_treated"], got["n_control"]) == (1.0, 1, 2, 1)


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"choice": "A"}', '{"choice": "A"}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('x {"a": 1} y {"b": {"c": "}"}} z', '{"b": {"c": "}"}}'), ("{{bad}}", None), ("", None), (None, None), ("[1]", None)],
)
def test_first_object(text, want):
    assert D.first_object(text) == want


def test_candidate_set_needs_two(spark):
    df = spark.createDataFrame([("q", "t", ["a"])], "query_id string, target_id string, competitors array<string>")
    with pytest.raises(ValueError):
        D.candidate_sets(df, 1)
    assert [r["ordered_ids"] for r in D.candidate_sets(df, 2).orderBy("target_position").collect()] == [["t", "a"], ["a", "t"]]
    with pytest.raises(Exception, match="too few competitors for a set: q"):
        D.candidate_sets(df, 3).collect()
    (one,) = D.candidate_sets(df, 2, all_positions=False).collect()
    assert one["ordered_ids"][one["target_position"]] == "t"


def test_fractional_design_is_balanced_and_orthogonal(spark):
    rows = [[v > 0 for v in r] for r in D.fractional_design(spark).collect()]
    a = np.array(rows) * 2 - 1
    assert (a.sum(axis=0) == 0).all() and np.array_equal(a.T @ a, 16 * np.eye(8))


def test_numbers_of_large_groups_and_null_groups(spark):
    from leverframe.operators.numbering import numbered

    rng = np.random.default_rng(3)
    rows = [(None if i % 7 == 0 else "big" if i % 7 < 5 else f"g{i % 3}", int(x), i) for i, x in enumerate(rng.integers(0, 20, 900))]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    for by in ([], ["g"]):
        got = {r["i"]: r["no"] for r in numbered(df, by, ["x", "i"], "no").collect()}
        want = {}
        for g in {r[0] for r in rows} if by else {0}:
            mine = sorted((x, i) for h, x, i in rows if not by or h == g)
            want |= {i: k for k, (_, i) in enumerate(mine, 1)}
        assert got == want
    assert numbered(df.where("false"), ["g"], ["i"], "no").count() == 0


def test_intermediate_tables_are_cleared(spark):
    from leverframe.sources.files import clear, exists, scratch, stored

    clear(spark)
    kept = stored(spark.range(3).toDF("x"), "some")
    other = scratch(spark, "never-written")
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert exists(spark, path) and clear(spark) == 2 and not exists(spark, path) and not exists(spark, other) and clear(spark) == 0


def test_answer_files_are_checked(spark, tmp_path):
    from leverframe.sources.files import read_answer_files, write_zipped_lines

    rows = spark.createDataFrame([(str(i), ["a b", "c"], None if i % 2 else ["Yes"]) for i in range(50)], "question_id string, answers array<string>, yesno_answers array<string>")
    path = str(tmp_path / "in")
    rows.where("question_id < 3").coalesce(1).write.json(path + "/plain")
    write_zipped_lines(rows.where("question_id >= 3").repartition(3), path + "/zipped")
    got = read_answer_files(spark, path)
    assert {r["question_id"]: (r["answers"], r["yesno_answers"]) for r in got.collect()} == {r["question_id"]: (r["answers"], r["yesno_answers"]) for r in rows.collect()} and got.columns[-1] == "source"
    (tmp_path / "in" / "more.json").write_text('{"question_id": "7", "answers": ["again"]}\n')
    with pytest.raises(Exception, match="comes twice: 7"):
        read_answer_files(spark, path).collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"question_id": "1"}\n{"answers": []}\n')
    with pytest.raises(Exception, match="no JSON object with a question_id"):
        read_answer_files(spark, str(tmp_path / "bad")).collect()


def test_sql_functions_agree_with_the_expressions(spark):
    from leverframe.functions.sql import register

    register(spark)
    df = spark.createDataFrame([([0.2, 0.8], [0.5, 0.5]), ([-1.0, 0.0], [1.0, 3.0]), ([1.0, 0.0, 3.0], [0.0, 2.0, 2.0])], "p array<double>, q array<double>")
    both = df.selectExpr("*", "entropy_of(p) AS h", "kl_bits(p, q) AS k").select("h", "k", I.entropy_of(F.col("p")).alias("h2"), I.kl_bits(F.col("p"), F.col("q")).alias("k2")).collect()
    assert all(r["h"] == pytest.approx(r["h2"]) and r["k"] == pytest.approx(r["k2"]) for r in both)
    ei = lambda p: spark.sql(f"SELECT effective_information(array({', '.join(f'{x}D' for x in p)})) AS e").first()["e"]
    assert ei([0.0, 1.0]) == pytest.approx(1.0) and ei([0.3, 0.3]) == pytest.approx(0.0) and ei([0.4]) is None
    assert [tuple(r) for r in spark.sql("SELECT * FROM explode_candidates(array('x', 'y'))").collect()] == [(0, "A", "x"), (1, "B", "y")]


def test_stopped_stream_goes_on(spark, tmp_path):
    """Files come in two lots with repeated keys; the run over the second has another column and lacks one; a new checkpoint adds nothing."""
    from leverframe.streaming.trials import run_incremental, stream_of

    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.createDataFrame([(i, i % 3, "2024-01-01 00:00:00", "x") for i in range(60)], "k long, v int, t string, extra string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    df.where("k < 40").drop("extra").repartition(2).write.parquet(src)
    first = stream_of(spark, src, "k LONG, v INT, t TIMESTAMP_NTZ", "t", files=1)

    def stop(d):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        run_incremental(first, stop, every_rows=10**6, keys=["k"], out=out, state=state)
    df.where("k >= 30").drop("v").repartition(2).write.mode("append").parquet(src)
    run_incremental(stream_of(spark, src, "k LONG, t TIMESTAMP_NTZ, extra STRING", "t", files=1), lambda d: None, keys=["k"], out=out, state=state)
    read = lambda: spark.read.option("basePath", out).parquet(out)
    rows = {r["k"]: r["v"] for r in read().collect()}
    assert read().count() == 60 and set(read().columns) == {"k", "v", "t", "run", "batch"}
    assert rows == {k: k % 3 if k < 40 else None for k in range(60)}
    seen = []
    run_incremental(stream_of(spark, src, "k LONG, v INT, t TIMESTAMP_NTZ", "t"), lambda d: seen.append(d.count()), keys=["k"], out=out, state=state + "-new")
    assert read().count() == 60 and seen == [60]


def test_chain_decides_once(spark, tmp_path):
    from leverframe.operators import prompts as P

    sets = spark.createDataFrame([("q", "b", 1, ["a", "b"]), ("q", "a", 0, ["a", "b"]), ("r", "c", 0, ["c", "a"])], "query_id string, target_id string, target_position int, ordered_ids array<string>")
    texts = spark.createDataFrame([("a", "plain"), ("b", "机构 12% 核心优势 但是 机制 (证据: x)"), ("c", "")], "id string, text string")
    questions = spark.createDataFrame([("q", 'why "so"?\n', "d"), ("r", "what", None)], "query_id string, question string, domain string")
    answers = P.Answers(spark, str(tmp_path / "answers"))
    got = {}
    for mode in P.MODES:
        requests = P.requests_of(sets, texts, questions, ["m", "n"], ["neutral", "persona"], (0, 1), mode)
        trials, decided = P.run_chain(answers, requests)
        assert decided == requests.select("request_hash").distinct().count() == 16  # the set of q is asked once for two targets
        again, none = P.run_chain(answers, requests)
        assert none == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, trials.collect()))
        got[mode] = {(r["query_id"], r["target_id"]): r for r in trials.where("model = 'm' AND prompt_style = 'neutral' AND seed = 0").collect()}
        assert all(r["parse_ok"] == 1 for r in got[mode].values())
    assert {k: r["y"] for k, r in got["minimal"].items()} == {("q", "b"): 1, ("q", "a"): 0, ("r", "c"): 1}
    assert got["full"]["q", "a"]["target_rank"] == 1 and got["full"]["q", "a"]["target_score"] == 40.0 and got["minimal"]["q", "a"]["target_rank"] == -1
    assert {k: r["n_chosen"] for k, r in got["cite"].items()} == {("q", "b"): 1, ("q", "a"): 1, ("r", "c"): 2}
    # an answer of another decider, stored beforehand, is what counts
    other = P.Answers(spark, str(tmp_path / "other"))
    requests = P.requests_of(sets, texts, questions, ["m"], mode="minimal")
    other.fill(requests.select("request_hash", F.lit('I say ```json\n{"choice": "B"}\n```').alias("reply")))
    trials, decided = P.run_chain(other, requests)
    assert decided == 0 and {(r["query_id"], r["target_id"]): r["y"] for r in trials.collect()} == {("q", "b"): 1, ("q", "a"): 0, ("r", "c"): 0}
    with pytest.raises(Exception, match="no such style"):
        P.requests_of(sets, texts, questions, ["m"], ["loud"]).collect()
    with pytest.raises(ValueError, match="no such mode"):
        P.requests_of(sets, texts, questions, ["m"], mode="loud")
    rewrites, n = P.rewritten(questions, answers, ["m"])
    assert n == 2 and {r["query_id"]: r["queries"] for r in rewrites.collect()} == {"q": ['why "so"?', "why", '"so"?'], "r": ["what"]}
    assert P.rewritten(questions, answers, ["m"])[1] == 0


def test_stream_refreshes(spark, tmp_path):
    from leverframe.streaming.trials import run_incremental, trial_stream

    src = str(tmp_path / "in")
    rows = [(i % 50, i % 3, f"2024-01-01 00:00:{i % 50:02d}") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, parse_ok int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    df.where("k < 20").coalesce(1).write.parquet(src)
    df.where("k >= 20").coalesce(1).write.mode("append").parquet(src)
    seen = []

    def refresh(d):
        seen.append(d.count())
        if len(seen) == 1:
            raise RuntimeError("logged, not raised")

    stream = lambda: trial_stream(spark, src, "k LONG, parse_ok INT, t TIMESTAMP_NTZ", ["k"], "t", files=1)
    path = run_incremental(stream(), refresh, every_rows=1)
    assert spark.read.parquet(path).count() == 50 and seen[-1] == 50 and len(seen) >= 3
    with pytest.raises(RuntimeError):
        run_incremental(stream(), lambda d: 1 / 0 if False else (_ for _ in ()).throw(RuntimeError("last")), every_rows=10**6)
    timed = []
    run_incremental(stream(), lambda d: timed.append(1), every_rows=10**6, every_seconds=0)
    assert len(timed) >= 3
    none = []
    run_incremental(stream(), lambda d: none.append(1), least_rows=10**6)
    assert not none
