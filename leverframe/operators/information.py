"""Do-distributions, Effective Information and agreement between models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leverframe.codebook import FACTORS, TOP, adjustment_set
from leverframe.operators.effects import marginal_ate, share, unpivot

TINY = 1e-12


def plogp(p: Column) -> Column:
    """p log2 p; 0 for (nearly) no probability."""
    return F.when(p > TINY, p * F.log2(p)).otherwise(0.0)


def entropy_bits(p: Column) -> Column:
    """Entropy of a yes/no outcome."""
    return -(plogp(p) + plogp(1 - p))


def experimental_do(long: DataFrame, by: Sequence[str] = ("factor",), y: str = "y") -> DataFrame:
    """P(Y=1 | X=level) of each level."""
    return long.where("level IS NOT NULL").groupBy(*by, "level").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("p"))


def stratified_do(df: DataFrame, treatment: str, adjustment: Sequence[str] | None = None, y: str = "y") -> DataFrame:
    """P(Y=1 | do(X=level)) by stratification: cell rates at the level, weighted by the cells' shares of all rows, over observed cells.

    Both aggregates come from one grouping by cell and level.
    """
    adj = list(adjustment_set(treatment) if adjustment is None else adjustment)
    if not adj:
        return experimental_do(df.select(F.lit(treatment).alias("factor"), F.col(treatment).alias("level"), y)).select("factor", "level", "p")
    cells = df.where(" AND ".join(f"{c} IS NOT NULL" for c in adj)).groupBy(*adj, F.col(treatment).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("p"))
    cells = cells.withColumn("w", F.sum("n").over(Window.partitionBy(*adj)))
    out = cells.where("level IS NOT NULL AND p IS NOT NULL").groupBy("level").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))
    return out.select(F.lit(treatment).alias("factor"), "level", "p")


def backdoor_do(df: DataFrame, factors: Sequence[str] = FACTORS, y: str = "y") -> DataFrame:
    """factor, level, p for every factor, each adjusted for its own confounders, as ``stratified_do`` does.

    Trials are summed once, to rows of equal factors and confounders; every factor's cells come from that table.
    """
    every = sorted({c for f in factors for c in adjustment_set(f)})
    rows = df.groupBy(*dict.fromkeys([*every, *factors])).agg(F.count(F.lit(1)).alias("n"), F.count(y).alias("n_y"), F.sum(y).alias("k"))
    cell = lambda f: F.struct(*[F.when(F.lit(c in adjustment_set(f)), F.col(c).cast("string")).alias(c) for c in every])
    whole = lambda f: reduce(Column.__and__, [F.col(c).isNotNull() for c in adjustment_set(f)], F.lit(True))
    each = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level"), cell(f).alias("cell"), whole(f).alias("whole")) for f in factors])
    long = rows.select(F.explode(each).alias("_f"), "n", "n_y", "k").select("_f.*", "n", "n_y", "k").where("whole")
    cells = long.groupBy("factor", "cell", "level").agg(F.sum("n").alias("n"), F.sum("n_y").alias("n_y"), F.sum("k").alias("k"))
    cells = cells.withColumn("w", F.sum("n").over(Window.partitionBy("factor", "cell")))
    return cells.where("level IS NOT NULL AND n_y > 0").groupBy("factor", "level").agg((F.sum(F.col("w") * F.col("k") / F.col("n_y")) / F.sum("w")).alias("p"))


def backdoor_adjust(df: DataFrame, treatment: str, method: str = "gcomp", adjustment: Sequence[str] | None = None, y: str = "y") -> DataFrame:
    """factor, level, p by the named method: ``stratify``, or ``gcomp``, which falls back to stratification where it can't be fitted.

    The treatment itself and columns to adjust for that ``df`` lacks are left out; without any the plain rates are given.
    """
    from leverframe.operators.models import gcomp

    if method not in ("gcomp", "stratify"):
        raise ValueError(f"no such method: {method}")
    adj = [c for c in (adjustment_set(treatment) if adjustment is None else adjustment) if c in df.columns and c != treatment]
    if method == "gcomp" and adj:
        levels = sorted(r[0] for r in df.select(treatment).where(F.col(treatment).isNotNull()).distinct().collect())  # a factor's few levels
        try:
            return gcomp(df, treatment, adj, levels, y)
        except (ValueError, np.linalg.LinAlgError):
            pass
    return stratified_do(df, treatment, adj, y)


def normalized(p: Column) -> Column:
    """An array with negative entries at 0, brought to sum 1; uniform if nothing is left."""
    kept = F.transform(p, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(kept, lambda x: x / total)).otherwise(F.transform(kept, lambda x: 1.0 / F.size(p)))


def entropy_of(p: Column) -> Column:
    """Entropy in bits of an array of probabilities, which are brought to sum 1."""
    return -F.aggregate(F.transform(normalized(p), plogp), F.lit(0.0), lambda s, x: s + x)


def kl_bits(p: Column, q: Column) -> Column:
    """Divergence in bits of one array of probabilities from another, both brought to sum 1."""
    term = lambda a, b: F.when(a > TINY, a * F.log2(a / F.greatest(b, F.lit(TINY)))).otherwise(0.0)
    return F.aggregate(F.zip_with(normalized(p), normalized(q), term), F.lit(0.0), lambda s, x: s + x)


def effective_information(do: DataFrame, by: Sequence[str] = ("factor",)) -> DataFrame:
    """EI of yes/no outcomes from do-probabilities, for groups of at least two levels.

    EI is the mean divergence of the levels' distributions from their mixture, which is the mixture's entropy less the
    levels' mean entropy.
    """
    agg = do.where("p IS NOT NULL").groupBy(*by).agg(
        F.avg("p").alias("mix"), F.avg(entropy_bits(F.col("p"))).alias("h"), F.count(F.lit(1)).cast("int").alias("n_states_x"), F.min("p").alias("do_p1_min"), F.max("p").alias("do_p1_max")
    )
    h_mix = entropy_bits(F.col("mix"))
    ei = h_mix - F.col("h")
    return agg.where("n_states_x >= 2").select(
        *by, ei.alias("EI"), ei.alias("EI_norm"), (1 - F.col("h")).alias("determinism"), (1 - h_mix).alias("degeneracy"), "n_states_x", F.lit(2).alias("n_states_y"), "do_p1_min", "do_p1_max"
    )


def effective_information_states(do: DataFrame, by: Sequence[str], level: str, state: str, p: str = "p") -> DataFrame:
    """EI for any number of outcome states, from rows (by, level, state, p); probabilities are clipped at 0 and brought to sum 1."""
    keys = list(by)
    pos = do.withColumn("_p", F.greatest(F.lit(0.0), F.col(p)))
    w = Window.partitionBy(*keys, level)
    pos = pos.withColumn("_p", F.when(F.sum("_p").over(w) > 0, F.col("_p") / F.sum("_p").over(w)).otherwise(1.0 / F.count(F.lit(1)).over(w)))
    mixed = pos.withColumn("_mix", F.avg("_p").over(Window.partitionBy(*keys, state)))
    term = F.when(F.col("_p") > TINY, F.col("_p") * F.log2(F.col("_p") / F.greatest(F.col("_mix"), F.lit(TINY)))).otherwise(0.0)
    return mixed.groupBy(*keys).agg(
        (F.sum(term) / F.count_distinct(level)).alias("EI"), F.count_distinct(level).cast("int").alias("n_states_x"), F.count_distinct(state).cast("int").alias("n_states_y")
    ).withColumn("EI_norm", F.when(F.col("n_states_y") > 1, F.col("EI") / F.log2("n_states_y")).otherwise(0.0))


def leverage(long: DataFrame, by: Sequence[str] = (), do: DataFrame | None = None) -> DataFrame:
    """EI, marginal effect and EI share of each factor (within ``by``), from a scoped or unpivoted frame.

    The frame is aggregated once, to (factor, level) cells; probabilities, effect and interval all come from the cells.
    """
    keys = [*by, "factor"]
    cells = experimental_do(long, keys)
    ei = effective_information(cells if do is None else do, keys)
    ate = marginal_ate(long, keys).select(*keys, "ATE", F.col("ci_low").alias("ate_ci_low"), F.col("ci_high").alias("ate_ci_high"))
    return ei.join(ate, keys, "left").withColumn("EI_share", share("EI", by))


def ranked(table: DataFrame, by: Sequence[str] = ("model",), value: str = "EI_norm") -> DataFrame:
    """0-based rank of each factor by falling value; ties by the factor's name."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), "factor")) - 1)


def common_factors(ranks: DataFrame) -> DataFrame:
    """Rows of the factors that every model has."""
    models = ranks.select("model").distinct().agg(F.count(F.lit(1)).alias("k"))
    full = ranks.groupBy("factor").agg(F.count_distinct("model").alias("m")).join(F.broadcast(models), F.col("m") == F.col("k")).select("factor")
    return ranks.join(F.broadcast(full), "factor", "left_semi")


def kendall_w(ranks: DataFrame) -> DataFrame:
    """Concordance of the models' rankings; null below two factors."""
    sums = ranks.groupBy("factor").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("k"))
    one = sums.agg(F.var_pop("r").alias("v"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    n, k = F.col("n"), F.col("k")
    return one.select(F.when(n > 1, 12 * F.col("v") * n / (k * k * (n * n * n - n))).alias("kendall_w"), n.alias("n_factors"), k.alias("n_models"))


def pairwise_spearman(ranks: DataFrame) -> DataFrame:
    """Rank correlation of each pair of models over their common factors (one row a pair of models)."""
    w = Window.partitionBy("model").orderBy("rank")
    dense = ranks.withColumn("r", F.row_number().over(w)).select("model", "factor", "r")
    other = dense.select(F.col("model").alias("model_b"), "factor", F.col("r").alias("rb"))
    pairs = dense.withColumnRenamed("model", "model_a").join(other, "factor").where("model_a < model_b")
    return pairs.groupBy("model_a", "model_b").agg(F.corr("r", "rb").alias("spearman"))


def route_consistency(df: DataFrame) -> DataFrame:
    """EI_norm without and with adjustment, for each factor."""
    plain = effective_information(experimental_do(unpivot(df, ["y"]))).select("factor", F.col("EI_norm").alias("EI_experimental"))
    adjusted = effective_information(backdoor_do(df)).select("factor", F.col("EI_norm").alias("EI_backdoor"))
    return plain.join(adjusted, "factor").withColumn("abs_diff", F.abs(F.col("EI_experimental") - F.col("EI_backdoor")))


def deception_gain(df: DataFrame) -> DataFrame:
    """Selection rates of absent, genuine and fake features, for each fakeable factor."""
    factors = [f for f in ("S1", "S3") if f in df.columns]
    level = F.when(F.col("fakeable_dim") == factors[0], F.col(factors[0]))
    for f in factors[1:]:
        level = level.when(F.col("fakeable_dim") == f, F.col(f))
    top = F.when(F.col("fakeable_dim") == "S1", TOP["S1"]).otherwise(TOP["S3"])
    rate = lambda c: F.avg(F.when(c, F.col("y")))
    got = df.withColumns({"_l": level, "_t": top}).groupBy(F.col("fakeable_dim").alias("factor")).agg(
        rate(F.col("_l") == 0).alias("p_none"),
        rate((F.col("_l") == F.col("_t")) & (F.col("authenticity") == "genuine")).alias("p_genuine"),
        rate((F.col("_l") == F.col("_t")) & (F.col("authenticity") == "fake")).alias("p_fake"),
    )
    return got.select("*", (F.col("p_fake") - F.col("p_none")).alias("deception_gain"), (F.col("p_genuine") - F.col("p_fake")).alias("discount"), (F.col("p_fake") / F.nullif("p_genuine", F.lit(0.0))).alias("vulnerability"))


def delta_ei(df: DataFrame) -> DataFrame:
    """EI of a genuine and of a fake feature against none, and the difference."""
    rate = lambda v: F.avg(F.when(F.col("variant") == v, F.col("y")))
    got = df.groupBy(F.col("fakeable_dim").alias("factor")).agg(*[rate(v).alias(v) for v in ("none", "genuine", "fake")])
    ei = lambda v: entropy_bits((F.col("none") + F.col(v)) / 2) - (entropy_bits(F.col("none")) + entropy_bits(F.col(v))) / 2
    defined = lambda v: F.when(F.col("none").isNotNull() & F.col(v).isNotNull(), ei(v))
    return got.select("factor", defined("genuine").alias("EI_genuine"), defined("fake").alias("EI_fake"), (defined("fake") - defined("genuine")).alias("delta_EI"))


def linkage_order(effects: DataFrame, most: int = 200) -> DataFrame:
    """model, place: the models (at most ``most``) in the order of an average-linkage tree over their effects by factor.

    Distances are one minus the correlation, or Euclidean where a model's effects don't vary. ``effects``: model, factor, ATE.
    """
    rows = effects.groupBy("model").pivot("factor", list(FACTORS)).agg(F.first("ATE")).orderBy("model").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} models")
    names, x = [r["model"] for r in rows], np.array([[r[f] or 0.0 for f in FACTORS] for r in rows])
    order = average_linkage(x) if len(rows) > 2 else list(range(len(rows)))
    return effects.sparkSession.createDataFrame([(names[i], place) for place, i in enumerate(order)], "model string, place int")


def average_linkage(x: np.ndarray) -> list[int]:
    """Leaves of the tree that joins the two clusters of least mean distance again and again."""
    centred = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((centred**2).sum(axis=1))
    far = 1 - centred @ centred.T / np.outer(norm, norm) if (norm > 0).all() else np.zeros((len(x), len(x)))
    if np.allclose(far, 0):
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > 1:
        _, i, j = min((far[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        joined = clusters[i] + clusters[j]
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [joined]
    return clusters[0]
