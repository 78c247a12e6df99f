"""Selection effects on trial frames: filters, pairing, average treatment effects, bootstrap intervals, heterogeneity.

A trial frame has one row for each trial. A *scoped* frame (``scoped``) has, for each trial, the factor that it varies,
that factor's level and its top level, so that all factors are estimated in one grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import e, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leverframe.codebook import FACTORS, TOP, Z


def analysis_frame(df: DataFrame) -> DataFrame:
    """Trials that count: no permanent API error and a parsed decision; each test only where its column exists."""
    if "api_error" in df.columns:
        df = df.where(F.coalesce("api_error", F.lit("")) == "")
    return df.where(F.col("parse_ok") == 1) if "parse_ok" in df.columns else df


def pair_key(columns: Sequence[str] = ("query_id", "model", "prompt_style", "target_position", "seed", "pair_id")) -> Column:
    """Key that a control and its treatment share; nulls count as empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def level_of(factor: Column, factors: Sequence[str] = FACTORS) -> Column:
    """The value of the factor column that ``factor`` names."""
    out = F.when(factor == factors[0], F.col(factors[0]))
    for f in factors[1:]:
        out = out.when(factor == f, F.col(f))
    return out


def top_of(factor: Column) -> Column:
    return F.when(factor.isin([f for f in FACTORS if TOP[f] == 2]), 2).otherwise(1)


def scoped(df: DataFrame, scope: str = "target_dim") -> DataFrame:
    """``df`` with factor, level and top, where each row belongs to the one factor that its trial varies."""
    return df.withColumns({"factor": F.col(scope), "level": level_of(F.col(scope)), "top": top_of(F.col(scope))})


def unpivot(df: DataFrame, keep: Sequence[str], factors: Sequence[str] = FACTORS) -> DataFrame:
    """One row for each factor of each trial: the columns of ``keep`` and factor, level, top."""
    entries = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level"), F.lit(TOP[f]).alias("top")) for f in factors])
    return df.select(*keep, F.explode(entries).alias("_f")).select(*keep, "_f.*")


def _rate(cond: Column, y: str) -> Column:
    return F.avg(F.when(cond, F.col(y)))


def _high() -> Column:
    return F.col("level") == F.col("top")


def _low() -> Column:
    return F.col("level") == 0


def marginal_ate(long: DataFrame, by: Sequence[str] = ("factor",), y: str = "y") -> DataFrame:
    """Difference of the rates at the top and the lowest level, with a normal interval; null where a side is empty."""
    agg = long.groupBy(*by).agg(_rate(_high(), y).alias("pt"), _rate(_low(), y).alias("pc"), F.count(F.when(_high(), 1)).alias("n_treated"), F.count(F.when(_low(), 1)).alias("n_control"))
    se = F.sqrt(F.col("pt") * (1 - F.col("pt")) / F.nullif("n_treated", F.lit(0)) + F.col("pc") * (1 - F.col("pc")) / F.nullif("n_control", F.lit(0)))
    ate = F.col("pt") - F.col("pc")
    return agg.select(*by, ate.alias("ATE"), (ate - Z * se).alias("ci_low"), (ate + Z * se).alias("ci_high"), "n_treated", "n_control")


def pair_sums(long: DataFrame, by: Sequence[str] = ("factor",), key: Sequence[str] = ("pair_key",), cluster: str | None = None, y: str = "y") -> DataFrame:
    """by, key, sums and counts at the two levels (hi, n_hi, lo, n_lo): all that paired and marginal effects need, in one grouping; ``cluster`` is constant in a pair."""
    keys = [k for k in key if k not in by]
    extra = [F.min(cluster).alias(cluster)] if cluster and cluster not in (*by, *keys) else []
    side = lambda c, name: [F.sum(F.when(c, F.col(y))).alias(name), F.count(F.when(c, F.col(y))).alias(f"n_{name}")]
    return long.where(_high() | _low()).groupBy(*by, *keys).agg(*side(_high(), "hi"), *side(_low(), "lo"), *extra)


def _diff() -> Column:
    """A complete pair's mean at the top level minus its mean at the lowest; null for others."""
    return F.try_divide(F.col("hi"), F.col("n_hi")) - F.try_divide(F.col("lo"), F.col("n_lo"))


def pair_differences(long: DataFrame, by: Sequence[str] = ("factor",), key: Sequence[str] = ("pair_key",), cluster: str | None = None, y: str = "y") -> DataFrame:
    """diff of each complete pair."""
    return pair_sums(long, by, key, cluster, y).withColumn("diff", _diff()).where("diff IS NOT NULL")


def paired_ate(long: DataFrame, by: Sequence[str] = ("factor",), key: Sequence[str] = ("pair_key",), y: str = "y") -> DataFrame:
    """Unweighted mean of the pair differences; n_treated and n_control count all rows at the two levels."""
    return pair_sums(long, by, key, y=y).groupBy(*by).agg(F.avg(_diff()).alias("ATE"), F.count(_diff()).alias("n_pairs"), F.sum("n_hi").alias("n_treated"), F.sum("n_lo").alias("n_control"))


def ate_table(long: DataFrame, by: Sequence[str] = ("factor",), key: Sequence[str] = ("pair_key",), y: str = "y") -> DataFrame:
    """Paired and marginal effect side by side, from one grouping by pair."""
    sums = pair_sums(long, by, key, y=y).groupBy(*by).agg(F.avg(_diff()).alias("paired_ate"), F.count(_diff()).alias("n_pairs"), *[F.sum(c).alias(c) for c in ("hi", "n_hi", "lo", "n_lo")])
    marginal = F.try_divide(F.col("hi"), F.col("n_hi")) - F.try_divide(F.col("lo"), F.col("n_lo"))
    return sums.select(*by, "paired_ate", marginal.alias("marginal_ate"), "n_pairs", F.col("n_hi").alias("n_treated"), F.col("n_lo").alias("n_control"))


def cluster_sums(long: DataFrame, cluster: str = "query_id", by: Sequence[str] = ("factor",), key: Sequence[str] = ("pair_key",)) -> DataFrame:
    """Sum and number of pair differences of each cluster: all that a cluster bootstrap needs."""
    return pair_differences(long, by, key, cluster).groupBy(*by, cluster).agg(F.sum("diff").alias("sum_diff"), F.count(F.lit(1)).alias("n_pairs"))


#: Chances that a Poisson draw of mean 1 is at most 0, 1, 2, ...; further ones have a chance below 1e-7.
POISSON = [sum(1 / factorial(i) for i in range(k + 1)) / e for k in range(10)]


def poisson(*parts: Column) -> Column:
    """A Poisson draw of mean 1 that is a hash of the parts."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return reduce(Column.__add__, [F.when(u >= p, 1).otherwise(0) for p in POISSON])


def cluster_bootstrap(sums: DataFrame, n_boot: int = 2000, alpha: float = 0.05, by: Sequence[str] = ("factor",), cluster: str = "query_id") -> DataFrame:
    """Percentile interval of the pooled mean under resampling of whole clusters, from ``cluster_sums``.

    A replicate weighs each cluster by a hashed Poisson draw, so that replicates are sums that merge in any order and no
    task holds all clusters; its mean is the weighed sums over the weighed counts.
    """
    drawn = sums.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("w", poisson(*[F.col(c).cast("string") for c in (*by, cluster)], F.col("r").cast("string")))
    means = drawn.groupBy(*by, "r").agg((F.sum(F.col("w") * F.col("sum_diff")) / F.nullif(F.sum(F.col("w") * F.col("n_pairs")), F.lit(0))).alias("mean"))
    ends = means.groupBy(*by).agg(F.percentile("mean", F.lit(alpha / 2)).alias("ci_low"), F.percentile("mean", F.lit(1 - alpha / 2)).alias("ci_high"))
    point = sums.groupBy(*by).agg((F.sum("sum_diff") / F.sum("n_pairs")).alias("ATE"), F.sum("n_pairs").alias("n_pairs"))
    return point.join(ends, list(by)).select(*by, "ATE", "ci_low", "ci_high", "n_pairs")


def pair_bootstrap(long: DataFrame, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0, by: str = "factor", key: Sequence[str] = ("pair_key",)) -> DataFrame:
    """Percentile interval of the mean pair difference under resampling of pairs.

    Pairs with equal differences are interchangeable, so a replicate is a multinomial draw over the distinct
    differences: what reaches the task is one row for each distinct value (few, as they are rates of small counts).
    """
    values = pair_differences(long, (by,), key).groupBy(by, F.round("diff", 12).alias("diff")).count()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("diff")
        n = int(frame["count"].sum())
        rng = np.random.default_rng(seed)
        p = frame["count"].to_numpy() / n
        means = np.array([rng.multinomial(n, p) @ frame["diff"].to_numpy() / n for _ in range(n_boot)])
        low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({by: [frame[by].iloc[0]], "ATE": [float(p @ frame["diff"].to_numpy())], "ci_low": [low], "ci_high": [high]})

    return values.groupBy(by).applyInPandas(run, f"{by} string, ATE double, ci_low double, ci_high double")


def two_channels(retrieved: DataFrame, frame: DataFrame) -> DataFrame:
    """Each factor's rates of being retrieved and, given that, of being cited, by role, their products and differences; factors without a side are left out.

    ``retrieved``: target_dim, role, retrieved; ``frame``: target_dim, role, y.
    """
    rate = lambda y, role: F.avg(F.when(F.col("role") == role, F.col(y)))
    sides = lambda df, y, a, b: df.groupBy(F.col("target_dim").alias("factor")).agg(rate(y, "control").alias(a), rate(y, "treatment").alias(b)).dropna()
    c, both = F.col, sides(retrieved, "retrieved", "rc", "rt").join(sides(frame, "y", "cc", "ct"), "factor")
    return both.select(
        "factor", c("rc").alias("P_retrieve_control"), c("rt").alias("P_retrieve_treated"), (c("rt") - c("rc")).alias("ATE_retrieve"), c("cc").alias("P_cite_ctx_control"), c("ct").alias("P_cite_ctx_treated"), (c("ct") - c("cc")).alias("ATE_cite"),
        (c("rc") * c("cc")).alias("P_e2e_control"), (c("rt") * c("ct")).alias("P_e2e_treated"), (c("rt") * c("ct") - c("rc") * c("cc")).alias("ATE_e2e"),
    )


def mediation(df: DataFrame, cause: str = "S1", moderator: str = "O4", y: str = "y") -> DataFrame:
    """The cause's effect where the moderator is present and where it is absent, and the difference."""
    hi, lo = F.col(cause) == TOP[cause], F.col(cause) == 0
    present, absent = F.col(moderator) > 0, F.col(moderator) == 0
    one = df.agg(
        (_rate(hi & present, y) - _rate(lo & present, y)).alias("ate_moderator_present"),
        (_rate(hi & absent, y) - _rate(lo & absent, y)).alias("ate_moderator_absent"),
    )
    return one.select(F.lit(cause).alias("cause"), F.lit(moderator).alias("moderator"), "*", (F.col("ate_moderator_present") - F.col("ate_moderator_absent")).alias("amplification"))


def position_bias(df: DataFrame, y: str = "y") -> DataFrame:
    return df.groupBy("target_position").agg(F.avg(y).alias("selection_rate"), F.count(F.lit(1)).alias("n"))


def position_adjusted(df: DataFrame, by: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Mean over positions of the rates by position."""
    return df.groupBy(*by, "target_position").agg(F.avg(y).alias("rate")).groupBy(*by).agg(F.avg("rate").alias("adj_rate"))


def validity_report(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg("parse_ok").alias("parse_ok_rate"),
        F.avg("y").alias("overall_selection_rate"),
        F.array_join(F.sort_array(F.collect_set("target_position")), ",").alias("positions_covered"),
        F.count_distinct("model").alias("n_models"),
        F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("domains"),
    )


def domain_paired(long: DataFrame, grid: DataFrame, key: Sequence[str] = ("pair_key",)) -> DataFrame:
    """Paired effect of each (domain, factor) of ``grid``; 0 where it is undefined."""
    got = paired_ate(long, ("domain", "factor"), key).select("domain", "factor", "ATE", "n_pairs")
    out = grid.join(got, ["domain", "factor"], "left")
    return out.select("domain", "factor", F.coalesce("ATE", F.lit(0.0)).alias("ATE"), F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"))


def direction(ate: Column, low: Column, high: Column) -> Column:
    """Five-way label of an effect and its interval."""
    return F.when(low > 0, "positive_significant").when(high < 0, "negative_significant").when(ate > 0, "positive").when(ate < 0, "negative").otherwise("zero")


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combinations that are not done yet; keys compare as strings, null as empty."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys}
    had = done.select(*[e.alias(f"_{c}") for c, e in text.items()]).distinct()
    on = [text[c] == F.col(f"_{c}") for c in keys]
    return todo.join(had, on, "left_anti")


def share(value: str, by: Sequence[str] = ()) -> Column:
    """Part of the total; 0 where the total is not positive."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return F.when(total > 0, F.col(value) / total).otherwise(0.0)
