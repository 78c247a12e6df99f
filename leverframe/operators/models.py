"""Logistic models on trial frames: clustered logit, g-computation, position slope.

Trials are grouped to distinct covariate rows first; what then reaches the driver are p x p sums, whatever the number
of trials.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import erfc, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from leverframe.codebook import Z
from leverframe.sources.files import stored


def _linear(x: Column, beta: np.ndarray) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(b)) for b in beta]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _sums(entries: list[Column], rows: DataFrame) -> np.ndarray:
    got = rows.agg(*[F.sum(e).alias(f"s{i}") for i, e in enumerate(entries)]).first()
    return np.array([v or 0.0 for v in got], float)


def fit_logit(cells: DataFrame, p: int, ridge: float = 0.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and inverse information by Newton steps. ``cells``: x (array of p), n, k (successes). Raises LinAlgError if separated."""
    beta = np.zeros(p)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(steps):
        mu = 1 / (1 + F.exp(-_linear(F.col("x"), beta)))
        w = F.col("n") * mu * (1 - mu)
        entries = [(F.col("k") - F.col("n") * mu) * F.get("x", i) for i in range(p)] + [w * F.get("x", i) * F.get("x", j) for i, j in upper]
        got = _sums(entries, cells)
        info = np.zeros((p, p))
        for (i, j), v in zip(upper, got[p:], strict=True):
            info[i, j] = info[j, i] = v
        info += ridge * np.eye(p)
        step = np.linalg.solve(info, got[:p] - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10 * max(1.0, np.abs(beta).max()):
            return beta, np.linalg.inv(info)
    raise np.linalg.LinAlgError("no finite maximum")


def logit_with_clusters(df: DataFrame, factors: Sequence[str], interactions: Sequence[tuple[str, str]] = (), cluster: str = "query_id", y: str = "y", position: str | None = "target_position") -> DataFrame:
    """Logit of ``y`` with cluster-robust errors: term, coef, se, z, p, odds_ratio, or_low, or_high, method.

    The sandwich's middle is the sum over clusters of outer products of the clusters' score sums; the usual
    small-sample factor is applied. Where the fit breaks down, a ridge fit without errors is given and named so.
    """
    spark = df.sparkSession
    names = ["Intercept", *factors, *([position] if position else []), *[f"{a}:{b}" for a, b in interactions]]
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in factors], *([F.col(position).cast("double")] if position else []), *[(F.col(a) * F.col(b)).cast("double") for a, b in interactions])
    grouped = df.select(F.col(cluster).alias("g"), x.alias("x"), F.col(y).alias("y")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).cache()
    p, method = len(names), "logit_cluster"
    try:
        beta, bread = fit_logit(grouped.groupBy("x").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), p)
        mu = 1 / (1 + F.exp(-_linear(F.col("x"), beta)))
        scores = grouped.groupBy("g").agg(*[F.sum((F.col("k") - F.col("n") * mu) * F.get("x", i)).alias(f"s{i}") for i in range(p)], F.sum("n").alias("n"))
        upper = [(i, j) for i in range(p) for j in range(i, p)]
        got = _sums([F.col(f"s{i}") * F.col(f"s{j}") for i, j in upper] + [F.lit(1.0), F.col("n")], scores)
        meat = np.zeros((p, p))
        for (i, j), v in zip(upper, got, strict=False):
            meat[i, j] = meat[j, i] = v
        g, n = got[-2], got[-1]
        cov = bread @ meat @ bread * (g / (g - 1) * (n - 1) / (n - p))
        se = np.sqrt(np.diag(cov))
    except np.linalg.LinAlgError:
        method = "ridge(separation)"
        beta, _ = fit_logit(grouped.groupBy("x").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), p, ridge=1.0)
        se = np.full(p, np.nan)
    grouped.unpersist()
    rows = []
    for name, b, s in zip(names, beta, se, strict=True):
        z = b / s if s and not np.isnan(s) else float("nan")
        pv = 2 * (1 - NormalDist().cdf(abs(z))) if not np.isnan(z) else float("nan")
        rows.append((name, float(b), float(s), float(z), float(pv), float(np.exp(b)), float(np.exp(b - Z * s)), float(np.exp(b + Z * s)), method))
    return spark.createDataFrame(rows, "term string, coef double, se double, z double, p double, odds_ratio double, or_low double, or_high double, method string")


class Groups:
    """Trials summed to rows of equal covariates, one row for each group: logits with an intercept for each group, eliminated inside the groups.

    ``cells``: g, x (array of ``p``), n, k (successes). A pass over the groups finds each group's intercept for given
    coefficients by Newton steps of its own; what leaves a task are sums of ``p`` x ``p`` size, whatever the number of
    groups. With ``precision`` 0 intercepts are free: those of groups in which all or none succeed are infinite, so these
    groups say nothing of the coefficients and their rates are 1 and 0. Else they have a normal prior of that precision.
    """

    def __init__(self, cells: DataFrame, p: int):
        self.p = p
        each = lambda name: F.transform("c", lambda c: c[name])
        whole = cells.groupBy("g").agg(F.collect_list(F.struct("x", "n", "k")).alias("c"))
        self.rows = stored(whole.select("g", each("n").alias("n"), each("k").alias("k"), F.flatten(each("x")).alias("x")), "groups")

    @staticmethod
    def solved(frame: pd.DataFrame, p: int, beta: np.ndarray, precision: float) -> tuple[np.ndarray, ...]:
        """x, n, k and rate of each cell, where groups begin, their intercepts and the curvature in them."""
        sizes = frame["n"].map(len).to_numpy()
        n, k = (np.concatenate(frame[c].to_list()).astype(float) for c in "nk")
        x = np.concatenate(frame["x"].to_list()).reshape(len(n), p) if p else np.zeros((len(n), 0))
        begin = np.cumsum(sizes) - sizes
        add = lambda v: np.add.reduceat(v, begin)
        total, good = add(n), add(k)
        pure = (precision == 0) & ((good == 0) | (good == total))
        base, u = x @ beta, np.zeros(len(frame))
        for _ in range(100):
            mu = 1 / (1 + np.exp(-(base + np.repeat(u, sizes))))
            d = add(n * mu * (1 - mu)) + precision
            step = np.where(pure, 0.0, np.clip((add(k - n * mu) - precision * u) / np.maximum(d, 1e-300), -3, 3))
            u = u + step
            if np.abs(step).max() < 1e-11:
                break
        u = np.where(pure, np.where(good > 0, np.inf, -np.inf), u)
        mu = 1 / (1 + np.exp(-(base + np.repeat(u, sizes))))
        return x, n, k, mu, begin, u, np.where(pure, np.inf, add(n * mu * (1 - mu)) + precision)

    def sums(self, of: Callable[..., np.ndarray], beta: np.ndarray, precision: float) -> np.ndarray:
        """``of`` what ``solved`` gives, summed over all groups."""
        p = self.p

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    with np.errstate(over="ignore"):
                        values = of(*Groups.solved(frame, p, beta, precision))
                    yield pd.DataFrame({"i": np.arange(len(values)), "v": values})

        got = self.rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # p x p sums
        return np.array([r["v"] for r in got])

    def fit(self, precision: float = 0.0, estimate: bool = False, steps: int = 60) -> tuple[np.ndarray, float]:
        """Coefficients and precision. With ``estimate`` the prior's variance is found too: it is the groups' mean of squared intercept plus its variance (EM by Laplace's approximation)."""
        p, beta, last = self.p, np.zeros(self.p), None

        def of(x, n, k, mu, begin, u, d):
            w = n * mu * (1 - mu)
            wx = np.add.reduceat(w[:, None] * x, begin, axis=0) if p else np.zeros((len(begin), 0))
            info = (x * w[:, None]).T @ x - (wx / d[:, None]).T @ wx
            return np.concatenate([[len(u), np.where(np.isfinite(u), u * u + 1 / d, 0).sum()], x.T @ (k - n * mu), info.ravel()])

        for _ in range(steps):
            got = self.sums(of, beta, precision)
            step = np.linalg.solve(got[2 + p :].reshape(p, p), got[2 : 2 + p]) if p else np.zeros(0)
            if not np.isfinite(step).all() or np.abs(beta).max(initial=0) > 30:
                raise np.linalg.LinAlgError("no finite maximum")
            beta = beta + np.clip(step, -4, 4)
            moved = np.abs(step).max(initial=0)
            if estimate:
                here, target = -np.log(precision), np.log(max(got[1] / got[0], 1e-8))
                if last is not None and here != last[0] and (slope := (target - here - last[1]) / (here - last[0])) < 0:
                    new = here + np.clip(-(target - here) / slope, -1.5, 1.5)
                else:
                    new = target
                last = (here, target - here)
                moved = max(moved, abs(new - here) if new > np.log(1e-7) else 0)
                precision = float(np.exp(-max(new, np.log(1e-8))))
            if moved < 1e-6 * max(1.0, np.abs(beta).max(initial=0)):
                return beta, precision
        raise np.linalg.LinAlgError("no finite maximum")


def gcomp(df: DataFrame, treatment: str, adjustment: str | Sequence[str], levels: Sequence[int], y: str = "y") -> DataFrame:
    """P(Y=1 | do(X=level)) by g-computation: logit of y on the levels and the adjustment, averaged over all rows.

    Text columns of the adjustment go in as categories, numbers as they are. The text column with most categories is
    eliminated inside its groups (``Groups``), however many it has; the categories of further text columns are
    coefficients. Raises LinAlgError where there is no finite fit.
    """
    adj = [adjustment] if isinstance(adjustment, str) else list(adjustment)
    work = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [treatment, y, *adj])).where(F.col(treatment).isin(list(levels)))
    texts = [c for c in adj if dict(df.dtypes)[c] == "string"]
    sizes = work.agg(*[F.approx_count_distinct(c).alias(c) for c in texts]).first() if texts else {}
    own = max(texts, key=lambda c: sizes[c], default=None)
    named = {c: [r[0] for r in work.select(c).distinct().orderBy(c).collect()] for c in texts if c != own}
    parts = [(F.col(treatment) == v).cast("double") for v in levels[1:]] + [F.col(c).cast("double") for c in adj if c not in texts] + [(F.col(c) == v).cast("double") for c, vs in named.items() for v in vs[1:]]
    group = F.col(own) if own else F.lit("")
    cells = work.select(group.alias("g"), F.array(*parts).alias("x"), F.col(y).alias("y")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    fitted, n_levels = Groups(cells, len(parts)), len(levels)
    beta, _ = fitted.fit()

    def rates(x, n, k, mu, begin, u, d):
        base = x[:, n_levels - 1 :] @ beta[n_levels - 1 :] + np.repeat(u, np.diff(np.append(begin, len(n))))
        return np.array([n.sum(), *[(n / (1 + np.exp(-(base + b)))).sum() for b in (0.0, *beta[: n_levels - 1])]])

    total, *sums = fitted.sums(rates, beta, 0.0)
    return df.sparkSession.createDataFrame([(treatment, int(v), float(p / total)) for v, p in zip(levels, sums, strict=True)], "factor string, level int, p double")


def interaction_test(df: DataFrame, factor: str, moderator: str, cluster: str = "query_id", y: str = "y", most: int = 50) -> DataFrame:
    """Clustered logit of a factor, a moderator and their product; a text moderator goes in as its categories, the first in order being the base."""
    kind = dict(df.dtypes)[moderator]
    if kind != "string":
        names, work = [moderator], df
    else:
        cats = [r[0] for r in df.select(moderator).where(F.col(moderator).isNotNull()).distinct().orderBy(moderator).limit(most + 1).collect()]
        if len(cats) > most:
            raise ValueError(f"{moderator} has more than {most} categories")
        names = [f"{moderator}[{c}]" for c in cats[1:]]
        work = df.withColumns({n: F.when(F.col(moderator) == c, 1).otherwise(0) for n, c in zip(names, cats[1:], strict=True)})
    quoted = [f"`{n}`" for n in names]
    out = logit_with_clusters(work, [factor, *quoted], [(factor, q) for q in quoted], cluster, y, position=None)
    return out.withColumn("term", F.replace("term", F.lit("`"), F.lit(""))).withColumn("model_spec", F.lit(f"{y} ~ {factor} * {moderator}"))


def mixed_logit(df: DataFrame, factors: Sequence[str], group: str = "query_id", y: str = "y", prior: float | None = None) -> DataFrame:
    """Logit with an intercept for each group, shrunk to a common one by a normal prior; term, coef, group_sd, method.

    The prior's deviation is estimated (``Groups``), or ``prior`` if that is given. Where the fit breaks down, the clustered
    logit stands in and is named.
    """
    names = ["Intercept", *factors]
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in factors])
    cells = df.select(F.col(group).alias("g"), x.alias("x"), F.col(y).alias("y")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    try:
        beta, precision = Groups(cells, len(names)).fit(1.0 if prior is None else prior**-2, prior is None)
    except np.linalg.LinAlgError:
        return logit_with_clusters(df, factors, cluster=group, y=y, position=None).select("term", "coef", F.lit(None).cast("double").alias("group_sd"), F.concat(F.lit("fallback:"), "method").alias("method"))
    return df.sparkSession.createDataFrame([(t, float(b), float(precision**-0.5), "group_intercepts") for t, b in zip(names, beta, strict=True)], "term string, coef double, group_sd double, method string")


def slope(df: DataFrame, column: str = "target_position", y: str = "y") -> float:
    """Coefficient of a numeric column in a logit of ``y``; nan if it can't be fitted."""
    cells = df.groupBy(F.array(F.lit(1.0), F.col(column).cast("double")).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("k"))
    try:
        return float(fit_logit(cells, 2)[0][1])
    except np.linalg.LinAlgError:
        return float("nan")


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * erfc(-v / sqrt(2)), na_action="ignore")


def power_table(rates: DataFrame) -> DataFrame:
    """``rates`` (p1, p2, n) with the power of the two-sided test of two proportions."""
    mean = (F.col("p1") + F.col("p2")) / 2
    se0 = F.sqrt(2 * mean * (1 - mean) / F.col("n"))
    se1 = F.sqrt((F.col("p1") * (1 - F.col("p1")) + F.col("p2") * (1 - F.col("p2"))) / F.col("n"))
    return rates.withColumn("power", normal_cdf((F.abs(F.col("p1") - F.col("p2")) - Z * se0) / se1))
