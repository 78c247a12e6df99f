"""Queries on the trial frames: effects, Effective Information, consistency, deception."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leverframe.codebook import DOMAINS, FACTORS, Z
from leverframe.operators import effects as E
from leverframe.operators import information as I
from leverframe.operators import studies as S
from leverframe.plans.registry import query, r6, rounded
from leverframe.sources.bindings import DECEPTION_SQL, OBS_SQL, OFAT_SQL, deception, obs, ofat

B1, B2, B3 = f"WITH {OFAT_SQL}", f"WITH {OBS_SQL}", f"WITH {DECEPTION_SQL}"
PL = lambda p: f"CASE WHEN {p} > 1e-12 THEN {p} * log2({p}) ELSE 0 END"
H = lambda p: f"-({PL(p)} + {PL(f'(1 - {p})')})"
KL = lambda p, q: f"(CASE WHEN {p} > 1e-12 THEN {p} * log2({p} / greatest({q}, 1e-12)) ELSE 0 END + CASE WHEN 1 - {p} > 1e-12 THEN (1 - {p}) * log2((1 - {p}) / greatest(1 - {q}, 1e-12)) ELSE 0 END)"


#: What a control and its treatment have in common; as columns, which group faster than one joined text.
PAIR = ("query_id", "model", "prompt_style", "target_position", "seed", "target_dim")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoped analysis frame."""
    return E.scoped(E.analysis_frame(ofat(spark, sf_dir)))


def ei_sql(source: str, by: str = "", alias: str = "ei") -> str:
    """CTEs that give EI by factor (and ``by``) from a long frame, by the divergence from the mixture."""
    k = f"{by}, " if by else ""
    join = " AND ".join(f"d.{c} = m.{c}" for c in [*([by] if by else []), "factor"])
    dk = f"d.{by}, " if by else ""
    return f"""
{alias}_do AS (SELECT {k}factor, level, avg(y) AS p, count(*) AS n FROM {source} GROUP BY {k}factor, level),
{alias}_mix AS (SELECT {k}factor, avg(p) AS q, count(*) AS nx FROM {alias}_do GROUP BY {k}factor),
{alias} AS (SELECT {dk}d.factor, avg({KL('d.p', 'm.q')}) AS EI, 1 - avg({H('d.p')}) AS determinism, 1 - ({H('any_value(m.q)')}) AS degeneracy,
  CAST(count(*) AS INTEGER) AS n_states_x, min(d.p) AS do_p1_min, max(d.p) AS do_p1_max
  FROM {alias}_do d JOIN {alias}_mix m ON {join} GROUP BY {dk}d.factor HAVING count(*) >= 2)"""


def ate_sql(source: str, by: str = "factor", alias: str = "mate") -> str:
    return f"""
{alias}_c AS (SELECT {by}, avg(y) FILTER (level = top) AS pt, avg(y) FILTER (level = 0) AS pc, count(*) FILTER (level = top) AS nt, count(*) FILTER (level = 0) AS nc FROM {source} GROUP BY {by}),
{alias} AS (SELECT {by}, pt - pc AS ATE, pt - pc - {Z} * sqrt(pt * (1 - pt) / nt + pc * (1 - pc) / nc) AS ci_low, pt - pc + {Z} * sqrt(pt * (1 - pt) / nt + pc * (1 - pc) / nc) AS ci_high, nt AS n_treated, nc AS n_control FROM {alias}_c)"""


def pate_sql(by: str = "factor", source: str = "sc", alias: str = "pate") -> str:
    return f"""
{alias}_p AS (SELECT {by}, pair_key, min(query_id) AS query_id, avg(y) FILTER (level = top) - avg(y) FILTER (level = 0) AS diff FROM {source} WHERE level IN (0, top) GROUP BY {by}, pair_key),
{alias}_n AS (SELECT {by}, count(*) FILTER (level = top) AS nt, count(*) FILTER (level = 0) AS nc FROM {source} GROUP BY {by}),
{alias} AS (SELECT {', '.join('n.' + c for c in by.split(', '))}, avg(diff) AS ATE, count(diff) AS n_pairs, any_value(nt) AS n_treated, any_value(nc) AS n_control FROM {alias}_p p JOIN {alias}_n n USING ({by}) GROUP BY {', '.join('n.' + c for c in by.split(', '))})"""


@query("analysis_frame", f"{B1} SELECT target_dim, role, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_selected FROM af GROUP BY target_dim, role")
def analysis_frame(spark, sf_dir):
    return E.analysis_frame(ofat(spark, sf_dir)).groupBy("target_dim", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_selected"))


@query("pair_key", f"{B1} SELECT pair_key, factor, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_selected FROM sc GROUP BY pair_key, factor")
def pair_key(spark, sf_dir):
    rows = counted(spark, sf_dir).withColumn("pair_id", F.concat_ws("|", "query_id", "target_dim")).withColumn("pair_key", E.pair_key())
    return rows.groupBy("pair_key", "factor").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_selected"))


@query("scoped_contrast", f"{B1} SELECT factor, level, count(*) AS n, round(avg(y), 6) AS p FROM sc WHERE level IN (0, top) GROUP BY factor, level")
def scoped_contrast(spark, sf_dir):
    return rounded(I.experimental_do(counted(spark, sf_dir).where("level IN (0, top)")))


@query("experimental_do", f"{B1} SELECT factor, level, count(*) AS n, round(avg(y), 6) AS p FROM sc GROUP BY factor, level")
def experimental_do(spark, sf_dir):
    return rounded(I.experimental_do(counted(spark, sf_dir)))


@query("ei_binary", f"{B1}, {ei_sql('sc')} SELECT factor, round(EI, 6) AS EI, round(EI, 6) AS EI_norm, round(determinism, 6) AS determinism, round(degeneracy, 6) AS degeneracy, n_states_x, 2 AS n_states_y, round(do_p1_min, 6) AS do_p1_min, round(do_p1_max, 6) AS do_p1_max FROM ei")
def ei_binary(spark, sf_dir):
    return rounded(I.effective_information(I.experimental_do(counted(spark, sf_dir))))


LEVERAGE_SQL = f"""{B1}, {ei_sql('sc')}, {ate_sql('sc')}
SELECT factor, round(EI, 6) AS EI, round(EI, 6) AS EI_norm, round(determinism, 6) AS determinism, round(degeneracy, 6) AS degeneracy, n_states_x, 2 AS n_states_y,
  round(do_p1_min, 6) AS do_p1_min, round(do_p1_max, 6) AS do_p1_max, round(ATE, 6) AS ATE, round(ci_low, 6) AS ate_ci_low, round(ci_high, 6) AS ate_ci_high,
  round(CASE WHEN (SELECT sum(EI) FROM ei) > 0 THEN EI / (SELECT sum(EI) FROM ei) ELSE 0 END, 6) AS EI_share
FROM ei LEFT JOIN mate USING (factor)"""


@query("ei_leverage", LEVERAGE_SQL)
def ei_leverage(spark, sf_dir):
    return rounded(I.leverage(counted(spark, sf_dir))).orderBy(F.desc("EI_norm"), "factor")


@query("ei_share", f"{B1}, {ei_sql('sc', 'model')} SELECT model, factor, round(EI, 6) AS EI, round(EI / sum(EI) OVER (PARTITION BY model), 6) AS EI_share FROM ei")
def ei_share(spark, sf_dir):
    ei = I.effective_information(I.experimental_do(counted(spark, sf_dir), ["model", "factor"]), ["model", "factor"])
    return rounded(ei.select("model", "factor", "EI", E.share("EI", ["model"]).alias("EI_share")))


@query("ei_rank", f"{B1}, {ei_sql('sc', 'model')} SELECT model, factor, CAST(row_number() OVER (PARTITION BY model ORDER BY EI DESC, factor) AS INTEGER) AS EI_rank FROM ei")
def ei_rank(spark, sf_dir):
    ei = I.effective_information(I.experimental_do(counted(spark, sf_dir), ["model", "factor"]), ["model", "factor"])
    return I.ranked(ei).select("model", "factor", (F.col("rank") + 1).alias("EI_rank"))


@query("marginal_ate", f"{B1}, {ate_sql('sc')} SELECT factor, round(ATE, 6) AS ATE, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_treated, n_control FROM mate")
def marginal_ate(spark, sf_dir):
    return rounded(E.marginal_ate(counted(spark, sf_dir)))


@query("paired_ate", f"{B1}, {pate_sql()} SELECT factor, round(ATE, 6) AS ATE, n_pairs, n_treated, n_control FROM pate")
def paired_ate(spark, sf_dir):
    return rounded(E.paired_ate(counted(spark, sf_dir), key=PAIR))


@query("ate_table", f"""{B1}, {pate_sql()}, {ate_sql('sc')} SELECT factor, round(p.ATE, 6) AS paired_ate, round(m.ATE, 6) AS marginal_ate, n_pairs, p.n_treated, p.n_control,
 CASE WHEN factor IN ('S1', 'O4') THEN 2 ELSE 1 END AS level_hi, 0 AS level_lo FROM pate p JOIN mate m USING (factor)""")
def ate_table(spark, sf_dir):
    both = E.ate_table(counted(spark, sf_dir), key=PAIR)
    return rounded(both.select("factor", "paired_ate", "marginal_ate", "n_pairs", "n_treated", "n_control", E.top_of(F.col("factor")).alias("level_hi"), F.lit(0).alias("level_lo")))


@query("cluster_suffstats", f"{B1}, {pate_sql()} SELECT factor, query_id, round(sum(diff), 6) AS sum_diff, count(diff) AS n_pairs FROM pate_p WHERE diff IS NOT NULL GROUP BY factor, query_id")
def cluster_suffstats(spark, sf_dir):
    return rounded(E.cluster_sums(counted(spark, sf_dir), key=PAIR))


def boot_sql(by: str, n_boot: int) -> str:
    """Hashed Poisson replicates of the clusters' sums, from ``pate_p`` to columns ``by``, ATE, ci_low, ci_high, n_pairs."""
    u = f"CAST('0x' || substr(md5(concat_ws('|', {by}, query_id, CAST(r AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0"
    weight = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in E.POISSON)
    return f"""cs AS (SELECT {by}, query_id, sum(diff) AS s, count(diff) AS n FROM pate_p WHERE diff IS NOT NULL GROUP BY ALL),
dr AS (SELECT {by}, r, s, n, {u} AS u FROM cs, (SELECT unnest(range({n_boot})) AS r)), dw AS (SELECT *, {weight} AS w FROM dr),
mn AS (SELECT {by}, r, sum(w * s) / nullif(sum(w * n), 0) AS m FROM dw GROUP BY ALL),
ends AS (SELECT {by}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM mn GROUP BY {by}), pt AS (SELECT {by}, sum(s) / sum(n) AS a, CAST(sum(n) AS BIGINT) AS n FROM cs GROUP BY {by})
SELECT {by}, round(a, 6) AS ATE, round(lo + 1e-9, 6) AS ci_low, round(hi + 1e-9, 6) AS ci_high, n AS n_pairs FROM pt JOIN ends USING ({by})"""


def _ends(df: DataFrame) -> DataFrame:
    """Rounded off the halves: a quantile of few clusters is a fraction that may lie on one."""
    return rounded(df.withColumns({c: F.col(c) + 1e-9 for c in ("ci_low", "ci_high")}))


@query("cluster_boot_ci", f"{B1}, {pate_sql()}, {boot_sql('factor', 2000)}")
def cluster_boot_ci(spark, sf_dir):
    return _ends(E.cluster_bootstrap(E.cluster_sums(counted(spark, sf_dir), key=PAIR)))


@query("domain_ate_ci", f"{B1}, {pate_sql('domain, factor')}, {boot_sql('domain, factor', 1000)}")
def domain_ate_ci(spark, sf_dir):
    """Effect of each factor in each domain, with a bootstrap interval."""
    by = ("domain", "factor")
    return _ends(E.cluster_bootstrap(E.cluster_sums(counted(spark, sf_dir), by=by, key=PAIR), 1000, by=by))


@query("boot_ci")
def boot_ci(spark, sf_dir):
    return E.pair_bootstrap(counted(spark, sf_dir), key=PAIR)


@query("parsed_only", f"{B1} SELECT target_dim, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_selected FROM ofat WHERE parse_ok = 1 GROUP BY target_dim")
def parsed_only(spark, sf_dir):
    """Studies that leave out unread answers only."""
    return S.parsed_only(ofat(spark, sf_dir)).groupBy("target_dim").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_selected"))


@query("moderation", f"{B1}, {ate_sql('sc', 'model, factor')} SELECT model, factor, round(ATE, 6) AS ATE, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_treated, n_control FROM mate")
def moderation(spark, sf_dir):
    return rounded(E.marginal_ate(counted(spark, sf_dir), ["model", "factor"]))


@query("position_bias", f"{B1} SELECT target_position, round(avg(y), 6) AS selection_rate, count(*) AS n FROM af GROUP BY target_position")
def position_bias(spark, sf_dir):
    return rounded(E.position_bias(E.analysis_frame(ofat(spark, sf_dir))))


@query("position_adjusted", f"{B1} SELECT model, round(avg(r), 6) AS adj_rate FROM (SELECT model, target_position, avg(y) AS r FROM af GROUP BY model, target_position) GROUP BY model")
def position_adjusted(spark, sf_dir):
    return rounded(E.position_adjusted(E.analysis_frame(ofat(spark, sf_dir)), ["model"]))


@query("validity_report", f"""{B1} SELECT count(*) AS n_trials, round(avg(parse_ok), 6) AS parse_ok_rate, round(avg(y), 6) AS overall_selection_rate,
 (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT CAST(target_position AS VARCHAR) AS p FROM ofat)) AS positions_covered, count(DISTINCT model) AS n_models,
 (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT DISTINCT domain AS d FROM ofat)) AS domains FROM ofat""")
def validity_report(spark, sf_dir):
    return rounded(E.validity_report(ofat(spark, sf_dir)))


def _ranks(spark, sf_dir) -> DataFrame:
    ei = I.effective_information(I.experimental_do(counted(spark, sf_dir), ["model", "factor"]), ["model", "factor"])
    return I.common_factors(I.ranked(ei.select("model", "factor", "EI_norm")))


RANKS_SQL = f"""{B1}, {ei_sql('sc', 'model')},
rk AS (SELECT model, factor, EI, row_number() OVER (PARTITION BY model ORDER BY EI DESC, factor) - 1 AS r FROM ei),
cf AS (SELECT factor FROM rk GROUP BY factor HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM rk)),
rc AS (SELECT * FROM rk WHERE factor IN (SELECT factor FROM cf))"""


@query("kendall_w", f"""{RANKS_SQL}, s AS (SELECT factor, sum(r) AS t FROM rc GROUP BY factor), c AS (SELECT count(*) AS n, (SELECT count(DISTINCT model) FROM rc) AS k, avg(t) AS mu FROM s)
SELECT round(12 * (SELECT sum((t - mu) * (t - mu)) FROM s, c) / (k * k * (n * n * n - n)), 6) AS kendall_w, n AS n_factors, k AS n_models FROM c""")
def kendall_w(spark, sf_dir):
    return rounded(I.kendall_w(_ranks(spark, sf_dir)))


@query("ei_variance", f"{RANKS_SQL} SELECT factor, round(avg(EI), 6) AS EI_norm_mean, round(var_pop(EI), 8) AS EI_norm_var FROM rc GROUP BY factor")
def ei_variance(spark, sf_dir):
    return _ranks(spark, sf_dir).groupBy("factor").agg(r6(F.avg("EI_norm")).alias("EI_norm_mean"), F.round(F.var_pop("EI_norm"), 8).alias("EI_norm_var"))


@query("pairwise_spearman", f"""{RANKS_SQL}, d AS (SELECT model, factor, row_number() OVER (PARTITION BY model ORDER BY r) AS r FROM rc)
SELECT a.model AS model_a, b.model AS model_b, round(1 - 6.0 * sum((a.r - b.r) * (a.r - b.r)) / (count(*) * (count(*) * count(*) - 1)), 6) AS spearman FROM d a JOIN d b ON a.factor = b.factor AND a.model < b.model GROUP BY 1, 2""")
def pairwise_spearman(spark, sf_dir):
    return rounded(I.pairwise_spearman(_ranks(spark, sf_dir)))


@query("ei_by_stratum", f"{B1}, {ei_sql('sc', 'domain')}, {ate_sql('sc', 'domain, factor')} SELECT domain, factor, round(EI, 6) AS EI, round(ATE, 6) AS ATE, round(EI / sum(EI) OVER (PARTITION BY domain), 6) AS EI_share FROM ei JOIN mate USING (domain, factor)")
def ei_by_stratum(spark, sf_dir):
    return rounded(I.leverage(counted(spark, sf_dir), ["domain"]).select("domain", "factor", "EI", "ATE", "EI_share"))


def _grid(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, DOMAINS))).alias("domain")).select("domain", F.explode(F.array(*map(F.lit, FACTORS))).alias("factor"))


@query("domain_paired_ate", f"""{B1}, {pate_sql('domain, factor')}
SELECT domain, factor, round(coalesce(ATE, 0), 6) AS ATE, coalesce(n_pairs, 0) AS n_pairs FROM (SELECT unnest({DOMAINS}) AS domain) CROSS JOIN (SELECT unnest({FACTORS}) AS factor) LEFT JOIN pate USING (domain, factor)""")
def domain_paired_ate(spark, sf_dir):
    return rounded(E.domain_paired(counted(spark, sf_dir), _grid(spark), PAIR))


@query("viz_validity", f"""{B1} SELECT model, count(*) AS n_trials, round(avg(parse_ok), 6) AS parse_rate, count(*) FILTER (api_error <> '') AS n_errors, round(avg(y), 6) AS y_rate,
 count(DISTINCT query_id) AS n_queries, count(DISTINCT target_position) AS n_positions FROM ofat GROUP BY model""")
def viz_validity(spark, sf_dir):
    return rounded(ofat(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n_trials"), F.avg("parse_ok").alias("parse_rate"), F.count(F.when(F.col("api_error") != "", 1)).alias("n_errors"), F.avg("y").alias("y_rate"), F.count_distinct("query_id").alias("n_queries"), F.count_distinct("target_position").alias("n_positions")))


@query("viz_position", f"{B1} SELECT model, {', '.join(f'round(avg(y) FILTER (target_position = {p}), 6) AS p{p}' for p in range(7))} FROM af GROUP BY model")
def viz_position(spark, sf_dir):
    got = E.analysis_frame(ofat(spark, sf_dir)).groupBy("model").agg(*[F.avg(F.when(F.col("target_position") == p, F.col("y"))).alias(f"p{p}") for p in range(7)])
    return rounded(got)


def _by_model(spark, sf_dir) -> DataFrame:
    """Effect, interval and EI of each model and factor."""
    return I.leverage(counted(spark, sf_dir), ["model"]).select("model", "factor", "EI", "EI_norm", "ATE", "ate_ci_low", "ate_ci_high")


BY_MODEL_SQL = f"{B1}, {ei_sql('sc', 'model')}, {ate_sql('sc', 'model, factor')}, bm AS (SELECT model, factor, EI, ATE, ci_low AS lo, ci_high AS hi FROM ei JOIN mate USING (model, factor))"


@query("feature_compass", f"""{BY_MODEL_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY EI DESC, factor) AS rk FROM bm)
SELECT factor, round(avg(ATE), 6) AS mean_ate, round(median(ATE), 6) AS median_ate, round(stddev_pop(ATE), 6) AS std_ate, round(min(ATE), 6) AS min_ate, round(max(ATE), 6) AS max_ate, round(avg(EI), 6) AS mean_ei, round(median(EI), 6) AS median_ei,
 count(*) FILTER (rk = 1) AS n_rank1, count(*) FILTER (lo > 0) AS n_sig_pos, count(*) FILTER (hi < 0) AS n_sig_neg, count(*) FILTER (ATE > 0) AS n_pos, count(*) FILTER (ATE < 0) AS n_neg FROM k GROUP BY factor""")
def feature_compass(spark, sf_dir):
    k = I.ranked(_by_model(spark, sf_dir), value="EI")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rounded(
        k.groupBy("factor").agg(
            F.avg("ATE").alias("mean_ate"), F.median("ATE").alias("median_ate"), F.stddev_pop("ATE").alias("std_ate"), F.min("ATE").alias("min_ate"), F.max("ATE").alias("max_ate"), F.avg("EI").alias("mean_ei"), F.median("EI").alias("median_ei"),
            n(F.col("rank") == 0, "n_rank1"), n(F.col("ate_ci_low") > 0, "n_sig_pos"), n(F.col("ate_ci_high") < 0, "n_sig_neg"), n(F.col("ATE") > 0, "n_pos"), n(F.col("ATE") < 0, "n_neg"),
        )
    )


@query("callouts", f"""{BY_MODEL_SQL}, f AS (SELECT factor, avg(EI) AS m FROM bm GROUP BY factor), v AS (SELECT model, avg(parse_ok) AS r FROM ofat GROUP BY model)
SELECT (SELECT arg_max(model, (round(ATE, 9), model)) FROM bm WHERE factor = 'S1') AS s1_best_model, (SELECT arg_min(model, (round(ATE, 9), model)) FROM bm WHERE factor = 'S1') AS s1_worst_model,
 (SELECT arg_max(factor, (round(m, 9), factor)) FROM f) AS top_ei_factor, (SELECT round(min(r), 6) FROM v) AS min_parse_rate""")
def callouts(spark, sf_dir):
    bm = _by_model(spark, sf_dir)
    s1 = bm.where("factor = 'S1'").agg(F.max_by("model", F.struct(F.round("ATE", 9), "model")).alias("s1_best_model"), F.min_by("model", F.struct(F.round("ATE", 9), "model")).alias("s1_worst_model"))
    top = bm.groupBy("factor").agg(F.round(F.avg("EI"), 9).alias("m")).agg(F.max_by("factor", F.struct("m", "factor")).alias("top_ei_factor"))
    low = ofat(spark, sf_dir).groupBy("model").agg(F.avg("parse_ok").alias("r")).agg(r6(F.min("r")).alias("min_parse_rate"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(s1).join(one(top), "_one").join(one(low), "_one").drop("_one")


@query("domain_instability", f"""{B1}, {pate_sql('model, domain, factor')}, d AS (SELECT domain, factor, avg(ATE) AS mu FROM pate GROUP BY domain, factor), s AS (SELECT model, factor, stddev_samp(ATE) AS sd FROM pate GROUP BY model, factor)
SELECT factor, round(max(mu) - min(mu), 6) AS spread, (SELECT round(avg(sd), 6) FROM s WHERE s.factor = d.factor) AS mean_sd FROM d GROUP BY factor""")
def domain_instability(spark, sf_dir):
    pate = E.paired_ate(counted(spark, sf_dir), ["model", "domain", "factor"], PAIR)
    spread = pate.groupBy("domain", "factor").agg(F.avg("ATE").alias("mu")).groupBy("factor").agg((F.max("mu") - F.min("mu")).alias("spread"))
    sd = pate.groupBy("model", "factor").agg(F.stddev_samp("ATE").alias("sd")).groupBy("factor").agg(F.avg("sd").alias("mean_sd"))
    return rounded(spread.join(sd, "factor"))


@query("domain_sign_agreement", f"""{B1}, {pate_sql('model, domain, factor')}, mu AS (SELECT domain, factor, avg(ATE) AS mu FROM pate GROUP BY domain, factor)
SELECT domain, factor, round(any_value(mu), 6) AS mean_ate, count(*) FILTER (sign(ATE) = sign(mu)) AS n_same_sign, count(*) AS n_models FROM pate JOIN mu USING (domain, factor) GROUP BY domain, factor""")
def domain_sign_agreement(spark, sf_dir):
    pate = E.paired_ate(counted(spark, sf_dir), ["model", "domain", "factor"], PAIR)
    mu = F.avg("ATE").over(Window.partitionBy("domain", "factor"))
    marked = pate.withColumn("mu", mu)
    return rounded(marked.groupBy("domain", "factor").agg(F.max("mu").alias("mean_ate"), F.count(F.when(F.signum("ATE") == F.signum("mu"), 1)).alias("n_same_sign"), F.count(F.lit(1)).alias("n_models")))


@query("ate_scaled", f"{BY_MODEL_SQL} SELECT model, factor, round(coalesce(ATE / nullif(max(abs(ATE)) OVER (), 0), ATE), 6) AS ate_scaled FROM bm")
def ate_scaled(spark, sf_dir):
    bm = _by_model(spark, sf_dir)
    top = bm.agg(F.max(F.abs("ATE")).alias("top"))
    return rounded(bm.join(F.broadcast(top)).select("model", "factor", F.coalesce(F.col("ATE") / F.nullif("top", F.lit(0.0)), F.col("ATE")).alias("ate_scaled")))


@query("direction_label", f"""{BY_MODEL_SQL} SELECT model, factor, CASE WHEN lo > 0 THEN 'positive_significant' WHEN hi < 0 THEN 'negative_significant' WHEN ATE > 0 THEN 'positive' WHEN ATE < 0 THEN 'negative' ELSE 'zero' END AS direction FROM bm""")
def direction_label(spark, sf_dir):
    return _by_model(spark, sf_dir).select("model", "factor", E.direction(F.col("ATE"), F.col("ate_ci_low"), F.col("ate_ci_high")).alias("direction"))


@query("abs_ate_order", f"{BY_MODEL_SQL}, m AS (SELECT factor, round(avg(abs(ATE)), 6) AS mean_abs_ate FROM bm GROUP BY factor) SELECT factor, mean_abs_ate, CAST(row_number() OVER (ORDER BY mean_abs_ate DESC, factor) AS INTEGER) AS position FROM m")
def abs_ate_order(spark, sf_dir):
    m = _by_model(spark, sf_dir).groupBy("factor").agg(r6(F.avg(F.abs("ATE"))).alias("mean_abs_ate"))
    return m.withColumn("position", F.row_number().over(Window.orderBy(F.desc("mean_abs_ate"), "factor")))  # eight rows


@query("model_corr_distance", f"{BY_MODEL_SQL} SELECT a.model AS model_a, b.model AS model_b, round(1 - corr(a.ATE, b.ATE), 6) AS distance FROM bm a JOIN bm b ON a.factor = b.factor AND a.model < b.model GROUP BY 1, 2")
def model_corr_distance(spark, sf_dir):
    bm = _by_model(spark, sf_dir)
    other = bm.select(F.col("model").alias("model_b"), "factor", F.col("ATE").alias("b"))
    pairs = bm.select(F.col("model").alias("model_a"), "factor", "ATE").join(other, "factor").where("model_a < model_b")
    return rounded(pairs.groupBy("model_a", "model_b").agg((1 - F.corr("ATE", "b")).alias("distance")))


@query("model_linkage_order")
def model_linkage_order(spark, sf_dir):
    """The models in the order of the leaves of an average-linkage tree over their effects."""
    return I.linkage_order(_by_model(spark, sf_dir).select("model", "factor", "ATE"))


@query("display_names", f"{B1} SELECT DISTINCT model, CASE model WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' ELSE model END AS display FROM ofat")
def display_names(spark, sf_dir):
    """Names for tables; models that are not in the map keep their own."""
    names = F.create_map(*[F.lit(x) for pair in {"1-URGENT": "Urgent", "2-HIGH": "High"}.items() for x in pair])
    return ofat(spark, sf_dir).select("model").distinct().select("model", F.coalesce(F.try_element_at(names, F.col("model")), F.col("model")).alias("display"))


@query("union_models", f"{B1} SELECT model, 'slim' AS part, count(*) AS n, CAST(NULL AS BIGINT) AS n_positions FROM af WHERE model < '3' GROUP BY model UNION ALL SELECT model, 'full', count(*), count(DISTINCT target_position) FROM af WHERE model >= '3' GROUP BY model")
def union_models(spark, sf_dir):
    af = E.analysis_frame(ofat(spark, sf_dir))
    slim = af.where("model < '3'").groupBy("model").agg(F.lit("slim").alias("part"), F.count(F.lit(1)).alias("n"))
    full = af.where("model >= '3'").groupBy("model").agg(F.lit("full").alias("part"), F.count(F.lit(1)).alias("n"), F.count_distinct("target_position").alias("n_positions"))
    return slim.unionByName(full, allowMissingColumns=True)


COMBO = ["query_id", "model", "prompt_style", "target_position", "seed", "target_dim", "role"]


@query("resume_antijoin", f"""{B1}, combos AS (SELECT DISTINCT {', '.join(COMBO)} FROM ofat), done AS (SELECT DISTINCT {', '.join(COMBO)} FROM ofat WHERE api_error = '' AND y = 1)
SELECT c.* FROM combos c ANTI JOIN done d USING ({', '.join(COMBO)})""")
def resume_antijoin(spark, sf_dir):
    df = ofat(spark, sf_dir)
    return E.resume(df.select(*COMBO).distinct(), df.where("api_error = '' AND y = 1"), COMBO)


@query("dedup_keep_first", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_keep_first(spark, sf_dir):
    from leverframe.sources.tables import table

    return E.dedup_keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("distinct_counts", f"{B1} SELECT target_dim, count(DISTINCT query_id) AS n_queries, count(DISTINCT model) AS n_models, count(DISTINCT target_position) AS n_positions, count(DISTINCT domain) AS n_domains FROM ofat GROUP BY target_dim")
def distinct_counts(spark, sf_dir):
    return ofat(spark, sf_dir).groupBy("target_dim").agg(*[F.count_distinct(c).alias(n) for c, n in (("query_id", "n_queries"), ("model", "n_models"), ("target_position", "n_positions"), ("domain", "n_domains"))])


def _strata_sql() -> str:
    parts = []
    for f in FACTORS:
        adj = "query_id" if f in FACTORS[:4] else "query_id, S1, S2, S3, S4"
        parts.append(f"""SELECT '{f}' AS factor, x AS level, sum(w * p) / sum(w) AS p FROM
 (SELECT {adj}, {f} AS x, avg(y) AS p FROM obs GROUP BY {adj}, {f if f not in adj.split(', ') else 'x'}) c JOIN (SELECT {adj}, count(*) AS w FROM obs GROUP BY {adj}) a USING ({adj}) GROUP BY x""")
    return "bd AS (" + "\nUNION ALL ".join(parts) + ")"


@query("backdoor_stratify", f"{B2}, {_strata_sql()} SELECT factor, level, round(p, 6) AS p FROM bd")
def backdoor_stratify(spark, sf_dir):
    return rounded(I.backdoor_do(obs(spark, sf_dir)))


@query("backdoor_adjust", f"{B2}, {_strata_sql()} SELECT factor, level, round(p, 6) AS p FROM bd WHERE factor = 'S1' UNION ALL SELECT 'O1', O1, round(sum(w * p) / sum(w), 6) FROM (SELECT query_id, O1, avg(y) AS p FROM obs GROUP BY 1, 2) JOIN (SELECT query_id, count(*) AS w FROM obs GROUP BY 1) USING (query_id) GROUP BY O1 UNION ALL SELECT 'O2', O2, round(avg(y), 6) FROM obs GROUP BY O2")
def backdoor_adjust(spark, sf_dir):
    """The dispatcher: default set, a set with a column that the frame lacks, and none."""
    df = obs(spark, sf_dir)
    parts = [I.backdoor_adjust(df, "S1", "stratify"), I.backdoor_adjust(df, "O1", "stratify", ["query_id", "weather"]), I.backdoor_adjust(df, "O2", "stratify", [])]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _norm_sql(sign: str) -> str:
    return f"list_transform(embedding, lambda x: greatest({sign}CAST(x AS DOUBLE), 0))"


@query("kl_divergence", f"""WITH e AS (SELECT vec_id, {_norm_sql('')} AS a, {_norm_sql('-')} AS b FROM embeddings), n AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p, list_transform(b, lambda x: x / list_sum(b)) AS q FROM e)
SELECT vec_id, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 1e-12 THEN x * log2(x) ELSE 0 END)), 6) AS h, round(list_sum(list_transform(list_zip(p, q), lambda z: CASE WHEN z[1] > 1e-12 THEN z[1] * log2(z[1] / greatest(z[2], 1e-12)) ELSE 0 END)), 6) AS kl FROM n""")
def kl_divergence(spark, sf_dir):
    """Entropy of a vector's positive part and its divergence from the negative part, both brought to sum 1."""
    from leverframe.sources.tables import table

    negative = F.transform("embedding", lambda x: -x)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", I.entropy_of(F.col("embedding")).alias("h"), I.kl_bits(F.col("embedding"), negative).alias("kl")))


@query("do_distribution", f"{B2}, {_strata_sql()} SELECT factor, level, round(1 - p, 6) AS p0, round(p, 6) AS p1 FROM bd")
def do_distribution(spark, sf_dir):
    return rounded(I.backdoor_do(obs(spark, sf_dir)).select("factor", "level", (1 - F.col("p")).alias("p0"), F.col("p").alias("p1")))


BD_EI = f"m AS (SELECT factor, avg(p) AS q FROM bd GROUP BY factor), bei AS (SELECT factor, avg({KL('p', 'q')}) AS b FROM bd JOIN m USING (factor) GROUP BY factor)"


@query("route_consistency", f"{B2}, {ei_sql('obs_long')}, {_strata_sql()}, {BD_EI} SELECT factor, round(EI, 6) AS EI_experimental, round(b, 6) AS EI_backdoor, round(abs(EI - b), 6) AS abs_diff FROM ei JOIN bei USING (factor)")
def route_consistency(spark, sf_dir):
    return rounded(I.route_consistency(obs(spark, sf_dir)))


@query("entropy", f"{B2}, {_strata_sql()} SELECT factor, level, round({H('p')}, 6) AS h FROM bd")
def entropy(spark, sf_dir):
    return rounded(I.backdoor_do(obs(spark, sf_dir)).select("factor", "level", I.entropy_bits(F.col("p")).alias("h")))


@query("ei_multiclass", """WITH d AS (SELECT l_returnflag AS factor, l_linenumber AS x, l_shipmode3 AS s, count(*) AS n FROM (SELECT l_returnflag, l_linenumber, CAST(l_quantity AS BIGINT) % 3 AS l_shipmode3 FROM lineitem) GROUP BY 1, 2, 3),
p AS (SELECT factor, x, s, n / sum(n) OVER (PARTITION BY factor, x) AS p FROM d), m AS (SELECT factor, s, avg(p) AS q FROM p GROUP BY factor, s),
e AS (SELECT factor, sum(p * log2(p / q)) / count(DISTINCT x) AS EI, count(DISTINCT x) AS nx, count(DISTINCT s) AS ny FROM p JOIN m USING (factor, s) GROUP BY factor)
SELECT factor, round(EI, 8) AS EI, CAST(nx AS INTEGER) AS n_states_x, CAST(ny AS INTEGER) AS n_states_y, round(EI / log2(ny), 8) AS EI_norm FROM e""")
def ei_multiclass(spark, sf_dir):
    from leverframe.sources.tables import table

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("factor"), F.col("l_linenumber").alias("x"), (F.col("l_quantity").cast("long") % 3).alias("s"))
    do = rows.groupBy("factor", "x", "s").count().select("factor", "x", "s", F.col("count").cast("double").alias("p"))
    ei = I.effective_information_states(do, ["factor"], "x", "s")
    return ei.select("factor", F.round("EI", 8).alias("EI"), "n_states_x", "n_states_y", F.round("EI_norm", 8).alias("EI_norm"))


@query("mediation", f"""{B2}, r AS (SELECT CASE WHEN O4 > 0 THEN 'p' ELSE 'a' END AS m, avg(y) FILTER (S1 = 2) - avg(y) FILTER (S1 = 0) AS d FROM obs GROUP BY 1)
SELECT 'S1' AS cause, 'O4' AS moderator, round((SELECT d FROM r WHERE m = 'p'), 6) AS ate_moderator_present, round((SELECT d FROM r WHERE m = 'a'), 6) AS ate_moderator_absent,
 round((SELECT d FROM r WHERE m = 'p') - (SELECT d FROM r WHERE m = 'a'), 6) AS amplification""")
def mediation(spark, sf_dir):
    return rounded(E.mediation(obs(spark, sf_dir)))


@query("deception_gain", f"""{B3}, g AS (SELECT fakeable_dim AS factor, avg(y) FILTER (present = 0) AS p_none, avg(y) FILTER (variant = 'genuine') AS p_genuine, avg(y) FILTER (variant = 'fake') AS p_fake FROM dec GROUP BY 1)
SELECT factor, round(p_none, 6) AS p_none, round(p_genuine, 6) AS p_genuine, round(p_fake, 6) AS p_fake, round(p_fake - p_none, 6) AS deception_gain, round(p_genuine - p_fake, 6) AS discount, round(p_fake / nullif(p_genuine, 0), 6) AS vulnerability FROM g""")
def deception_gain(spark, sf_dir):
    return rounded(I.deception_gain(deception(spark, sf_dir)))


@query("delta_ei", f"""{B3}, g AS (SELECT fakeable_dim AS factor, avg(y) FILTER (variant = 'none') AS a, avg(y) FILTER (variant = 'genuine') AS g, avg(y) FILTER (variant = 'fake') AS f FROM dec GROUP BY 1),
e AS (SELECT factor, ({KL('a', '((a + g) / 2)')} + {KL('g', '((a + g) / 2)')}) / 2 AS eg, ({KL('a', '((a + f) / 2)')} + {KL('f', '((a + f) / 2)')}) / 2 AS ef FROM g)
SELECT factor, round(eg, 6) AS EI_genuine, round(ef, 6) AS EI_fake, round(ef - eg, 6) AS delta_EI FROM e""")
def delta_ei(spark, sf_dir):
    return rounded(I.delta_ei(deception(spark, sf_dir)))
