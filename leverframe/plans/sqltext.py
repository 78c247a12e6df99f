"""Queries written in SQL text, on the library's SQL functions."""

from __future__ import annotations

from leverframe.functions.sql import register
from leverframe.plans.effects import B1, ei_sql
from leverframe.plans.registry import SQL, query, rounded
from leverframe.plans.trials import SETS_SQL, _sets
from leverframe.sources.bindings import ofat
from leverframe.sources.tables import table


@query("sql_kl", SQL["kl_divergence"])
def sql_kl(spark, sf_dir):
    register(spark)
    rows = table(spark, sf_dir, "embeddings")
    return rounded(spark.sql("SELECT vec_id, entropy_of(cast(embedding AS ARRAY<DOUBLE>)) AS h, kl_bits(cast(embedding AS ARRAY<DOUBLE>), transform(embedding, x -> cast(-x AS DOUBLE))) AS kl FROM {rows}", rows=rows))


@query("sql_candidates", f"{SETS_SQL} SELECT CAST(pos AS INTEGER) AS pos, chr(CAST(65 + pos AS INTEGER)) AS letter, count(*) AS n, count(DISTINCT id) AS n_ids, count(*) FILTER (id = target_id) AS n_targets FROM (SELECT target_id, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS id FROM st) GROUP BY pos")
def sql_candidates(spark, sf_dir):
    register(spark)
    return spark.sql("SELECT c.pos, c.letter, count(*) AS n, count(DISTINCT c.id) AS n_ids, count_if(c.id = s.target_id) AS n_targets FROM {sets} s, LATERAL explode_candidates(s.ordered_ids) c GROUP BY c.pos, c.letter", sets=_sets(spark, sf_dir))


@query("sql_leverage", f"{B1}, {ei_sql('sc', 'model')} SELECT model, factor, round(EI, 6) AS EI FROM ei")
def sql_leverage(spark, sf_dir):
    """Effective Information of each factor for each model, in one SQL text."""
    from leverframe.operators import effects as E

    register(spark)
    long = E.scoped(E.analysis_frame(ofat(spark, sf_dir)))
    return rounded(spark.sql("WITH d AS (SELECT model, factor, level, avg(y) AS p FROM {long} WHERE level IS NOT NULL GROUP BY model, factor, level) SELECT model, factor, effective_information(collect_list(p)) AS EI FROM d GROUP BY model, factor HAVING count(*) >= 2", long=long))
