"""Trial frames bound to the driver's tables, and the same frames as SQL for the oracle.

``ofat`` has randomised one-factor-at-a-time pairs, ``obs`` a confounded observational frame, ``deception`` genuine and
fake variants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leverframe.codebook import DOMAINS, FACTORS
from leverframe.sources.tables import table


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])


def ofat(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _trials(spark, sf_dir).withColumns(
        {"qn": F.col("o_custkey") % 20, "dimn": (F.col("l_partkey") % 8).cast("int"), "tr": F.when(F.col("l_linestatus") == "O", 1).otherwise(0)}
    )
    dim = F.element_at(F.array(*map(F.lit, FACTORS)), F.col("dimn") + 1)
    top = {i: F.when(F.col("dimn") == i, F.col("tr")).otherwise(0).cast("int") for i in range(1, 7)}
    score = F.col("l_quantity") + F.col("tr") * (2 * F.col("dimn") - 3) - (F.col("l_linenumber") - 1)
    return base.select(
        F.concat(F.lit("q"), F.col("qn").cast("string")).alias("query_id"),
        F.element_at(F.array(*map(F.lit, DOMAINS)), (F.col("qn") % 5 + 1).cast("int")).alias("domain"),
        F.col("o_orderpriority").alias("model"),
        F.col("l_returnflag").alias("prompt_style"),
        (F.col("l_linenumber") - 1).cast("int").alias("target_position"),
        F.lit(0).alias("seed"),
        dim.alias("target_dim"),
        F.when(F.col("tr") == 1, "treatment").otherwise("control").alias("role"),
        F.when(F.col("dimn") == 7, 2).when(F.col("dimn") == 0, 2 * F.col("tr")).otherwise(0).cast("int").alias("S1"),
        *[top[i].alias(FACTORS[i]) for i in range(1, 7)],
        F.when(F.col("dimn") == 7, 2 * F.col("tr")).otherwise(0).cast("int").alias("O4"),
        F.when(F.col("l_tax") < 0.075, 1).otherwise(0).alias("parse_ok"),
        F.when(F.col("l_discount") > 0.095, "content_filter").otherwise("").alias("api_error"),
        F.when(score > 30, 1).otherwise(0).alias("y"),
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.floor(F.col("l_partkey") / float(k))
    q = F.col("o_custkey") % 20
    s1 = F.when(F.col("l_suppkey") % 10 < 2 + F.floor(q / 4.0), F.when(F.col("l_suppkey") % 2 == 0, 2).otherwise(1)).otherwise(0)
    return _trials(spark, sf_dir).select(
        F.concat(F.lit("q"), q.cast("string")).alias("query_id"),
        F.col("o_orderpriority").alias("model"),
        (F.col("l_linenumber") - 1).cast("int").alias("target_position"),
        s1.cast("int").alias("S1"),
        *[(part(k) % 2).cast("int").alias(f) for f, k in (("S2", 1), ("S3", 2), ("S4", 4), ("O1", 8), ("O2", 16))],
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("O3"),
        (part(32) % 3).cast("int").alias("O4"),
        F.when(F.col("l_quantity") + 3 * (F.col("l_suppkey") % 2) + q > 35, 1).otherwise(0).alias("y"),
    )


def deception(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_partkey") % 2 == 0, "S1").otherwise("S3").alias("fakeable_dim"),
        F.element_at(F.array(F.lit("none"), F.lit("genuine"), F.lit("fake")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("variant"),
        "l_quantity",
    )
    lift = F.when(F.col("variant") == "genuine", 6).when(F.col("variant") == "fake", 3).otherwise(0)
    return v.select(
        "fakeable_dim",
        "variant",
        F.when(F.col("variant") == "fake", "fake").otherwise("genuine").alias("authenticity"),
        F.when((F.col("fakeable_dim") == "S1") & (F.col("variant") != "none"), 2).otherwise(0).alias("S1"),
        F.when((F.col("fakeable_dim") == "S3") & (F.col("variant") != "none"), 1).otherwise(0).alias("S3"),
        F.when(F.col("l_quantity") + lift > 30, 1).otherwise(0).alias("y"),
    )


OFAT_SQL = """ofat AS (
SELECT concat('q', CAST(qn AS VARCHAR)) AS query_id,
  CASE qn % 5 WHEN 0 THEN 'consumer_product' WHEN 1 THEN 'health' WHEN 2 THEN 'finance' WHEN 3 THEN 'academic_qa' ELSE 'travel' END AS domain,
  model, prompt_style, target_position, 0 AS seed,
  CASE dimn WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' WHEN 2 THEN 'S3' WHEN 3 THEN 'S4' WHEN 4 THEN 'O1' WHEN 5 THEN 'O2' WHEN 6 THEN 'O3' ELSE 'O4' END AS target_dim,
  CASE WHEN tr = 1 THEN 'treatment' ELSE 'control' END AS role,
  CASE WHEN dimn = 7 THEN 2 WHEN dimn = 0 THEN 2 * tr ELSE 0 END AS S1,
  CASE WHEN dimn = 1 THEN tr ELSE 0 END AS S2, CASE WHEN dimn = 2 THEN tr ELSE 0 END AS S3, CASE WHEN dimn = 3 THEN tr ELSE 0 END AS S4,
  CASE WHEN dimn = 4 THEN tr ELSE 0 END AS O1, CASE WHEN dimn = 5 THEN tr ELSE 0 END AS O2, CASE WHEN dimn = 6 THEN tr ELSE 0 END AS O3,
  CASE WHEN dimn = 7 THEN 2 * tr ELSE 0 END AS O4,
  CASE WHEN l_tax < 0.075 THEN 1 ELSE 0 END AS parse_ok,
  CASE WHEN l_discount > 0.095 THEN 'content_filter' ELSE '' END AS api_error,
  CASE WHEN l_quantity + tr * (2 * dimn - 3) - target_position > 30 THEN 1 ELSE 0 END AS y
FROM (SELECT o_custkey % 20 AS qn, o_orderpriority AS model, l_returnflag AS prompt_style, CAST(l_linenumber - 1 AS INTEGER) AS target_position,
             CAST(l_partkey % 8 AS INTEGER) AS dimn, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS tr, l_quantity, l_tax, l_discount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b),
af AS (SELECT * FROM ofat WHERE coalesce(api_error, '') = '' AND parse_ok = 1),
sc AS (SELECT *, target_dim AS factor, CASE target_dim WHEN 'S1' THEN S1 WHEN 'S2' THEN S2 WHEN 'S3' THEN S3 WHEN 'S4' THEN S4 WHEN 'O1' THEN O1 WHEN 'O2' THEN O2 WHEN 'O3' THEN O3 ELSE O4 END AS level,
              CASE WHEN target_dim IN ('S1', 'O4') THEN 2 ELSE 1 END AS top,
              concat_ws('|', query_id, model, prompt_style, CAST(target_position AS VARCHAR), CAST(seed AS VARCHAR), concat(query_id, '|', target_dim)) AS pair_key FROM af)"""

OBS_SQL = """obs AS (
SELECT concat('q', CAST(o_custkey % 20 AS VARCHAR)) AS query_id, o_orderpriority AS model, CAST(l_linenumber - 1 AS INTEGER) AS target_position,
  CASE WHEN l_suppkey % 10 < 2 + floor((o_custkey % 20) / 4.0) THEN CASE WHEN l_suppkey % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS S1,
  CAST(l_partkey % 2 AS INTEGER) AS S2, CAST(floor(l_partkey / 2.0) AS INTEGER) % 2 AS S3, CAST(floor(l_partkey / 4.0) AS INTEGER) % 2 AS S4,
  CAST(floor(l_partkey / 8.0) AS INTEGER) % 2 AS O1, CAST(floor(l_partkey / 16.0) AS INTEGER) % 2 AS O2,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS O3, CAST(floor(l_partkey / 32.0) AS INTEGER) % 3 AS O4,
  CASE WHEN l_quantity + 3 * (l_suppkey % 2) + (o_custkey % 20) > 35 THEN 1 ELSE 0 END AS y
FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
obs_long AS (
""" + "\nUNION ALL ".join(f"SELECT query_id, S1, S2, S3, S4, '{f}' AS factor, {f} AS level, {2 if f in ('S1', 'O4') else 1} AS top, y FROM obs" for f in FACTORS) + ")"

DECEPTION_SQL = """dec AS (
SELECT fakeable_dim, variant, CASE WHEN variant = 'fake' THEN 'fake' ELSE 'genuine' END AS authenticity,
  CASE WHEN variant <> 'none' THEN 1 ELSE 0 END AS present,
  CASE WHEN l_quantity + CASE variant WHEN 'genuine' THEN 6 WHEN 'fake' THEN 3 ELSE 0 END > 30 THEN 1 ELSE 0 END AS y
FROM (SELECT CASE WHEN l_partkey % 2 = 0 THEN 'S1' ELSE 'S3' END AS fakeable_dim,
        CASE l_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'genuine' ELSE 'fake' END AS variant, l_quantity FROM lineitem) v)"""
