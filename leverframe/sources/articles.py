"""Article, variant and audit frames bound to the documents, with marker phrases planted by id so that every rule is met."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leverframe.sources.tables import table

#: Planted phrases, by doc_id.
PHRASES = ["", "机构统计 12% 来源 ", "研究表明 但是 ", "机制 核心优势 ", "结论先行 适用场景 ", "(证据: 数据) ", "紧邻 ", "\n- 要点 | "]
#: Planted titles, by doc_id.
TITLES = ["《中国统计年鉴2023》", "《地下城与勇士》", "《某玩家行为报告》", "《城市年度报告》", "《临床指南》", "《Journal of Tests》", "《普通书名》", "", "《中国统计年鉴2023》《普通书名》"]
VARIANTS, GENERATORS = ["none", "genuine", "fake"], ["llm", "llm", "template_fallback", "llm"]


def pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, doc_id, query_id, domain, dim, variant, generator, base_text, text, n_chars."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("base_text"))
    out = docs.select(
        F.concat(F.lit("a"), d.cast("string")).alias("article_id"),
        "doc_id",
        F.concat(F.lit("q"), (d % 50).cast("string")).alias("query_id"),
        F.col("lang").alias("domain"),
        F.when(d % 2 == 0, "S1").otherwise("S3").alias("dim"),
        pick(VARIANTS, d).alias("variant"),
        pick(GENERATORS, d).alias("generator"),
        "base_text",
        F.concat(pick(PHRASES, d), pick(TITLES, d), F.when(d % 11 == 0, "内部渠道").otherwise(""), "base_text").alias("text"),
    )
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _case(values: list[str], index: str) -> str:
    return f"list_extract([{', '.join(chr(39) + v + chr(39) for v in values)}], CAST({index} % {len(values)} + 1 AS BIGINT))"


ARTICLES_SQL = f"""articles AS (SELECT *, length(text) AS n_chars FROM (
SELECT concat('a', CAST(doc_id AS VARCHAR)) AS article_id, doc_id, concat('q', CAST(doc_id % 50 AS VARCHAR)) AS query_id, lang AS domain, CASE WHEN doc_id % 2 = 0 THEN 'S1' ELSE 'S3' END AS dim,
  {_case(VARIANTS, 'doc_id')} AS variant, {_case(GENERATORS, 'doc_id')} AS generator, coalesce(text, '') AS base_text,
  {_case(PHRASES, 'doc_id')} || {_case(TITLES, 'doc_id')} || CASE WHEN doc_id % 11 = 0 THEN '内部渠道' ELSE '' END || coalesce(text, '') AS text FROM documents))"""
