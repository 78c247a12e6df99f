"""The library's measures as SQL functions, so that queries in SQL text can call them; all are expressions in SQL themselves."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name with parameters, type and body of each. Arrays are clipped at 0 and brought to sum 1 before they are measured; logarithms are base 2.
FUNCTIONS = [
    ("plogp(x DOUBLE)", "DOUBLE", "CASE WHEN x > 1e-12D THEN x * log2(x) ELSE 0D END"),
    ("entropy_bits(p DOUBLE)", "DOUBLE", "- plogp(p) - plogp(1D - p)"),
    ("brought_to_one(p ARRAY<DOUBLE>)", "ARRAY<DOUBLE>", "transform(array(aggregate(p, 0D, (s, x) -> s + greatest(x, 0D))), t -> transform(p, x -> CASE WHEN t > 0 THEN greatest(x, 0D) / t ELSE 1D / size(p) END))[0]"),
    ("entropy_of(p ARRAY<DOUBLE>)", "DOUBLE", "- aggregate(brought_to_one(p), 0D, (s, x) -> s + CASE WHEN x > 1e-12D THEN x * log2(x) ELSE 0D END)"),
    ("kl_bits(p ARRAY<DOUBLE>, q ARRAY<DOUBLE>)", "DOUBLE", "aggregate(zip_with(brought_to_one(p), brought_to_one(q), (a, b) -> CASE WHEN a > 1e-12D THEN a * log2(a / greatest(b, 1e-12D)) ELSE 0D END), 0D, (s, x) -> s + x)"),
    # Effective Information of yes/no outcomes from the levels' probabilities; null below two levels.
    (
        "effective_information(p ARRAY<DOUBLE>)", "DOUBLE",
        "CASE WHEN size(p) >= 2 THEN entropy_bits(aggregate(p, 0D, (s, x) -> s + x) / size(p)) - aggregate(p, 0D, (s, x) -> s - CASE WHEN x > 1e-12D THEN x * log2(x) ELSE 0D END - CASE WHEN 1D - x > 1e-12D THEN (1D - x) * log2(1D - x) ELSE 0D END) / size(p) END",
    ),
    # A candidate set as rows: place from 0, letter and id.
    ("explode_candidates(ids ARRAY<STRING>)", "TABLE (pos INT, letter STRING, id STRING)", "SELECT pos, char(65 + pos), col FROM posexplode(ids)"),
]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
