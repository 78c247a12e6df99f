"""A training corpus from ``documents``: quality rules, quality classifier, exact dedup, near-dedup, packing.

Each stage's result is written as Parquet and read again as the next one's documents; a stage's files are deleted once
the next one's are written. All stages but the last return the columns of documents.

Results for odd input: null and empty texts fail the base rules and go; of rows that repeat an id or a text one of each
class of near copies stays; very long texts pass whole; columns of any names pass through unchanged until packing, which
returns its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leverframe.llm import exact_dedup, near_dedup, packing, quality_model, quality_rules
from leverframe.llm.common import delete, scratch
from leverframe.llm.queries import VOCABULARY, table
from leverframe.sources.tables import spread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [("quality_rules", rules), ("quality_classifier", classifier), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: No SQL: the rules hash n-grams, the classifier fits weights and near-dedup is seeded; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spread(table(spark, sf_dir, "documents")), None
    for name, stage in STAGES:
        path = scratch(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
