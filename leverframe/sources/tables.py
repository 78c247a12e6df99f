"""Scans of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, core_bytes: int = 8 << 20) -> DataFrame:
    """``df``, dealt out evenly if its files hold less than ``core_bytes`` for each core.

    A file is not split below its row groups, so a small table may otherwise be one task, however dear its rows are to
    work on. Larger tables have splits enough and stay where they lie. The size is the optimizer's estimate; nothing runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * core_bytes else df
