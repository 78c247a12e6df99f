"""Numbers of rows in an order, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leverframe.sources.files import stored


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 1 within their group ``by`` (all rows if empty) in the order of the columns ``order``, which tell them apart.

    Rows are dealt out by ranges of group and order, so a large group fills many tasks; a row's number is its place among
    the group's rows in its own range and their count in the ranges before, of which there are at most as many as
    shuffle partitions.
    """
    p = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(p, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    group = by or [F.lit(0)]
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_of"), before.alias("_before"))
    local = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_range") == F.col("_of"))
    return local.join(offsets, same).select(*rows.columns, (F.col("_place") + F.col("_before")).cast("int").alias(name))
