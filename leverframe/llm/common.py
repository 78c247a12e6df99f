"""Helpers shared by the corpus operators: checkpoint folder, narrow cuts of lineage, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leverframe.sources.files import made

#: White space between words, as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session names none and runs on this machine alone (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts the lineage of narrow tables that are read again. ``drop`` deletes it."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Within the block, whole texts go to Python at most ``rows`` at a time, to bound a worker's memory; for tables that are written inside it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    if before > rows or before <= 0:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(*cuts: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that nothing reads any more."""
    for df in cuts:
        delete(df.sparkSession, df.cut_path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, which ``leverframe.sources.files.clear`` deletes with the others."""
    return made(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_grouped(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left outer join of ``left`` with ``right``, which has one row per ``key`` and in ``size`` the number of left rows with that key.

    A key with more than total / (4 P) of the ``total`` left rows (P: shuffle partitions) is hot. There are at most
    4 P such keys whatever the data, so their rows of ``right`` are broadcast; left rows that found their match there
    are dealt out by a random-looking key in the shuffle for all the others.
    """
    p = partitions(left.sparkSession)
    hot_at = max(1, total // (4 * p))
    cols = [c for c in right.columns if c != key]
    hot = right.where(F.col(size) > hot_at).select(F.col(key).alias("_hk"), F.struct(*cols).alias("_hot"))
    cold = right.where(F.col(size) <= hot_at).select(F.col(key).alias("_ck"), F.struct(*cols).alias("_cold"))
    spread = F.concat(F.lit("\x01"), F.xxhash64(*[F.col(c) for c in left.columns if c != key]).cast("string"))
    out = left.join(F.broadcast(hot), left[key] == F.col("_hk"), "left").withColumn(
        "_jk", F.when(F.col("_hk").isNotNull(), spread).otherwise(F.col(key).cast("string"))
    )
    out = out.join(cold.withColumn("_ck", F.col("_ck").cast("string")), F.col("_jk") == F.col("_ck"), "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in cols])


def set_aside(df: DataFrame, *used: str) -> DataFrame:
    """``df`` with its columns renamed by their place, but for those ``used``, so that no name of theirs can clash; ``brought_back`` undoes it."""
    return df.toDF(*[c if c in used else f"_own_{i}" for i, c in enumerate(df.columns)])


def brought_back(df: DataFrame, aside: DataFrame, like: DataFrame, *results: str) -> DataFrame:
    """``df`` with the columns of ``like``, of which ``aside`` is ``set_aside``, and then ``results``, which replace columns of their names."""
    mine = [F.col(a).alias(c) for a, c in zip(aside.columns, like.columns, strict=True) if c.lower() not in results]
    return df.select(*mine, *results)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def keep_decided(keyed: DataFrame, groups: DataFrame, bound: int = 100_000) -> DataFrame:
    """Rows of ``keyed`` (with ``_digest``) without those that their group drops.

    ``groups`` has a row per ``_digest`` that is in a group of several, with ``_keep``, the id that stays, and ``_stays``,
    whether it stays with this digest. Texts outside groups pass in place: the groups are broadcast where a count shows
    that they are at most ``bound`` rows, else both sides are shuffled, where adaptive execution splits a skewed digest.
    Of rows that repeat the kept id and text, one stays.
    """
    n = groups.limit(bound + 1).count()
    named = groups.withColumn("_grouped", F.lit(True))
    out = keyed.join(F.broadcast(named) if n <= bound else named, "_digest", "left")
    plain = out.where(F.col("_grouped").isNull())
    one = out.where(F.col("_grouped") & F.col("_stays") & F.col("doc_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_digest"])
    return plain.unionByName(one)
