"""Incremental trials: a deduplicated stream of finished trials, appended as they come and re-aggregated in batches."""

from __future__ import annotations

import hashlib
import logging
import time as clock
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leverframe.sources.files import exists, scratch

LOG = logging.getLogger(__name__)


def stream_of(spark: SparkSession, path: str, schema: str, time: str, files: int | None = None) -> DataFrame:
    """Rows of a folder of parquet files as they arrive, at most ``files`` in a batch."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def trial_stream(spark: SparkSession, path: str, schema: str, keys: list[str], time: str, delay: str = "1 hour", files: int | None = None) -> DataFrame:
    """A stream's rows; of rows with equal keys and time the first is kept while the watermark's delay has not passed, then the state is dropped.

    Rows that come later than the delay are dropped, too. For rows that may come as late as they like, leave the
    deduplication to ``run_incremental`` with ``keys``, which needs no state.
    """
    return stream_of(spark, path, schema, time, files).withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, time])


def run_incremental(
    rows: DataFrame, refresh: Callable[[DataFrame], None], every_rows: int = 100, every_seconds: float = 300.0, least_rows: int = 4, keys: list[str] | None = None, out: str | None = None, state: str | None = None
) -> str:
    """Appends each micro-batch to a table and calls ``refresh`` with the whole table after ``every_rows`` new rows or ``every_seconds``.

    Of rows with equal ``keys`` one is kept over all batches and runs: a batch is deduplicated and then held against the
    stored keys by an anti-join, so no state grows. ``out`` and ``state`` (the stream's checkpoint) let a run that was
    stopped go on: a batch is written under its checkpoint and number, so a replayed one replaces itself, and a new
    checkpoint over the same ``out`` takes in only what is not stored yet. The stored columns are adopted: others are
    dropped, missing ones are null. Only rows with parse_ok = 1 count where there is such a column, and refreshing waits
    for ``least_rows`` of them. A refresh that fails is logged, the last one at the end raises. Returns the table's path.
    """
    spark = rows.sparkSession
    out, state = out or scratch(spark, "trials"), state or scratch(spark, "trials-state")
    run = hashlib.sha256(state.encode()).hexdigest()[:12]
    counts = {"new": 0, "all": 0, "at": clock.monotonic()}
    whole = lambda: spark.read.option("basePath", out).parquet(out)
    good = lambda df: (df.where("parse_ok = 1") if "parse_ok" in df.columns else df).count()
    if exists(spark, out):
        counts["all"] = good(whole())

    def sink(batch: DataFrame, number: int) -> None:
        if keys:
            batch = batch.dropDuplicates(keys)
        if exists(spark, out):
            stored = whole()
            kept = [(c, t) for c, t in stored.dtypes if c not in ("run", "batch")]
            batch = batch.select(*[(F.col(c) if c in batch.columns else F.lit(None)).cast(t).alias(c) for c, t in kept])
            if keys:
                old = stored.where(~((F.col("run") == run) & (F.col("batch") == number))).select(*[F.col(k).alias(f"_{k}") for k in keys])
                batch = batch.join(old, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
        at = f"{out}/run={run}/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        n = good(spark.read.parquet(at))
        counts["new"] += n
        counts["all"] += n
        if counts["all"] >= least_rows and (counts["new"] >= every_rows or clock.monotonic() - counts["at"] >= every_seconds):
            counts.update(new=0, at=clock.monotonic())
            try:
                refresh(whole())
            except Exception:
                LOG.exception("refresh failed; the next one will try again")

    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if counts["all"] >= least_rows:
        refresh(whole())
    return out


def sliding(rows: DataFrame, time: str = "ts", size: str = "2 days", slide: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts of a watermarked stream by sliding window; rows whose windows all ended before the watermark are late and dropped."""
    return rows.groupBy(F.window(time, size, slide).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(rows: DataFrame, time: str = "ts", gap: str = "6 hours", by: str = "user_id") -> DataFrame:
    """Sessions of a watermarked stream: rows of ``by`` with less than ``gap`` between neighbours; start, last (start of the gap after it) and n."""
    out = rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))
    return out.select(F.col("w.start").alias("start"), by, "last", "n")


def run_windows(aggregated: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """The state of an aggregated stream over what is there: of each key the row of its latest batch, as update mode sends changed rows only, and append mode each closed one once; the last batch's rows in complete mode."""
    spark, out = aggregated.sparkSession, scratch(aggregated.sparkSession, "windows")
    kind = aggregated.schema

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    aggregated.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", scratch(spark, "windows-state")).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in kind.names if c not in keys]
    rows = spark.read.option("basePath", out).parquet(out)
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).select(*kind.names)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def windowed(rows: DataFrame, time: str = "ts", size: str = "1 day") -> DataFrame:
    """Counts and sums of a stream by tumbling window and event type."""
    return rows.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_complete(aggregated: DataFrame) -> str:
    """Runs an aggregated stream over what is there and writes its whole result after each batch; returns the path of the last."""
    spark = aggregated.sparkSession
    paths: list[str] = []

    def sink(batch: DataFrame, number: int) -> None:
        paths.append(scratch(spark, "windows"))
        batch.write.parquet(paths[-1])

    query = aggregated.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", scratch(spark, "windows-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return paths[-1]
