"""Queries on statistical models, and on the incremental stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from leverframe.codebook import FACTORS
from leverframe.operators import effects as E
from leverframe.operators import models as M
from leverframe.plans.registry import query, rounded
from leverframe.sources.bindings import obs, ofat
from leverframe.sources.files import scratch
from leverframe.sources.tables import table
from leverframe.streaming.trials import run_complete, run_incremental, run_windows, sessions, sliding, stream_of, windowed


@query("logit_cluster")
def logit_cluster(spark, sf_dir):
    return rounded(M.logit_with_clusters(obs(spark, sf_dir), FACTORS, [("S1", "O4")]))


@query("gcomp")
def gcomp(spark, sf_dir):
    return rounded(M.gcomp(obs(spark, sf_dir), "S1", "query_id", [0, 1, 2]))


@query("position_slope")
def position_slope(spark, sf_dir):
    af = E.analysis_frame(ofat(spark, sf_dir))
    return rounded(E.position_bias(af).withColumn("logit_slope", F.lit(M.slope(af))))


@query("interaction_test")
def interaction_test(spark, sf_dir):
    """Does the effect of the evidence differ between models?"""
    return rounded(M.interaction_test(obs(spark, sf_dir), "S1", "model"))


@query("mixed_logit")
def mixed_logit(spark, sf_dir):
    return rounded(M.mixed_logit(obs(spark, sf_dir), ["S1", "S2", "O3"]))


@query("power_table")
def power_table(spark, sf_dir):
    """Power of each model's trials to find an odds ratio of 1.5 on top of its own rate."""
    rate = ofat(spark, sf_dir).groupBy("model").agg(F.avg("y").alias("p1"), F.count(F.lit(1)).alias("n"))
    odds = F.col("p1") / (1 - F.col("p1")) * 1.5
    return rounded(M.power_table(rate.withColumn("p2", odds / (1 + odds))))


EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def _arriving(spark, sf_dir) -> str:
    """The events as several files, that a stream takes up a few at a time."""
    path = scratch(spark, "arriving")
    table(spark, sf_dir, "events").repartition(6, "event_id").write.parquet(path)
    return path


@query("stream_trials", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT DISTINCT ON (user_id, event_type, ts) * FROM events) GROUP BY event_type")
def stream_trials(spark, sf_dir):
    """Events streamed from files that come in any order, deduplicated by key against the stored ones, appended in batches and taken up again by a second run; every few rows the table is aggregated anew, and the last state is the result."""
    state: list[str] = []

    def refresh(rows):
        state.append(scratch(spark, "trials-table"))
        rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).write.parquet(state[-1])

    arriving = _arriving(spark, sf_dir)
    keys, out = ["user_id", "event_type", "ts"], scratch(spark, "trials")
    run_incremental(stream_of(spark, arriving, EVENTS, "ts", files=3), refresh, every_rows=100, keys=keys, out=out)
    # a second run with a new checkpoint sees all files again and adds nothing
    run_incremental(stream_of(spark, arriving, EVENTS, "ts", files=6), refresh, every_rows=10**9, keys=keys, out=out)
    return rounded(spark.read.parquet(state[-1]))


@query("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling windows of a stream, kept complete from batch to batch."""
    rows = stream_of(spark, _arriving(spark, sf_dir), EVENTS, "ts", files=3)
    got = spark.read.parquet(run_complete(windowed(rows)))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


#: In the order of their arrival, six files of five days each; some rows of the first four come with the last file. Spark
#: holds rows against the watermark that the batch before was run with, hence that of the files up to the last but one.
ARRIVAL_SQL = """WITH e AS (SELECT *, CASE WHEN event_id % 97 = 0 AND day(ts) <= 20 THEN 5 ELSE least((day(ts) - 1) // 5, 5) END AS batch FROM events),
w AS (SELECT batch, max(ts) - INTERVAL 1 DAY AS mark FROM e GROUP BY batch), m AS (SELECT e.*, (SELECT max(mark) FROM w WHERE w.batch < e.batch - 1) AS mark FROM e)"""


def _late(spark, sf_dir):
    """A stream of the events in these files, with a watermark of a day behind the latest row."""
    path, day = scratch(spark, "late"), F.dayofmonth("ts")
    batch = F.when((F.col("event_id") % 97 == 0) & (day <= 20), 5).otherwise(F.least(F.floor((day - 1) / 5), F.lit(5)))
    rows = table(spark, sf_dir, "events").withColumn("_batch", batch.cast("int"))
    for i in range(6):
        rows.where(F.col("_batch") == i).drop("_batch").coalesce(1).write.mode("append").parquet(path)
    return stream_of(spark, path, EVENTS, "ts", files=1).withWatermark("ts", "1 day")


@query("late_windows", f"""{ARRIVAL_SQL}, p AS (SELECT *, unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS start FROM m)
SELECT start, event_type, count(*) AS n FROM p WHERE mark IS NULL OR start + INTERVAL 2 DAY > mark GROUP BY start, event_type""")
def late_windows(spark, sf_dir):
    """Sliding windows of two days by one, in update mode; rows that come after their windows have ended are left out of these."""
    return run_windows(sliding(_late(spark, sf_dir)), ["start", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), d AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, start, last, n FROM d""")
def event_sessions(spark, sf_dir):
    """Sessions of each user with less than six hours between events, kept complete from batch to batch."""
    rows = stream_of(spark, _arriving(spark, sf_dir), EVENTS, "ts", files=3)
    got = run_windows(sessions(rows), ["user_id", "start"], "complete")
    return got.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "last")], "n")
