"""Queries of the streaming side: the feed of events, as a table and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.store import Table
from folioscope.plans.materialize import shared_dir
from folioscope.plans.registry import LOG, Registry
from folioscope.sources import tables as src
from folioscope.streaming import watch

query = Registry()
_BURSTS = """
WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g),
b AS (SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) + 7200000000 AS quiet_us, count(*) AS events, arg_max(event_type, (ts, event_type)) AS last_kind FROM i GROUP BY user_id, n)"""


def _events(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("path", F.unix_micros("started").alias("started_us"), F.unix_micros("quiet_at").alias("quiet_us"), "events", "last_kind")


@query("t2_debounced_events", f"{_BURSTS} SELECT * FROM b")
def debounced_events(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(watch.debounced(_events(src.read(spark, sf, "events")), "2 hours"))


@query("t8_streamed_bursts", f"{_BURSTS} SELECT * FROM b")
def streamed_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stream of the files, written batch by batch."""
    schema = src.read(spark, sf, "events").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    at = f"{shared_dir(spark)}/bursts-{uuid.uuid4().hex}"
    table = Table(spark, f"{at}/table", ["path", "started"])
    watch.run_once(watch.debounced(_events(feed), "2 hours", late="40 days"), f"{at}/checkpoint", watch.replace_sink(table), mode="complete")
    return _shown(table.read())


@query("t3_windowed_counts", "SELECT epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS started_us, event_type AS kind, count(*) AS events FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return watch.windowed_counts(_events(src.read(spark, sf, "events")), "10 minutes").select(F.unix_micros("started").alias("started_us"), "kind", "events")


@query("t4_vanished_after_known", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, ts, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'modified' END AS kind FROM events),
o AS (SELECT *, lag(kind) OVER (PARTITION BY path ORDER BY ts, kind) AS before FROM e)
SELECT path, count(*) FILTER (kind = 'deleted' AND before = 'modified') AS deletions, count(*) FILTER (kind = 'modified') AS others FROM o WHERE kind = 'modified' OR before = 'modified' GROUP BY path""")
def vanished_after_known(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream: errors stand for deletions, of which only those of known paths go on."""
    feed = spark.readStream.schema(src.read(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events = _events(feed).withColumn("kind", F.when(F.col("kind") == "error", "deleted").otherwise("modified"))
    at = f"{shared_dir(spark)}/known-{uuid.uuid4().hex}"
    watch.run_once(watch.known_deletions(events), f"{at}/checkpoint", watch.append_sink(f"{at}/rows"), mode="append")
    seen = spark.read.schema("path string, kind string").parquet(f"{at}/rows")
    return seen.groupBy("path").agg(F.count_if(F.col("kind") == "deleted").alias("deletions"), F.count_if(F.col("kind") == "modified").alias("others"))


@query("t7_retries_due", f"""
WITH f AS (SELECT file_path, count(*) AS failures, max(created_at) AS last FROM {LOG} WHERE lower(status) = 'error' GROUP BY file_path)
SELECT file_path, failures, failures >= 3 AS poisoned, CASE WHEN failures < 3 THEN epoch_us(last) + 30000000 * CAST(pow(2, failures) AS BIGINT) END AS due_us FROM f""")
def retries_due(spark: SparkSession, sf: str) -> DataFrame:
    failed = src.processing_log(spark, sf).where(F.lower("status") == "error").groupBy("file_path").agg(F.count("*").alias("failures"), F.max("created_at").alias("last"))
    due = F.unix_micros("last") + F.lit(30_000_000) * F.pow(F.lit(2), F.col("failures")).cast("bigint")
    return failed.select("file_path", "failures", (F.col("failures") >= 3).alias("poisoned"), F.when(F.col("failures") < 3, due).alias("due_us"))
