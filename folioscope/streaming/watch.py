"""Watching folders and event feeds: debouncing, known paths, retries and sinks that may run twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators.store import Table


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New and rewritten files of supported types below ``folder`` as they come, with their hashes."""
    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(kinds).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    rows = files.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.col("modificationTime").alias("ts"), F.sha2("content", 256).alias("content_hash"))
    return rows.where(t.file_type(F.col("file_path")).isNotNull()).withColumn("kind", F.lit("modified"))


def debounced(events: DataFrame, gap: str = "2 seconds", late: str | None = None) -> DataFrame:
    """``(path, started, quiet_at, events, last_kind)``: bursts of ``events(path, ts, kind)`` of one path, closed once it is quiet for longer than ``gap``.

    The same for tables and streams; a stream needs ``late``, the delay after which events are too late to count, and
    in append mode gives a burst only when the watermark has passed its end. Time is the events' own. A null path or
    time counts for nothing; of kinds at the same time the greatest is the last.
    """
    events = events.where("path is not null and ts is not null")
    if late is not None:
        events = events.withWatermark("ts", late)
    bursts = events.groupBy("path", F.session_window("ts", gap).alias("w"))
    return bursts.agg(F.count("*").alias("events"), F.max(F.struct("ts", "kind"))["kind"].alias("last_kind")).select("path", F.col("w.start").alias("started"), F.col("w.end").alias("quiet_at"), "events", "last_kind")


def windowed_counts(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """``(started, kind, events)`` in windows of one size."""
    if late is not None:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w"), "kind").agg(F.count("*").alias("events")).select(F.col("w.start").alias("started"), "kind", "events")


def known_deletions(events: DataFrame) -> DataFrame:
    """``(path, kind)`` of a stream ``events(path, ts, kind)``: a deletion goes on only if its path was seen before and not deleted since.

    Events of one time are taken in the order of their kinds; a null path, time or kind counts for nothing.
    """

    def each(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kinds = pd.concat(list(batches)).sort_values(["ts", "kind"]).kind
        there = kinds != "deleted"
        before = there.shift(fill_value=state.get[0] if state.exists else False)
        state.update((bool(there.iloc[-1]),))
        kept = kinds[there | before]
        yield pd.DataFrame({"path": [key[0]] * len(kept), "kind": kept.tolist()})

    events = events.where("path is not null and ts is not null and kind is not null")
    return events.select("path", "ts", "kind").groupBy("path").applyInPandasWithState(each, "path string, kind string", "known boolean", "append", "NoTimeout")


def upsert_sink(table: Table, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts each batch by the table's key: a batch that comes twice changes nothing.

    For append and update mode, where a key's last row is its result.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        if not rows.isEmpty():
            table.upsert(rows)

    return write


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch to a folder of its own: a batch that comes twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def replace_sink(table: Table) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for complete mode: each batch is the whole result and becomes the table.

    Bursts need it: a late event may join two of them, and an upsert would keep the row of the second.
    """

    def write(batch: DataFrame, _: int) -> None:
        table.write(batch)

    return write


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Everything that is there, in micro-batches, then stop."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str = "10 seconds", mode: str = "update"):
    """The running query, with a micro-batch ``every`` so often."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(sink).start()
