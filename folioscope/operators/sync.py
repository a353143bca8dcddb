"""What changed since the last scan, and the state machine of files."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POISON_AFTER = 3


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression of Java for the whole text."""
    out = fnmatch.translate(pattern)
    return out.replace("(?s:", "(?s)(?:").replace("\\Z", "$").replace("\\z", "$").replace("(?>", "(?:")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the whole path matches a pattern, or one of its parts a pattern without the stars and slashes around it."""
    hit = F.lit(False)
    for p in patterns:
        hit |= path.rlike("^" + glob_regex(p))
        inner = p.strip("*/")
        if inner:
            rx = F.lit("^" + glob_regex(inner))
            hit |= F.exists(F.split(path, "/"), lambda x: F.rlike(x, rx))
    return hit


def rescan(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """``(file_path, event_type)`` of ``snapshot(file_path, modified_at, content_hash)`` against ``state``.

    Unknown files are created; known ones are modified if they were left in processing, or if both their time and
    their hash differ; files of the state that were not seen are deleted. Rows of the state that are deleted already
    count as unknown. Nulls differ from everything but null.
    """
    old = state.where("not is_deleted").select("file_path", F.col("modified_at").alias("m"), F.col("content_hash").alias("h"), "process_status", F.lit(True).alias("known"))
    both = snapshot.withColumn("seen", F.lit(True)).join(old, "file_path", "full_outer")
    changed = ~F.equal_null("modified_at", "m") & ~F.equal_null("content_hash", "h")
    event = F.when(F.col("known").isNull(), "created").when(F.col("seen").isNull(), "deleted").when((F.col("process_status") == "processing") | changed, "modified")
    return both.select("file_path", event.alias("event_type")).where("event_type is not null")


def after_failure(state: DataFrame) -> DataFrame:
    """One more try counted; from the third failure on a file is poisoned."""
    tries = F.col("retry_count") + 1
    return state.withColumns({"process_status": F.when(tries >= POISON_AFTER, "poison").otherwise("error"), "retry_count": tries})


def may_retry(state: DataFrame, now: Column, time: Column) -> DataFrame:
    """The files that may be processed at ``now``: neither poisoned nor within 30 * 2**retries seconds of a failure.

    ``time`` is when a file was synced last; a time that cannot be read holds nothing back.
    """
    wait = F.lit(30) * F.pow(F.lit(2), F.col("retry_count")).cast("long")
    held = (F.col("process_status") == "error") & (F.unix_seconds(now) < F.unix_seconds(time) + wait)
    return state.where((F.col("process_status") != "poison") & ~F.coalesce(held, F.lit(False)))


def held_back(state: DataFrame, now: Column, time: Column) -> DataFrame:
    """``(file_path, again)`` of the files that failed: ``again`` for those whose wait is over, which are tried though unchanged."""
    free = may_retry(state, now, time).select("file_path", F.lit(True).alias("again"))
    failed = state.where("not is_deleted and process_status in ('error', 'poison')").select("file_path")
    return failed.join(free, "file_path", "left").select("file_path", F.coalesce("again", F.lit(False)).alias("again"))


def ensured(state: DataFrame, paths: DataFrame) -> DataFrame:
    """``state`` with a pending row for each of ``paths(file_path)`` that has none."""
    new = paths.select("file_path").distinct().join(state.select("file_path"), "file_path", "left_anti")
    new = new.select("file_path", F.lit("pending").alias("process_status"), F.lit(0).alias("retry_count"), F.lit(False).alias("is_deleted"))
    return state.unionByName(new, allowMissingColumns=True)


def classified(files: DataFrame) -> DataFrame:
    """``files(file_type, size_bytes)`` with type (txt if none), ``ocr`` for pdf and docx, and ``complexity``."""
    kind = F.coalesce("file_type", F.lit("txt"))
    complexity = F.when((kind == "pdf") & (F.col("size_bytes") > 5_000_000), "high").when(kind.isin("pdf", "docx"), "medium").otherwise("low")
    return files.withColumns({"kind": kind, "ocr": kind.isin("pdf", "docx"), "complexity": complexity})
