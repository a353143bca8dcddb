"""Reports on the state of an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status_counts(state: DataFrame) -> DataFrame:
    """Files by status, deleted ones left out; poisoned files count as errors."""
    merged = F.when(F.col("process_status").isin("error", "poison"), "error").otherwise(F.col("process_status"))
    return state.where("not is_deleted").groupBy(merged.alias("status")).agg(F.count("*").alias("n"))


def folder_status(state: DataFrame) -> DataFrame:
    """Per folder: files, indexed ones, errors, and errors with poisoned ones."""
    s = F.col("process_status")
    return state.where("not is_deleted").groupBy("folder_path").agg(F.count("*").alias("file_count"), F.count_if(s == "done").alias("indexed"), F.count_if(s == "error").alias("errors"), F.count_if(s.isin("error", "poison")).alias("failed"))


def root_of(folders: DataFrame, roots: Sequence[str]) -> DataFrame:
    """``folders`` with the first of ``roots`` that is the folder or lies above it; folders below none are left out.

    The roots are configuration, hence few: they become one expression and need no join.
    """
    path, out = F.col("folder_path"), F.lit(None).cast("string")
    for r in reversed(roots):
        out = F.when((path == r) | F.startswith(path, F.lit(r.rstrip("/") + "/")), F.lit(r)).otherwise(out)
    return folders.withColumn("root", out).where("root is not null")


def roll_up(per_folder: DataFrame, roots: Sequence[str]) -> DataFrame:
    """The counts of :func:`folder_status` per configured root; roots without files have zeros."""
    sums = root_of(per_folder, roots).groupBy("root").agg(*(F.sum(c).alias(c) for c in ("file_count", "indexed", "failed")))
    named = per_folder.sparkSession.createDataFrame([(r,) for r in roots], "root string")
    return named.join(sums, "root", "left").fillna(0)


def sync_summary(state: DataFrame) -> DataFrame:
    """One row: last time, files, pending, failed and poisoned ones."""
    s = F.col("process_status")
    return state.where("not is_deleted").agg(F.max("synced_at").alias("last_synced"), F.count("*").alias("total"), F.count_if(s == "pending").alias("pending"), F.count_if(s == "error").alias("errors"), F.count_if(s == "poison").alias("poisoned"))


def outcomes(log: DataFrame) -> DataFrame:
    """Entries by stage and status in lower case, with the durations that are known and not negative."""
    ok = F.col("duration_ms") >= 0
    return log.groupBy("stage", F.lower("status").alias("status")).agg(F.count("*").alias("n"), F.count_if(ok).alias("timed"), F.coalesce(F.sum(F.when(ok, F.col("duration_ms"))), F.lit(0)).alias("total_ms"))


def assembled(sections: DataFrame) -> DataFrame:
    """``(doc_id, sections, text)``: each document's sections in order, joined by blank lines; null texts left out."""
    parts = sections.where("text is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_order", "section_id", "text"))).alias("s"))
    return parts.select("doc_id", F.size("s").cast("bigint").alias("sections"), F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("text"))


def document_sizes(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``documents`` with their numbers of chunks and tokens, 0 without any."""
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    return documents.join(sizes, "doc_id", "left").fillna(0, ["chunks", "tokens"])


def recent_documents(documents: DataFrame, n: int, folder: str | None = None) -> DataFrame:
    """The ``n`` documents indexed last, ties by id; those never indexed come last."""
    there = documents if folder is None else documents.where(F.col("folder_path") == folder)
    return there.orderBy(F.col("indexed_at").desc_nulls_last(), "doc_id").limit(n)


def pending_queue(state: DataFrame, n: int) -> DataFrame:
    """The ``n`` pending files that have waited longest."""
    return state.where("process_status = 'pending' and not is_deleted").select("file_path", "created_at").orderBy("created_at", "file_path").limit(n)


def last_errors(state: DataFrame, n: int) -> DataFrame:
    failed = state.where("process_status in ('error', 'poison') and not is_deleted")
    return failed.orderBy(F.col("synced_at").desc_nulls_last(), "file_path").limit(n).select("file_path", "error_message", "process_status")


def running_order(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``chunk_order``, counted from 0 within ``group``."""
    return rows.withColumn("chunk_order", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
