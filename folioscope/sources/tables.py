"""The tables as clean relations: one row per record, whatever was written twice.

Repeated rows are dropped by id, not by comparing whole rows, so that a query reads and shuffles only the columns it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each ``key`` the last row by ``order`` (nulls first); an empty table stays empty."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def sections(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "parsed_sections").dropDuplicates(["section_id"])


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "chunks").dropDuplicates(["chunk_id"])


def processing_log(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "processing_log").dropDuplicates(["log_id"])


def sync_state(spark: SparkSession, folder: str) -> DataFrame:
    """Of each file the row synced last."""
    return latest(read(spark, folder, "sync_state"), "file_path", "synced_at", "process_status", "retry_count", "content_hash")


def parsed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return latest(read(spark, folder, "parsed_documents"), "doc_id", "parsed_at")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Of each point the row embedded last, if its vector has 64 finite numbers that are not all 0."""
    df = latest(read(spark, folder, "vector_points"), "point_id", "embedded_at", "vector")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where((F.size("vector") == 64) & ~bad & F.exists("vector", lambda x: x != 0))
