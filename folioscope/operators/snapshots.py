"""Numbered snapshots of a table in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots that were written to their end."""
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return []
    done = []
    for x in fs.listStatus(at):
        name = x.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(_files(spark, f"{path}/{name}/_SUCCESS")[0]):
            done.append(int(name[1:]))
    return sorted(done)


def current(spark: SparkSession, path: str) -> str | None:
    done = versions(spark, path)
    return f"{path}/v{done[-1]}" if done else None


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write ``df`` as the next snapshot; all but the last ``keep`` are removed."""
    spark = df.sparkSession
    done = versions(spark, path)
    to = f"{path}/v{(done[-1] if done else 0) + 1}"
    df.write.mode("overwrite").parquet(to)
    for old in done[: len(done) + 1 - keep]:
        at, fs = _files(spark, f"{path}/v{old}")
        fs.delete(at, True)
    return to
