"""Keyed tables on Parquet: every change is a new snapshot, never a rewrite of what is being read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.snapshots import current, publish


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it has not. Columns only ``old`` has are null in new rows.

    Keys with a null never match, so such rows are kept on both sides. ``new`` must have each key once.
    """
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def stale(points: DataFrame, keep: DataFrame, key: list[str]) -> DataFrame:
    """The points that ``keep`` does not name: those to delete."""
    return points.join(keep.select(*key), key, "left_anti")


def replace_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """Points after documents were indexed anew: all earlier points of the documents in ``new`` give way to it."""
    return points.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents in ``gone(doc_id)``."""
    return {name: df.join(gone, "doc_id", "left_anti") for name, df in tables.items()}


def migrate(df: DataFrame, version: int, steps: dict[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``df`` taken through all ``steps`` above ``version``, in order."""
    for v in sorted(v for v in steps if v > version):
        df = steps[v](df)
    return df


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


class Table:
    """A keyed table in a folder: readers see the last whole snapshot while the next is written."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key

    def read(self) -> DataFrame | None:
        at = current(self.spark, self.path)
        return None if at is None else self.spark.read.parquet(at)

    def write(self, df: DataFrame) -> None:
        publish(df, self.path)

    def upsert(self, new: DataFrame) -> None:
        new = new.dropDuplicates(self.key)
        old = self.read()
        self.write(new if old is None else upsert(old, new, self.key))

    def delete(self, gone: DataFrame) -> None:
        old = self.read()
        if old is not None:
            self.write(old.join(gone.select(*self.key), self.key, "left_anti"))

    def clear(self) -> None:
        old = self.read()
        if old is not None:
            self.write(old.where(F.lit(False)))
