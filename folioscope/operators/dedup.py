"""Exact duplicates by content hashes, and what is to be done with a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_hash(c: Column) -> Column:
    """A SHA-256 as 64 lower-case digits, whatever prefix or case it was written with; null for anything else."""
    digits = F.regexp_extract(F.lower(c), "([0-9a-f]{64})\\s*$", 1)
    return F.when(digits != "", digits)


def canonical(files: DataFrame, hash_column: str, order: str) -> DataFrame:
    """``files`` with ``first``: the least ``order`` among those of the same hash; null hashes stand alone."""
    w = Window.partitionBy(hash_column)
    return files.withColumn("first", F.when(F.col(hash_column).isNotNull(), F.min(order).over(w)).otherwise(F.col(order)))


def firsts(files: DataFrame, hash_column: str, order: str) -> DataFrame:
    """``(hash, first)`` of every hash, by one aggregation: a hash that a third of all files have is no hot group."""
    return files.where(F.col(hash_column).isNotNull()).groupBy(hash_column).agg(F.min(order).alias("first"))


def decide(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files(file_path, raw_hash, norm_hash)`` with ``outcome`` and ``original``.

    ``known(file_path, raw_hash, norm_hash)`` is what was registered before. A file whose raw hash is registered under
    its own path is unchanged; one whose raw, else normalized hash is registered under another path, or comes earlier
    among ``files`` (by path), is a duplicate; all others are to be indexed. Null hashes match nothing.
    """
    own = known.select("file_path", F.col("raw_hash").alias("known_raw"))
    out = files.join(own, "file_path", "left")
    for kind in ("raw_hash", "norm_hash"):
        other = firsts(known, kind, "file_path").withColumnRenamed("first", f"{kind}_known")
        batch = firsts(files, kind, "file_path").withColumnRenamed("first", f"{kind}_batch")
        out = out.join(other, kind, "left").join(batch, kind, "left")
    path = F.col("file_path")
    hits = [F.when(F.col(c) != path, F.col(c)) for c in ("raw_hash_known", "raw_hash_batch", "norm_hash_known", "norm_hash_batch")]
    # the first file of a batch is no duplicate of a later one
    hits[1], hits[3] = (F.when(h < path, h) for h in (hits[1], hits[3]))
    same = F.col("known_raw") == F.col("raw_hash")
    original = F.when(same, F.lit(None).cast("string")).otherwise(F.coalesce(*hits))
    outcome = F.when(F.coalesce(same, F.lit(False)), "unchanged").when(original.isNotNull(), "duplicate").otherwise("index")
    return out.select("file_path", outcome.alias("outcome"), original.alias("original"))
