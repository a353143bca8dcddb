"""Vectors of texts: an interface for models, and a deterministic stand-in that needs none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024


def hash_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors: every lower-case word adds one at the 16 places that its SHA-256 names; zero without words."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            np.add.at(out[i], np.frombuffer(hashlib.sha256(word.encode()).digest(), ">u2") % dim, 1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def embedded(rows: DataFrame, text: str, model: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``rows`` with ``vector``; ``model()`` is called once a task and gives the function that embeds a batch of texts.

    Null texts get a null vector. How many texts a batch has is ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = model()
        for batch in batches:
            there = batch.notna().to_numpy()
            got = iter(embed(batch[there].tolist()).astype(np.float32)) if there.any() else iter(())
            yield pd.Series([next(got) if x else None for x in there], dtype=object)

    return rows.withColumn("vector", vectors(F.col(text)))


def sparse_hash(rows: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """``(key, place, weight)``: the non-zero places of :func:`hash_vectors`, by built-in functions."""
    words = rows.select(key, F.explode(F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")).alias("w"))
    places = words.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substr(F.sha2("w", 256), i * 4 + 1, F.lit(4)), 16, 10).cast("int") % dim)).alias("place"))
    counts = places.groupBy(key, "place").agg(F.count("*").alias("n"))
    length = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(length, key).select(key, "place", (F.col("n") / F.col("length")).alias("weight"))
