"""Problem 2: groups of records with small edits; Bayesian pruning of candidates over MinHash values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shingles import minhash
from folioscope.llm.simjoin import JoinParams, _of_ids, _with_both, near_links
from folioscope.operators.components import connected_components
from folioscope.plans.materialize import materialize

#: As TESTDATA.md has it for this data: three words, similarity 0.6, texts of 20 words or more.
NEAR, MIN_WORDS = JoinParams(shingle=3, threshold=0.6), 20
#: MinHash values of one byte, compared so many at a time; a pair is dropped when the probability that its
#: similarity reaches the threshold falls below the tolerance.
N_HASHES, STEP, TOLERANCE = 128, 16, 1e-5


def least_matches(n: int, threshold: float, tolerance: float, grid: int = 4000) -> int:
    """The fewest matches among ``n`` compared values that leave P(similarity >= threshold) >= tolerance.

    The prior of the similarity is uniform; a byte agrees with probability J + (1 - J) / 256.
    """
    j = (np.arange(grid) + 0.5) / grid
    agree = j + (1 - j) / 256
    for m in range(n + 1):
        log = m * np.log(agree) + (n - m) * np.log1p(-agree) + math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
        weight = np.exp(log - log.max())
        if weight[j >= threshold].sum() / weight.sum() >= tolerance:
            return m
    return n + 1


def bayes_pruned(pairs: DataFrame, texts: DataFrame, p: JoinParams, n_hashes: int = N_HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> DataFrame:
    """The candidate pairs ``(a, b)`` whose MinHash values, compared ``step`` by ``step``, never rule them out."""
    rounds = [(n, least_matches(n, p.threshold, tolerance)) for n in range(step, n_hashes + 1, step)]

    def sign(rows: list) -> pa.Array:
        return pa.array([x.tobytes() for x in minhash(rows, p.shingle, n_hashes)], pa.binary())

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n_hashes) for c in (2, 3))
            live, same = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for n, least in rounds:
                same[live] += (x[live, n - step : n] == y[live, n - step : n]).sum(1)
                live = live[same[live] >= least]
            yield batch.select([0, 1]).take(pa.array(live))

    both = _with_both(pairs, _of_ids(pairs, texts, sign, "binary", "signatures"))
    return materialize(both.select("a", "b", "xa", "xb").mapInArrow(prune, "a bigint, b bigint"), "pruned")


def near_groups(records: DataFrame, p: JoinParams = NEAR, min_words: int = MIN_WORDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``(record_kind, first_id, other_id)`` over ``records(record_kind, record_id, text)``: groups within a kind.

    One row for each record that has not the smallest id (string order) of its group of near-duplicates. Texts of
    fewer than ``min_words`` white-space separated words are left out, null texts too. Repeated rows of one id
    count once; copies are set aside by hash before the join. An empty table gives an empty result.
    """
    words = F.size(F.split(F.trim(F.regexp_replace("text", "(?U)[\\s\\x1c-\\x1f]+", " ")), " "))
    records = records.where(F.col("text").isNotNull() & F.col("record_id").isNotNull() & (words >= min_words))
    records = records.select("record_kind", "record_id", F.xxhash64("record_kind", "record_id").alias("id"), "text")
    out = None
    for kind in ("chunk", "section"):
        own = records.where(F.col("record_kind") == kind)
        links = near_links(own.select("id", "text", "record_id"), ["record_id"], p, lambda pairs, texts: bayes_pruned(pairs, texts, p, tolerance=tolerance))
        groups = materialize(connected_components(links, "a", "b").withColumnRenamed("node", "id"), "groups")
        members = own.select("record_kind", "record_id", "id").join(groups, "id").select("record_kind", "record_id", "component").distinct()
        first = members.groupBy("component").agg(F.min("record_id").alias("first_id"))
        found = members.join(first, "component").where("record_id <> first_id").select("record_kind", "first_id", F.col("record_id").alias("other_id"))
        out = found if out is None else out.unionByName(found)
    return out


def passages(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """``(record_kind, record_id, text)`` of all chunks and sections."""
    return chunks.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), F.col("chunk_text").alias("text")).unionByName(
        sections.select(F.lit("section").alias("record_kind"), F.col("section_id").alias("record_id"), "text")
    )
