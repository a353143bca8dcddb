"""Exact nearest vectors for many queries at once, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    v = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def top_k(queries: DataFrame, points: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """``(query_id, lane, point_id, score, place)``: of each lane the ``k`` points of highest cosine (6 decimals, ties by id).

    ``queries(query_id, own_doc, vector)``, ``points(point_id, doc_id, lane, vector)``; points of a query's own
    document are not for it. Queries are cut into blocks of about ``block`` and points into as many parts as there
    are shuffle partitions; each pair of a block and a part is one task that keeps ``k`` per query and lane, so no
    list of pairs is ever shuffled. Vectors must be valid and of one length; an empty side gives an empty result.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(queries.count() / block))
    all_parts, all_blocks = F.sequence(F.lit(0), F.lit(parts - 1)), F.sequence(F.lit(0), F.lit(blocks - 1))
    asked = queries.select(F.lit(True).alias("asks"), F.col("query_id").cast("string").alias("id"), F.col("own_doc").alias("doc_id"), F.lit("").alias("lane"), "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"), F.explode(all_parts).alias("p"))
    there = points.select(F.lit(False).alias("asks"), F.col("point_id").alias("id"), "doc_id", "lane", "vector", F.explode(all_blocks).alias("b"), F.pmod(F.xxhash64("point_id"), F.lit(parts)).cast("int").alias("p"))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, docs, lanes = np.asarray(table.column("id").to_pylist(), object), table.column("doc_id").to_numpy(), np.asarray(table.column("lane").to_pylist(), object)
        unit, q = _unit(table.column("vector")), np.flatnonzero(asks)
        out: list[tuple] = []
        for lane in sorted(set(lanes[~asks])):
            m = np.flatnonzero(~asks & (lanes == lane))
            m = m[np.argsort(ids[m].astype(str), kind="stable")]
            for a in range(0, len(q), 256):
                rows = q[a : a + 256]
                score = np.round(unit[rows] @ unit[m].T, 6)
                score[docs[rows][:, None] == docs[m][None, :]] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                for i, r in enumerate(rows):
                    out += [(ids[r], lane, ids[m[j]], float(score[i, j])) for j in best[i] if score[i, j] > -np.inf]
        names, kinds = ("query_id", "lane", "point_id", "score"), (pa.string(), pa.string(), pa.string(), pa.float64())
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    found = asked.unionByName(there).groupBy("b", "p").applyInArrow(compare, "query_id string, lane string, point_id string, score double")
    rank = Window.partitionBy("query_id", "lane").orderBy(F.desc("score"), "point_id")
    return found.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
