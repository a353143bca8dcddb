"""Problem 5: the k most similar vectors of every vector, by a permutation index of two levels.

Coarse pivots, fitted on a bounded sample, cut the collection into shelves: a vector is placed on the shelves of its
``shelves`` nearest coarse pivots, and only these copies are shuffled. On a shelf, one row in ``pivot_rows`` is a pivot;
a vector is represented by the order of its nearest pivots and posted in the inverted files of the first ``posted``.
Within a file the vectors are ranked for each other by the footrule distance of their orders, and the ``rerank`` best
are compared by exact cosine. The number of shelves grows with the collection, so that neither a shelf nor a file does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.plans.materialize import broadcast_if_small, materialize


@dataclass(frozen=True)
class IndexParams:
    """Neighbours are the ``k`` of highest cosine, ``least`` or more, of vectors of ``dim`` numbers.

    Coarse pivots are as many as give shelves of ``shelf_rows`` on average, ``max_shelves`` at most, fitted on at most
    ``max_sample`` vectors: the bounds of what is collected and broadcast. Shelves beyond ``split_rows`` are split.
    """

    k: int = 5
    least: float = 0.8
    dim: int = 64
    shelves: int = 3
    shelf_rows: int = 16_384
    split_rows: int = 65_536
    max_shelves: int = 65_536
    max_sample: int = 65_536
    pivot_rows: int = 32
    order: int = 8
    posted: int = 6
    rerank: int = 512


@dataclass(frozen=True)
class Points:
    """``points(id, point_id, raw, h, shelves)`` of the valid vectors, the rows they come from, and the parameters."""

    points: DataFrame
    rows: DataFrame
    p: IndexParams

    def vectors(self, wanted: DataFrame) -> DataFrame:
        """``wanted``, some rows of ``points``, each with its ``vector`` as bytes; repeated rows of the input repeat it."""
        dim = self.p.dim

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = _valid(batch.column(1), dim)
                blobs = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([_hash(b) for b in blobs], pa.int64()), pa.array(blobs, pa.binary())], names=["point_id", "raw", "vector"])

        found = self.rows.mapInArrow(lambda it: read(b.select(["point_id", "vector"]) for b in it), "point_id string, raw bigint, vector binary")
        return found.join(wanted.hint("shuffle_hash"), ["point_id", "raw"]).drop("point_id", "raw")


def _hash(blob: bytes) -> int:
    return xxhash.xxh3_64_intdigest(blob) - (1 << 63)


def _valid(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors of ``dim`` finite numbers that are not all zero, and these vectors."""
    start = column.offsets.to_numpy()
    at = np.flatnonzero((np.diff(start) == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = flat[start[at][:, None] + np.arange(dim)]
    good = np.isfinite(x).all(1) & x.any(1)
    return at[good], np.ascontiguousarray(x[good])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _first(near: np.ndarray, width: int) -> np.ndarray:
    """Per row the columns of the ``width`` greatest values, greatest first: of strips of columns the best are looked through."""
    n, m = near.shape
    strips = m // 32
    if strips > 2 * width:
        heads = near[:, : strips * 32].reshape(n, 32, strips).max(1)
        best = np.argpartition(-heads, width - 1, axis=1)[:, :width]
        columns = (best[:, :, None] + np.arange(32) * strips).reshape(n, -1)
        rest = np.broadcast_to(np.arange(strips * 32, m), (n, m - strips * 32))
        columns = np.concatenate([columns, rest], 1)
    else:
        columns = np.broadcast_to(np.arange(m), (n, m))
    value = np.take_along_axis(near, columns, 1)
    top = np.argpartition(-value, width - 1, axis=1)[:, :width] if width < columns.shape[1] else np.broadcast_to(np.arange(width), (n, width))
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(value, top, 1), axis=1, kind="stable"), 1)
    return np.take_along_axis(columns, top, 1)


def _nearest_of(unit: np.ndarray, pivots: np.ndarray, width: int) -> np.ndarray:
    out = [_first(unit[a : a + 2048] @ pivots.T, width) for a in range(0, len(unit), 2048)]
    return np.concatenate(out) if out else np.zeros((0, width), np.int64)


def coarse_pivots(rows: DataFrame, p: IndexParams, n: int) -> np.ndarray:
    """Centres of ``n * shelves / shelf_rows`` shelves, by three rounds of k-means over a sample (by hash of the id)."""
    wanted = min(p.max_shelves, max(1, math.ceil(n * p.shelves / p.shelf_rows)))
    share = math.ceil(min(1.0, min(p.max_sample, max(1024, 32 * wanted)) / max(n, 1)) * (1 << 20))
    sample = rows.where((F.size("vector") == p.dim) & (F.pmod(F.xxhash64("point_id", F.lit(5)), F.lit(1 << 20)) < share))
    sample = sample.select("point_id", "vector").dropDuplicates(["point_id"]).limit(2 * p.max_sample).toArrow()
    x = _valid(sample.column("vector").combine_chunks(), p.dim)[1] if sample.num_rows else np.zeros((0, p.dim), np.float32)
    x = np.unique(np.round(_unit(x), 6), axis=0).astype(np.float32) if len(x) else x
    if not len(x):
        return np.zeros((1, p.dim), np.float32)
    centres = x[np.random.default_rng(1).choice(len(x), min(wanted, len(x)), replace=False)]
    for _ in range(3 if len(centres) > 1 else 0):
        own = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
    return centres


def valid_points(rows: DataFrame, p: IndexParams = IndexParams()) -> Points:
    """Of each id of ``rows(point_id, embedded_at, vector)`` the row with the latest ``embedded_at``, if its vector is valid.

    A vector is valid with ``dim`` finite numbers that are not all zero; null ids and null vectors are not. Among
    rows of one id and time a valid one counts before others, then the one of greatest hash; a null time comes before
    all others. ``id`` numbers the points in the order of ``point_id``; ``h`` is a hash of the vector at unit length
    (12 decimals), ``raw`` one of its bytes. Only these numbers and the shelves are shuffled here, no vector.
    """
    rows = rows.where("point_id is not null").select("point_id", "embedded_at", "vector")
    centres = rows.sparkSession.sparkContext.broadcast(coarse_pivots(rows, p, rows.count()))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = centres.value
        for batch in batches:
            at, x = _valid(batch.column(2), p.dim)
            unit = _unit(x) if len(x) else np.zeros((0, p.dim))
            near = _nearest_of(unit.astype(np.float32), base, min(p.shelves, len(base))).astype(np.int32)
            valid = np.zeros(batch.num_rows, bool)
            valid[at] = True
            place = np.full(batch.num_rows, -1)
            place[at] = np.arange(len(at))
            to = pa.array(place, mask=place < 0)  # what is not valid gets nulls
            whole = np.rint(unit * 1e12).astype(np.int64)
            raw = pa.array([_hash(v.tobytes()) for v in x], pa.int64())
            h = pa.array([_hash(v.tobytes()) for v in whole], pa.int64())
            shelves = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(valid), raw.take(to), h.take(to), shelves.take(to)], names=["point_id", "embedded_at", "valid", "raw", "h", "shelves"])

    time = rows.schema["embedded_at"].dataType.simpleString()
    told = rows.mapInArrow(describe, f"point_id string, embedded_at {time}, valid boolean, raw bigint, h bigint, shelves array<int>")
    last = told.groupBy("point_id").agg(F.max(F.struct("embedded_at", "valid", "raw", "h", "shelves")).alias("v")).where("v.valid")
    last = last.select("point_id", "v.raw", "v.h", "v.shelves").repartitionByRange("point_id").sortWithinPartitions("point_id")
    # ranges of ids, so that numbers given within them follow the order of the ids
    points = materialize(last.select(F.monotonically_increasing_id().alias("id"), "point_id", "raw", "h", "shelves"), "points")
    return Points(points, rows.select("point_id", "vector"), p)


def _pairs_of_files(single: np.ndarray, orders: np.ndarray, p: IndexParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (query, member) that meet in an inverted file, are among the ``rerank`` best by footrule distance, and near."""
    posted, width = min(p.posted, orders.shape[1]), orders.shape[1]
    flat = orders[:, :posted].ravel()
    by = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(flat[by]) != 0, True])
    by //= posted
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = by[a:b]
        if len(rows) <= p.rerank:  # all are among the best
            i, j = np.nonzero(single[rows] @ single[rows].T > p.least - 1e-5)
            yield rows[i], rows[j]
            continue
        used, local = np.unique(orders[rows], return_inverse=True)
        local = local.reshape(len(rows), width)
        table = np.zeros((len(used), len(rows)), np.uint8)  # width less the pivot's place in the member's order, 0 if absent
        for k in range(width):
            table[local[:, k], np.arange(len(rows))] = width - k
        for start in range(0, len(rows), 256):
            q = np.arange(start, min(start + 256, len(rows)))
            score = np.zeros((len(q), len(rows)), np.int32)
            for k in range(width):
                score += np.minimum(table[local[q, k]], width - k)  # the footrule distance is a constant less twice this sum
            ranked = score * len(rows) - np.arange(len(rows), dtype=np.int32)  # ties go to the smaller id
            best = np.argpartition(ranked, len(rows) - p.rerank, axis=1)[:, len(rows) - p.rerank :]
            for i, m in zip(q, best, strict=True):
                m = m[single[rows[m]] @ single[rows[i]] > p.least - 1e-5]
                yield np.full(len(m), rows[i]), rows[m]


def _search(ids: np.ndarray, raw: np.ndarray, shelves: np.ndarray, shard: np.ndarray, shelf: int, across: bool, p: IndexParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, other, cosine)``: neighbours on one shelf; rows are in the order of ``ids``, so that ties go to the smaller id.

    A pair counts on the first shelf that both are on. With ``across`` only pairs between the two shards count.
    """
    unit = _unit(raw)
    single, n = unit.astype(np.float32), len(ids)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    pivots = single[np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable")[: max(min(n, p.order), n // p.pivot_rows)]]
    orders = _nearest_of(single, pivots, min(p.order, len(pivots)))

    def best(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.unique(x * n + y)
        x, y = key // n, key % n
        ok = (x != y) & ((shard[x] != shard[y]) if across else True)
        x, y = x[ok], y[ok]
        both = np.full(len(x), np.iinfo(np.int32).max, np.int32)
        for s in shelves.T:
            there = (shelves[y] == s[x][:, None]).any(1)
            both = np.where(there, np.minimum(both, s[x]), both)
        x, y = x[both == shelf], y[both == shelf]
        cos = np.concatenate([np.zeros(0), *(np.einsum("pd,pd->p", unit[x[a : a + 200_000]], unit[y[a : a + 200_000]]) for a in range(0, len(x), 200_000))]).round(6)
        order = np.lexsort((y, -cos, x))
        x, y, cos = x[order], y[order], cos[order]
        top = (np.arange(len(x)) - np.searchsorted(x, x) < p.k) & (cos >= p.least)
        return x[top], y[top], cos[top]

    xs, ys, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for x, y in _pairs_of_files(single, orders, p):
        xs.append(x)
        ys.append(y)
        size += len(x)
        if size > 4_000_000:  # many near each other: the best of each so far
            x, y, _ = best(np.concatenate(xs), np.concatenate(ys))
            xs, ys, size = [x], [y], len(x)
    x, y, cos = best(np.concatenate(xs), np.concatenate(ys))
    return ids[x], ids[y], cos


def _classes(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of sets of equal directions: ``(id, rep)`` of all members, and ``(rep, id)`` of the ``k`` first of each."""
    many = points.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1").select("h", "rep")
    members = materialize(points.select("id", "h").join(many, "h").select("id", "rep"), "classes")
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    return members, members.withColumn("nth", nth).where(F.col("nth") <= k).select("rep", "id")  # each task passes on k of a set


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return found.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)


def nearest(points: Points) -> DataFrame:
    """``(id, other, cosine, place)`` of all points that :func:`valid_points` gives.

    The ``k`` others of highest cosine (rounded to 6 decimals; ties by smaller id) of ``least`` or more, as far as
    the index finds them. Vectors of one direction are indexed once and put back exactly: of each set of them only
    the ``k + 1`` smallest ids can be anyone's neighbours. An empty table gives an empty result.
    """
    p, spark = points.p, points.points.sparkSession
    members, few = _classes(points.points, p.k + 1)
    reps = points.points.join(broadcast_if_small(members.where("id <> rep").select("id")), "id", "left_anti").select("id", "point_id", "raw", "shelves")

    # a shelf longer than split_rows is cut into shards; each pair of shards is a task
    counted = reps.select(F.explode("shelves").alias("shelf")).groupBy("shelf").count()
    long = [(r.shelf, math.ceil(r["count"] / p.split_rows)) for r in counted.where(F.col("count") > p.split_rows).collect()]  # max_shelves rows at most
    placed = points.vectors(reps).withColumn("shelf", F.explode("shelves"))
    if long:
        placed = placed.join(F.broadcast(spark.createDataFrame(long, "shelf int, shards int")), "shelf", "left").fillna(1, ["shards"])
        placed = placed.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
        placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        placed = placed.select("shelf", "id", "shelves", "vector", "shard", F.least("shard", "with").alias("lo"), F.greatest("shard", "with").alias("hi"))
    else:
        placed = placed.select("shelf", "id", "shelves", "vector", *(F.lit(0).alias(c) for c in ("shard", "lo", "hi")))

    def search(table: pa.Table) -> pa.Table:
        ids, at = np.unique(table.column("id").to_numpy(), return_index=True)  # in order, a replayed row once
        raw = np.frombuffer(b"".join(table.column("vector").take(pa.array(at)).to_pylist()), np.float32).reshape(len(ids), -1)
        shelves = np.array(table.column("shelves").take(pa.array(at)).to_pylist(), np.int32)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        x, y, cos = _search(ids, raw, shelves, table.column("shard").to_numpy()[at], table.column("shelf")[0].as_py(), lo != hi, p)
        return pa.table({"id": pa.array(x, pa.int64()), "other": pa.array(y, pa.int64()), "cosine": pa.array(cos, pa.float64())})

    found = placed.groupBy("shelf", "lo", "hi").applyInArrow(search, "id bigint, other bigint, cosine double")
    return _with_copies(materialize(_ranked(found, p.k).drop("place"), "found"), members, few, p)


def _with_copies(found: DataFrame, members: DataFrame, few: DataFrame, p: IndexParams, asked: DataFrame | None = None) -> DataFrame:
    """Neighbours between representatives carried over to all ids, or to those of ``asked(id)``."""
    # the other end: the first ids of its class
    reach = found.join(few.select(F.col("rep").alias("other"), F.col("id").alias("copy")), "other", "left").select("id", F.coalesce("copy", "other").alias("other"), "cosine")
    # this end: every member
    reach = reach.join(members.select(F.col("rep").alias("id"), F.col("id").alias("copy")), "id", "left").select(F.coalesce("copy", "id").alias("id"), "other", "cosine")
    within = members.join(few.select("rep", F.col("id").alias("other")), "rep").where("id <> other").select("id", "other", F.lit(1.0).alias("cosine"))
    reach = reach.unionByName(within)
    if asked is not None:
        reach = reach.join(asked, "id", "left_semi")
    return _ranked(reach, p.k).select("id", "other", "cosine", "place")


def named(rows: DataFrame, points: Points, columns: dict[str, str]) -> DataFrame:
    """``rows`` with each of the id columns that ``columns`` names given back as ``point_id`` under the new name."""
    for old, new in columns.items():
        rows = rows.join(points.points.select(F.col("id").alias(old), F.col("point_id").alias(new)), old).drop(old)
    return rows


def neighbour_pairs(found: DataFrame, points: Points) -> DataFrame:
    """``(first_id, other_id)``: each pair of which at least one is a neighbour of the other, once."""
    pairs = found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return named(pairs, points, {"a": "first_id", "b": "other_id"}).select("first_id", "other_id")


def brute_force(points: Points, every: int = 20, block: int = 8192) -> DataFrame:
    """The true neighbours of the points whose hashed id is divisible by ``every``, against all points, in blocks.

    Distinct vectors are compared; each task keeps the ``k`` best of a query, and copies are put back at the end.
    """
    p = points.p
    asked = points.points.where(F.pmod(F.xxhash64("point_id"), F.lit(every)) == 0).select("id")
    members, few = _classes(points.points, p.k + 1)
    distinct = points.points.join(broadcast_if_small(members.where("id <> rep").select("id")), "id", "left_anti").select("id", "point_id", "raw")
    own = materialize(points.vectors(distinct).select("id", "vector"), "vectors")
    reps = materialize(asked.join(members, "id", "left").select(F.coalesce("rep", "id").alias("id")).distinct(), "asked")
    blocks = max(1, math.ceil(reps.count() / block))
    parts = max(1, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = own.join(reps, "id", "left_semi").select(F.lit(True).alias("query"), "id", "vector", F.pmod(F.hash("id"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    there = own.select(F.lit(False).alias("query"), "id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.hash("id"), F.lit(parts)).alias("part"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        is_query, ids = table.column("query").to_numpy(), table.column("id").to_numpy()
        unit = _unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(len(ids), -1))
        q, m = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        m = m[np.unique(ids[m], return_index=True)[1]]
        q = q[np.unique(ids[q], return_index=True)[1]]
        single = unit[m].astype(np.float32).T
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(q) if len(m) else 0, 256):
            rows = q[a : a + 256]
            near = unit[rows].astype(np.float32) @ single
            i, j = np.nonzero(near > p.least - 1e-5)
            i, j = i[ids[rows[i]] != ids[m[j]]], j[ids[rows[i]] != ids[m[j]]]
            cos = np.concatenate([np.zeros(0), *(np.einsum("pd,pd->p", unit[rows[i[b : b + 200_000]]], unit[m[j[b : b + 200_000]]]) for b in range(0, len(i), 200_000))]).round(6)
            order = np.lexsort((j, -cos, i))
            i, j, cos = i[order], j[order], cos[order]
            top = (np.arange(len(i)) - np.searchsorted(i, i) < p.k) & (cos >= p.least)
            got.append((ids[rows[i[top]]], ids[m[j[top]]], cos[top]))
        x, y, cos = (np.concatenate(g) for g in zip(*got, strict=True))
        return pa.table({"id": pa.array(x, pa.int64()), "other": pa.array(y, pa.int64()), "cosine": pa.array(cos, pa.float64())})

    got = sent.unionByName(there).groupBy("b", "part").applyInArrow(compare, "id bigint, other bigint, cosine double")
    return _with_copies(_ranked(got, p.k).drop("place"), members, few, p, asked)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``(true_neighbours, missed, missed_share)``."""
    hit = truth.select("id", "other").join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    n, got = F.count("*"), F.coalesce(F.sum("hit"), F.lit(0))
    return hit.agg(n.alias("true_neighbours"), (n - got).alias("missed"), F.round((n - got) / F.greatest(n, F.lit(1)), 6).alias("missed_share"))
