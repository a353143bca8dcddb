"""Connected components of a link table, by alternating star contractions.

Each task first replaces its own links, a bounded number at a time, by stars around the smallest node that they connect.
Each round is then two aggregations and two joins over the remaining links, so no group is ever gathered in one
task; the number of rounds grows with the logarithm of the longest chain. Links that fit one task need no round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.materialize import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()


def _own_stars(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Links ``(src, dst)`` that connect what ``edges`` connect, each task's share as stars."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        kinds = None

        def top(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[up]
            return x

        def stars() -> pa.RecordBatch:
            out = [(x, c) for x in list(parent) if (c := top(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(2)], names=["src", "dst"])

        for batch in batches:
            kinds = [c.type for c in batch.columns]
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > most:
                yield stars()
        if parent:
            yield stars()

    return edges.mapInArrow(contract, edges.schema)


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars: no node has two different links down, or one down and one up."""
    ends = edges.select(F.col("src").alias("node"), "dst", F.lit(False).alias("up")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(None).alias("dst"), F.lit(True).alias("up")).distinct())
    return ends.groupBy("node").agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"), F.max("up").alias("up")).where("lo is not null and (lo <> hi or up)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` that has a link to another one.

    ``component`` is the smallest node of its group. Null ends and self links are ignored; an empty table gives
    an empty result; repeated links change nothing. Raises if ``max_rounds`` do not suffice (chains beyond 2**20).
    """
    now = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()
    now = materialize(_own_stars(now), "links")
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = materialize(_small_star(_large_star(now)), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    ).distinct()
