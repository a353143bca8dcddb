"""Problem 6: texts put into containers of fixed capacity, by conflict-constrained best fit."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import VOCABULARY, with_tokens
from folioscope.plans.materialize import materialize

#: Items packed together in one task, on average; each such lot leaves at most a few open containers.
LOT = 4096
#: Containers with more than this share unused after a round are packed again, together with those of other lots.
ILL_FILLED = 1 / 64
ROUNDS = 4


class _Bins:
    """Open containers by what is left in them; each carries a bitmap of its sources and one of its clusters."""

    def __init__(self, capacity: int, max_sources: int | None):
        self.capacity, self.max_sources = capacity, max_sources
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.at: dict[int, list[int]] = defaultdict(list)
        self.some = 0  # bit r: a container with r tokens left

    def put(self, size: int, source: int, cluster: int) -> int:
        """The tightest container that takes the item, or a new one; successors are searched until one is compatible."""
        want, rest = 1 << source, self.some >> size
        left = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            left += step
            for b in reversed(self.at[left]):
                if not self.clusters[b] & cluster and (self.max_sources is None or (self.sources[b] | want).bit_count() <= self.max_sources):
                    self.at[left].remove(b)
                    if not self.at[left]:
                        self.some &= ~(1 << left)
                    self._hold(b, left - size, want, cluster)
                    return b
            rest >>= step + 1
            left += 1
        return self.new(size, source, cluster)

    def new(self, size: int, source: int, cluster: int) -> int:
        self.left.append(0)
        self.sources.append(0)
        self.clusters.append(0)
        self._hold(len(self.left) - 1, self.capacity - size, 1 << source, cluster)
        return len(self.left) - 1

    def _hold(self, b: int, left: int, source: int, cluster: int) -> None:
        self.left[b] = left
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.at[left].append(b)
        self.some |= 1 << left


def pack_lot(ids: list, sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int, max_sources: int | None = None) -> list[tuple]:
    """``(id, piece, container, tokens, left)`` for every item; an item above ``capacity`` is cut into full pieces and a rest."""
    bins, out = _Bins(capacity, max_sources), []
    _, source_of = np.unique(sources, return_inverse=True)
    _, cluster_of, copies = np.unique(clusters, return_inverse=True, return_counts=True)
    bit = np.where(copies > 1, np.cumsum(copies > 1) - 1, -1)[cluster_of]
    items = []
    for i, size in enumerate(sizes.tolist()):
        whole = (size - 1) // capacity if size > capacity else 0
        for piece in range(whole):
            out.append((ids[i], piece, bins.new(capacity, int(source_of[i]), 0), capacity))
        items.append((size - whole * capacity, i, whole))
    for size, i, piece in sorted(items, key=lambda x: (-x[0], x[1])):
        out.append((ids[i], piece, bins.put(size, int(source_of[i]), 1 << int(bit[i]) if bit[i] >= 0 else 0), size))
    return [(a, piece, b, size, bins.left[b]) for a, piece, b, size in out]


def sized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, source, cluster, n_tokens)`` of ``docs(id, source, text)``; copies of a text form a duplicate cluster."""
    clean = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\s\\x00]+", " "))
    return with_tokens(docs.select("id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(clean).alias("cluster"), "text"), vocabulary)


def pack(items: DataFrame, capacities: dict[str, int], max_sources: int | None = None, lot: int = LOT) -> DataFrame:
    """``(pack_name, id, piece, container, n_tokens, unused_tokens)`` of ``items(id, source, cluster, n_tokens)``.

    Every item is in one container of each capacity, cut only if it alone exceeds it. A container holds no two items of
    one cluster, and items of at most ``max_sources`` sources if that is given. Items are spread by a hash of their id
    over lots of about ``lot`` items, so that neither a source nor a cluster that makes up a third of all rows gathers
    in one task; what lies in the ill filled containers of all lots is packed again in lots, for ``ROUNDS`` rounds, each
    with far fewer items than the one before. Items of no token are put in without using space; rows of null id are
    left out; repeated rows of one id count once. Rows come out for every capacity; an empty table gives none.
    """
    items = items.where("id is not null").select("id", "source", "cluster", "n_tokens").withColumn("pack_name", F.explode(F.array(*map(F.lit, capacities))))
    ddl = "pack_name string, id bigint, source string, cluster bigint, piece int, container bigint, n_tokens int, unused_tokens int"
    rows, done = materialize(items.withColumn("piece", F.lit(0)), "sized"), None

    def packed(rows: DataFrame, turn: int) -> DataFrame:
        sizes = {r.pack_name: max(1, math.ceil(r["count"] / lot)) for r in rows.groupBy("pack_name").count().collect()}  # a row for each capacity
        lots = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)) if sizes else F.create_map(F.lit(""), F.lit(1))

        def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop_duplicates(["id", "piece"]).sort_values(["id", "piece"]).reset_index(drop=True)
            got = pack_lot(list(range(len(rows))), rows.n_tokens.to_numpy(), rows.source.to_numpy(str), rows.cluster.to_numpy(), capacities[key[0]], max_sources)
            at, piece, bins, size, left = (list(x) for x in zip(*got, strict=True))
            out = rows.iloc[at].reset_index(drop=True)
            out["piece"] = out["piece"] + piece  # a cut item's rest keeps its number when it is packed again
            return out.assign(container=[(turn << 56) + (int(key[1]) << 28) + b for b in bins], n_tokens=size, unused_tokens=left)[[c.split()[0] for c in ddl.split(", ")]]

        spread = rows.withColumn("lot", F.pmod(F.xxhash64("id", F.lit(6 + turn)), lots[F.col("pack_name")]).cast("int"))
        return materialize(spread.groupBy("pack_name", "lot").applyInPandas(each, ddl), "packed")

    limit = F.create_map(*(x for name, capacity in capacities.items() for x in (F.lit(name), F.lit(int(capacity * ILL_FILLED)))))[F.col("pack_name")]
    for turn in range(ROUNDS):
        got = packed(rows, turn)
        again = got.where(F.col("unused_tokens") > limit)
        last = turn == ROUNDS - 1 or again.select("pack_name", F.shiftright("container", 28)).distinct().limit(len(capacities) + 1).count() <= len(capacities)  # one lot each
        kept = got if last else got.where(F.col("unused_tokens") <= limit)
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        rows = again.select("id", "source", "cluster", "n_tokens", "pack_name", "piece")
    return done.select("pack_name", "id", "piece", "container", "n_tokens", "unused_tokens")


def unused(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack: containers, the fewest that the tokens could fill, tokens held, tokens unused and the unused share of all capacity."""
    bins = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("held"), F.max("unused_tokens").alias("unused"))
    total = bins.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("held").alias("held_tokens"), F.sum("unused").alias("unused_tokens"))
    share = F.round(F.col("unused_tokens") / (F.col("held_tokens") + F.col("unused_tokens")), 6)
    total = total.join(capacities.select("pack_name", "capacity_tokens"), "pack_name")
    return total.withColumn("least_containers", F.ceil(F.col("held_tokens") / F.col("capacity_tokens"))).withColumn("unused_share", share)


def invariants(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``(pack_name, documents, overfull, needlessly_cut)``: documents placed, containers beyond the capacity, documents cut though they fit."""
    caps = capacities.select("pack_name", "capacity_tokens")
    bins = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("held"), F.max("unused_tokens").alias("left")).join(caps, "pack_name")
    over = bins.groupBy("pack_name").agg(F.count_if(F.col("held") + F.col("left") != F.col("capacity_tokens")).alias("overfull"))
    docs = packed.groupBy("pack_name", "id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("size")).join(caps, "pack_name")
    cut = docs.groupBy("pack_name").agg(F.count("*").alias("documents"), F.count_if(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens")))).alias("needlessly_cut"))
    return cut.join(over, "pack_name").select("pack_name", "documents", "overfull", "needlessly_cut")
