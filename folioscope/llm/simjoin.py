"""Exact set-similarity join of texts by rare-token prefixes.

The tokens are word shingles. All texts agree on one order of the shingles, rarest first; two sets of Jaccard
similarity ``t`` or more must then share a shingle within the first ``n - ceil(t n) + 1`` of each. So only those
prefixes are posted, in an inverted index partitioned by shingle, and only texts that meet in a posting list and
pass the bounds on length, position and remaining overlap become candidates, which are verified on their whole
sets. The order comes from a count sketch of *all* texts: a table of 2**``sketch_bits`` counters whatever the
size of the input, hence safe to broadcast. Counts only decide how fast it goes; any order gives the same pairs.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shingles import WORD, passes, shingles
from folioscope.operators.components import connected_components
from folioscope.plans.materialize import broadcast_if_small, materialize


@dataclass(frozen=True)
class JoinParams:
    """``shingle`` words a token; Jaccard ``threshold``; posting lists longer than ``hot`` go the way of hot lists."""

    shingle: int = 5
    threshold: float = 0.8
    sketch_bits: int = 24
    hot: int = 4096


SEGMENT_BITS = 18
GROUPS = 16
POSTING = pa.schema([("bucket", pa.int32()), ("fresh", pa.bool_())] + [(c, pa.list_(t)) for c, t in (("token", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("rest_a", pa.int64()), ("rest_b", pa.int64()))])
POSTING_DDL = "bucket int, fresh boolean, token array<bigint>, id array<bigint>, n array<int>, pos array<int>, rest_a array<bigint>, rest_b array<bigint>"


def least(share: float, of: np.ndarray) -> np.ndarray:
    return np.ceil(share * of - 1e-9).astype(np.int64)


def can_reach(na: np.ndarray, pa: np.ndarray, nb: np.ndarray, pb: np.ndarray, t: float) -> np.ndarray:
    """Whether sets of sizes ``na`` and ``nb`` that share tokens at places ``pa`` and ``pb`` can still have similarity ``t``."""
    return (np.minimum(na - pa, nb - pb) >= least(t / (1 + t), na + nb)) & (np.minimum(na, nb) >= least(t, np.maximum(na, nb)))


def hash_pair(text: str) -> tuple[int, int]:
    """128 bits of a text, as two numbers."""
    h = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def text_key(text: str | None, k: int) -> tuple[int | None, int | None]:
    """The hash of a text without NULs and with single blanks, so that copies have one key; none for fewer than ``k`` words."""
    if not text:
        return None, None
    text = text.replace("\0", "")
    if next(itertools.islice(WORD.finditer(text), k - 1, None), None) is None:
        return None, None
    return hash_pair(" ".join(text.split()))


def with_key(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with its column ``text`` replaced by ``key`` and ``check``, those of :func:`text_key`."""
    others = [c for c in docs.columns if c != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", key bigint, check bigint"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [text_key(x, k) for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *(pa.array([x[i] for x in keys], pa.int64()) for i in range(2))], names=[*others, "key", "check"])

    return docs.select(*others, "text").mapInArrow(keyed, ddl)


def shingle_levels(texts: DataFrame, p: JoinParams) -> np.ndarray:
    """Rarity of every sketch counter over all of ``texts(id, text)``: 8 log2 of its count, 0 for one or none."""
    bits, seg = p.sketch_bits, min(SEGMENT_BITS, p.sketch_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for a, b in passes(rows):
                np.add.at(table, (shingles(rows[a:b], p.shingle)[1] >> np.uint64(64 - bits)).astype(np.int64), 1)
        for i in range(1 << (bits - seg)):
            part = table[i << seg : (i + 1) << seg]
            if part.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "counts": pa.array([zlib.compress(np.minimum(part, 255).astype(np.uint8).tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(blob), np.uint8).astype(np.uint32)
        for i, x in sums.items():
            level = np.minimum(np.rint(8 * np.log2(np.maximum(x, 1))), 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int32()), "counts": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())})

    ddl = "segment int, counts binary"
    parts = texts.select("text").mapInArrow(count, ddl)
    levels = np.zeros(1 << bits, np.uint8)
    told = parts.repartition(16, "segment").mapInArrow(add, ddl).toArrow()  # 2**bits bytes at most; in one job
    for i, blob in zip(told.column(0).to_pylist(), told.column(1).to_pylist(), strict=True):
        levels[i << seg : (i + 1) << seg] = np.frombuffer(zlib.decompress(blob), np.uint8)
    return levels


def _ordered(of: np.ndarray, s: np.ndarray, n: np.ndarray, levels: np.ndarray, p: JoinParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of some texts, rarest first in each: (shingle, text, level, place, whether it is in the prefix)."""
    level = levels[(s >> np.uint64(64 - p.sketch_bits)).astype(np.int64)]
    order = np.argsort((level.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)))
    order = order[np.argsort(of[order], kind="stable")]
    pos = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
    return s[order], of[order], level[order], pos, pos < np.repeat(n - least(p.threshold, n) + 1, n)


def prefixes(of: np.ndarray, s: np.ndarray, n: np.ndarray, levels: np.ndarray, p: JoinParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(shingle, text, place)`` of the shingles in the texts' prefixes."""
    s, of, _, pos, posted = _ordered(of, s, n, levels, p)
    return s[posted], of[posted].astype(np.int64), pos[posted]


def _remaining(s: np.ndarray, of: np.ndarray, n: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """For each kept place the number of later shingles of its text in each of 16 hash groups (255: that or more)."""
    group = (s >> np.uint64(23)).astype(np.uint8) & 15
    last = (np.cumsum(n) - 1)[of[keep]]
    rest = np.empty((len(keep), GROUPS), np.uint8)
    for g in range(GROUPS):
        c = np.cumsum(group == g, dtype=np.int32)
        rest[:, g] = np.minimum(c[last] - c[keep], 255)
    return rest


def postings(texts: DataFrame, levels, p: JoinParams, buckets: int, fresh: bool = True, drop_unique: bool = True) -> DataFrame:
    """Prefix postings of ``texts(id, text)`` in blocks by ``bucket`` (a hash of the shingle).

    ``levels`` is a broadcast of :func:`shingle_levels`. With ``drop_unique`` shingles that only one text has are
    not posted: right only if ``levels`` counted every text that will be probed.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = levels.value
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_pylist()
            for a, b in passes(rows):
                of, s, n = shingles(rows[a:b], p.shingle)
                if not len(s):
                    continue
                s, of, level, pos, posted = _ordered(of, s, n, level_of, p)
                size = np.repeat(n, n)
                if drop_unique:
                    posted &= level > 0
                keep = np.flatnonzero(posted)
                bucket = (s[keep] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                keep, bucket = keep[order], bucket[order]
                rest = _remaining(s, of, n, keep).view(np.int64)
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
                cuts = pa.array(np.r_[starts, len(bucket)].astype(np.int32))
                lists = [s[keep].view(np.int64), ids[a:b][of[keep]], size[keep].astype(np.int32), pos[keep].astype(np.int32), rest[:, 0], rest[:, 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[starts]), pa.array(np.full(len(starts), fresh)), *(pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(x))) for x in lists)], schema=POSTING
                )

    return texts.select("id", "text").mapInArrow(post, POSTING_DDL)


def _flat(table: pa.Table) -> dict[str, np.ndarray]:
    out = {}
    for c in ("token", "id", "n", "pos", "rest_a", "rest_b"):
        lists = table.column(c).combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        out[c] = lists.flatten().to_numpy()
    sizes = table.column("token").combine_chunks()
    sizes = sizes if isinstance(sizes, pa.ListArray) else pa.concat_arrays(sizes.chunks)
    out["fresh"] = np.repeat(table.column("fresh").to_numpy(), np.diff(sizes.offsets.to_numpy()))
    return out


def _meet(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Which of the pairs (i, j) that share a token can still reach similarity ``t``."""
    need = least(t / (1 + t), x["n"][i].astype(np.int64) + x["n"][j])
    ok = 1 + np.minimum(x["n"][i] - x["pos"][i], x["n"][j] - x["pos"][j]) - 1 >= need
    ok &= (x["fresh"][i] | x["fresh"][j]) & (x["id"][i] != x["id"][j])
    at = np.flatnonzero(ok)
    if len(at):
        a, b = x["rest"][i[at]], x["rest"][j[at]]
        bound = 1 + np.minimum(a, b).sum(1, dtype=np.int64)
        bound[(a == 255).any(1) | (b == 255).any(1)] = np.iinfo(np.int64).max
        ok[at[bound < need[at]]] = False
    return ok


def _pairs_of(x: dict[str, np.ndarray], t: float, hot: int) -> tuple[list, np.ndarray]:
    """Candidate pairs within each token's list, and the tokens whose list is longer than ``hot``."""
    order = np.argsort(x["n"], kind="stable")
    order = order[np.argsort(x["token"][order], kind="stable")]
    x = {c: v[order] for c, v in x.items()}
    x["rest"] = np.stack([x.pop("rest_a"), x.pop("rest_b")], 1).view(np.uint8)
    token, n = x["token"], x["n"].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[starts, len(token)])
    place, length = np.arange(len(token)) - np.repeat(starts, sizes), np.repeat(sizes, sizes)
    left = length - place - 1
    # the smaller set of a pair: it must hold the token early enough to be contained in a set of its own size
    live = np.flatnonzero((left > 0) & (n - x["pos"] >= least(2 * t / (1 + t), n)))
    found, k = [], 1
    hot_list = length > hot
    live_hot = live[hot_list[live]]
    live = live[~hot_list[live]]
    if len(live_hot):  # neighbours and the head only: what they do not connect is looked at later
        for i, j in ((live_hot, live_hot + 1), ((live_hot - place[live_hot]), live_hot)):
            ok = _meet(x, i, j, t)
            found.append((x["id"][i[ok]], x["id"][j[ok]]))
    while len(live):
        j = live + k
        near = n[live] >= least(t, n[j])  # sizes only grow along the list
        live, j = live[near], j[near]
        ok = _meet(x, live, j, t)
        found.append((x["id"][live[ok]], x["id"][j[ok]]))
        k += 1
        live = live[left[live] >= k]
    return found, token[starts[sizes > hot]]


def _emit(found: list, hot: np.ndarray, bucket: int) -> pa.Table:
    a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])] if len(lo) else np.zeros(0, bool)
    lo, hi = lo[new], hi[new]
    return pa.table({
        "a": pa.array(np.r_[lo, hot], pa.int64()), "b": pa.array(np.r_[hi, np.full(len(hot), bucket, np.int64)], pa.int64()),
        "hot": pa.array(np.r_[np.zeros(len(lo), bool), np.ones(len(hot), bool)]),
    })


def candidates(posted: DataFrame, p: JoinParams) -> DataFrame:
    """``(a, b, hot)``: candidate pairs a < b; rows with ``hot`` hold a token and its bucket instead."""
    t, most = p.threshold, p.hot

    def probe(table: pa.Table) -> pa.Table:
        found, hot = _pairs_of(_flat(table), t, most)
        return _emit(found, hot, table.column("bucket")[0].as_py())

    return posted.groupBy("bucket").applyInArrow(probe, "a bigint, b bigint, hot boolean")


def _of_ids(pairs: DataFrame, texts: DataFrame, make, kind: str, label: str) -> DataFrame:
    """``(id, x)`` with what ``make`` gives for each text that occurs in ``pairs``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1).to_pylist()
            for a, b in passes(rows):
                yield pa.RecordBatch.from_arrays([ids[a:b], make(rows[a:b])], names=["id", "x"])

    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    return materialize(texts.select("id", "text").join(broadcast_if_small(wanted), "id", "left_semi").mapInArrow(each, f"id bigint, x {kind}"), label)


def _with_both(pairs: DataFrame, own: DataFrame) -> DataFrame:
    own = own.dropDuplicates(["id"])
    return pairs.join(own.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(own.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")


def bounded(pairs: DataFrame, texts: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle counts in 256 hash groups allow the overlap that the threshold asks for."""

    def profile(rows: list) -> pa.Array:
        of, s, n = shingles(rows, p.shingle)
        counts = np.zeros((len(rows), 256), np.int64)
        np.add.at(counts, (of, (s >> np.uint64(40)).astype(np.int64) & 255), 1)
        small = np.minimum(counts, 255).astype(np.uint8)
        return pa.array([np.int32(k).tobytes() + x.tobytes() for k, x in zip(n, small, strict=True)], pa.binary())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 260) for c in (2, 3))
            need = least(p.threshold / (1 + p.threshold), x[:, :4].copy().view(np.int32)[:, 0].astype(np.int64) + y[:, :4].copy().view(np.int32)[:, 0])
            x, y = x[:, 4:], y[:, 4:]
            ok = (np.minimum(x, y).sum(1, dtype=np.int64) >= need) | (x == 255).any(1) | (y == 255).any(1)
            yield batch.select([0, 1]).filter(pa.array(ok))

    both = _with_both(pairs, _of_ids(pairs, texts, profile, "binary", "profiles"))
    return materialize(both.select("a", "b", "xa", "xb").mapInArrow(check, "a bigint, b bigint"), "bounded")


def verified(pairs: DataFrame, texts: DataFrame, p: JoinParams) -> DataFrame:
    """``(a, b, similarity)`` of the pairs whose whole shingle sets have the threshold's similarity or more.

    Shingles are compared as 32-bit hashes: two different ones of a pair fall together once in millions of pairs.
    """

    def sets(rows: list) -> pa.Array:
        _, s, n = shingles(rows, p.shingle)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array((s >> np.uint64(32)).astype(np.uint32).view(np.int32)))

    both = _with_both(pairs, _of_ids(pairs, texts, sets, "array<int>", "sets"))
    both = both.select("a", "b", F.size(F.array_intersect("xa", "xb")).alias("shared"), (F.size("xa") + F.size("xb")).alias("total"))
    return both.select("a", "b", (F.col("shared") / (F.col("total") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= p.threshold)


def hot_pairs(rows: DataFrame, members: DataFrame, p: JoinParams) -> DataFrame:
    """``(a, b)``: candidates of hot lists ``rows(token, id, n, pos, fresh)`` between texts that are not yet in one group.

    ``members(node, component)`` says which are. Of each list only the texts outside its largest group are compared,
    with all of the list, in salted blocks of about ``hot`` rows each way; lists of one group have nothing left.
    """
    t, fields = p.threshold, ["id", "n", "pos", "fresh", "component"]
    rows = rows.join(members.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = materialize(rows.select("token", *fields), "rows")
    groups = rows.groupBy("token", "component").agg(F.count("*").alias("c"))
    size = groups.groupBy("token").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("c"), F.count("*").alias("groups")).where("groups > 1")
    size = size.select("token", F.col("most.component").alias("largest"), F.ceil(F.col("c") / p.hot).cast("int").alias("blocks"), F.ceil((F.col("c") - F.col("most.c")) / p.hot).cast("int").alias("others"))
    rows = rows.join(broadcast_if_small(materialize(size, "hot-lists")), "token")
    across, block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("others")).cast("int"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.where("component <> largest").select("token", across.alias("i"), every("blocks").alias("j"), F.lit(True).alias("outside"), *fields)
    right = rows.select("token", every("others").alias("i"), block.alias("j"), F.lit(False).alias("outside"), *fields)

    def probe(table: pa.Table) -> pa.Table:
        x = {c: table.column(c).to_numpy() for c in fields}
        outside, found = table.column("outside").to_numpy(), [np.zeros((0, 2), np.int64)]
        right = np.flatnonzero(~outside)
        for at in np.flatnonzero(outside):
            with_ = right[(x["component"][right] != x["component"][at]) & (x["fresh"][right] | x["fresh"][at])]
            with_ = with_[can_reach(x["n"][with_].astype(np.int64), x["pos"][with_], np.int64(x["n"][at]), x["pos"][at], t)]
            found.append(np.stack([np.full(len(with_), x["id"][at]), x["id"][with_]], 1))
        pairs = np.concatenate(found)
        pairs = np.unique(np.stack([pairs.min(1), pairs.max(1)], 1), axis=0) if len(pairs) else pairs
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return left.unionByName(right).groupBy("token", "i", "j").applyInArrow(probe, "a bigint, b bigint")


def _hot_rows(posted: DataFrame, hot: DataFrame) -> DataFrame:
    fields = ["token", "id", "n", "pos"]
    rows = posted.join(hot.select(F.col("b").cast("int").alias("bucket")).distinct(), "bucket", "left_semi")
    rows = rows.select("fresh", F.explode(F.arrays_zip(*fields)).alias("x")).select("fresh", *(f"x.{c}" for c in fields))
    return rows.join(hot.select(F.col("a").alias("token")).distinct(), "token", "left_semi")


def join_links(posted: DataFrame, texts: DataFrame, p: JoinParams, prune=None) -> DataFrame:
    """``(a, b, similarity)``: links that connect every group of near-duplicate texts.

    Every near-duplicate pair is among them, except that within a posting list longer than ``p.hot`` pairs whose
    ends are already connected are left out. ``prune`` maps candidate pairs to those worth verifying.
    """
    keep = prune or (lambda pairs: bounded(pairs, texts, p))
    first = materialize(candidates(posted, p), "candidates")
    links = materialize(verified(keep(first.where("not hot").select("a", "b").distinct()), texts, p), "near")
    hot = first.where("hot")
    if hot.isEmpty():
        return links
    members = connected_components(links, "a", "b")
    more = materialize(hot_pairs(_hot_rows(posted, hot), members, p).distinct(), "hot")
    return links.unionByName(verified(keep(more), texts, p))


def bucket_count(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def copies(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """``(id, first)`` of every row of ``df(id, text, *order)`` whose text another row has before it.

    Texts are the same here if they differ in NULs and runs of white space alone; texts of fewer than ``k`` words have
    no copies. Only hashes are shuffled.
    """
    keyed = materialize(with_key(df.select("id", *order, "text"), k).where("key is not null").select("id", "key", "check", F.struct(*order, "id").alias("o")), "keys")
    groups = keyed.groupBy("key", "check").agg(F.min("o").alias("o"), F.count("*").alias("c")).where("c > 1").select("key", "check", F.col("o.id").alias("first"))
    return keyed.select("id", "key", "check").join(groups, ["key", "check"]).where("id <> first").select("id", "first").distinct()


def firsts(links: DataFrame, docs: DataFrame, order: list[str]) -> DataFrame:
    """``(first_id, id)`` for every row of ``docs(id, *order)`` that the links ``(a, b)`` connect to one before it."""
    groups = materialize(connected_components(links, "a", "b").withColumnRenamed("node", "id"), "groups")
    members = docs.select("id", *order).join(groups, "id").distinct()
    first = members.groupBy("component").agg(F.min(F.struct(*order, "id"))["id"].alias("first_id"))
    return members.join(first, "component").where("id <> first_id").select("first_id", "id").distinct()


def near_links(docs: DataFrame, order: list[str], p: JoinParams, prune=None) -> DataFrame:
    """``(a, b)``: links that connect every group of near-duplicate texts of ``docs(id, text, *order)``, copies included.

    Copies are set aside by hash first, so that a text that makes up a third of all rows is joined once.
    ``prune(pairs, texts)`` keeps the candidates worth verifying.
    """
    same = materialize(copies(docs, order, p.shingle), "copies")
    single = docs.join(broadcast_if_small(same.select("id")), "id", "left_anti")
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(single, p))
    posted = postings(single, levels, p, bucket_count(docs))
    links = join_links(posted, single, p, prune and (lambda pairs: prune(pairs, single)))
    return links.select("a", "b").unionByName(same.select(F.col("first").alias("a"), F.col("id").alias("b")))


def near_duplicate_groups(docs: DataFrame, order: list[str], p: JoinParams = JoinParams(), prune=None) -> DataFrame:
    """``(first_id, id)`` for every text of ``docs(id, text, *order)`` that is not the first of its group.

    A group is connected through pairs of similarity ``p.threshold`` or more; the first is the least by ``order``
    and ``id``. Texts of fewer than ``p.shingle`` words (null and empty ones too) belong to no group. Repeated rows of
    one id count once (of different texts under one id each may link it); rows of null id are left out; an empty table
    gives an empty result; other columns are not looked at.
    """
    docs = docs.where("id is not null").select("id", "text", *order)
    return firsts(near_links(docs, order, p, prune), docs, order)
