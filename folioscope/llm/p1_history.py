"""Problem 1: duplicates of a new batch among all accepted documents, by a growing rare-token prefix index."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shingles import passes, shingles
from folioscope.llm.simjoin import JoinParams, can_reach, hot_pairs, prefixes, shingle_levels, with_key
from folioscope.operators.components import connected_components
from folioscope.plans.materialize import broadcast_if_small, materialize, materialize_and_count

#: As TESTDATA.md has it for this data: three words, similarity 0.6.
NEAR = JoinParams(shingle=3, threshold=0.6)
EMPTY_FILE = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: Words of 64 bits of a document's parity sketch.
PROFILE = 8
#: Rows of narrow tables that are broadcast at most, and documents with their sketches; of more there is a shuffle join.
SENT, SENT_DOCS = 1_000_000, 200_000
ENTRY = {
    "kind": "string", "part": "int", "batch": "int",
    "id": "bigint", "n": "int", "profile": "array<bigint>", "set": "binary",
    "ids": "binary", "sizes": "binary", "token": "binary", "doc": "binary", "pos": "binary",
}
#: How the numbers of a block are packed.
PACKED = {"ids": np.int64, "sizes": np.int32, "token": np.uint32, "doc": np.uint16, "pos": np.int32}
ENTRY_DDL = ", ".join(f"{c} {t}" for c, t in ENTRY.items())


def clean_hash(column: str):
    """A SHA-256 in lower-case hex, whatever prefix, case or blanks it was written with; null if it is none or an empty file's."""
    hexa = F.regexp_extract(F.lower(F.col(column)), "([0-9a-f]{64})\\s*$", 1)
    return F.when((hexa != "") & (hexa != EMPTY_FILE), hexa)


def _rows(columns: dict, n: int) -> pa.RecordBatch:
    """A batch of the entry table; columns that are not given are null."""
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    arrays = [columns[c].cast(arrow[t]) if c in columns else pa.nulls(n, arrow[t]) for c, t in ENTRY.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(ENTRY))


def _packed(values: np.ndarray, sizes: np.ndarray, kind: type) -> pa.Array:
    """Runs of ``sizes`` values as bytes."""
    values = np.ascontiguousarray(values, kind)
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def entries(texts: DataFrame, levels, p: JoinParams, number: int, buckets: int) -> DataFrame:
    """The index entries of ``texts(id, text)``, which are batch ``number``: one pass over the texts makes both kinds.

    ``doc``: a document's shingles as 32-bit hashes and a parity sketch of them, in the part of its id. ``list``: blocks
    of the inverted file, in the part of the tokens' bucket: the prefix postings of some documents, ordered by token.
    """

    def sketches(of: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, PROFILE), np.int64)
        for a in range(0, n, 2048):
            lo, hi = np.searchsorted(of, [a, min(a + 2048, n)])
            bits = (of[lo:hi].astype(np.int64) - a) * (64 * PROFILE) + (s[lo:hi] & np.uint64(64 * PROFILE - 1)).astype(np.int64)
            odd = np.bincount(bits, minlength=min(2048, n - a) * 64 * PROFILE) & 1
            out[a : a + 2048] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, PROFILE)
        return out

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_pylist()
            for a, b in passes(rows):
                of, s, n = shingles(rows[a:b], p.shingle)
                own = ids[a:b]
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                profile = sketches(of, s, b - a)[has]
                yield _rows({
                    "kind": pa.array(["doc"] * len(has)), "part": pa.array(own[has] % buckets), "batch": pa.array(np.full(len(has), number)), "id": pa.array(own[has]), "n": pa.array(n[has]),
                    "profile": pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * PROFILE), pa.array(profile.ravel())), "set": _packed(s >> np.uint64(32), n[has], np.uint32),
                }, len(has))
                token, doc, pos = prefixes(of, s, n, levels.value, p)
                part = (token % np.uint64(buckets)).astype(np.int64)
                token = (token >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((token, part))
                part, token, doc, pos = part[order], token[order], doc[order], pos[order]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
                docs, sizes, local = [], [], []
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    there, at = np.unique(doc[lo:hi], return_inverse=True)
                    docs.append(there)
                    sizes.append(len(there))
                    local.append(at)
                if docs:
                    there, count = np.concatenate(docs), np.diff(cuts)
                    yield _rows({
                        "kind": pa.array(["list"] * len(sizes)), "part": pa.array(part[cuts[:-1]]), "batch": pa.array(np.full(len(sizes), number)),
                        **{c: _packed(x, k, PACKED[c]) for c, x, k in (("ids", own[there], sizes), ("sizes", n[there], sizes), ("token", token, count), ("doc", np.concatenate(local), count), ("pos", pos, count))},
                    }, len(sizes))

    return texts.select("id", "text").mapInArrow(make, ENTRY_DDL)


class _Block:
    """Postings of one bucket, ordered by token."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, token: np.ndarray, doc: np.ndarray, pos: np.ndarray):
        self.ids, self.sizes, self.token, self.doc, self.pos = ids, sizes, token, doc, pos

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> _Block:
        return cls(*(np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in PACKED.items()))

    @classmethod
    def joined(cls, blocks: list[_Block]) -> _Block:
        order = np.argsort(np.concatenate([b.token for b in blocks]), kind="stable")
        start = np.cumsum([0, *(len(b.ids) for b in blocks)])
        doc = np.concatenate([b.doc.astype(np.int32) + k for b, k in zip(blocks, start, strict=False)])
        ids, sizes, token, pos = (np.concatenate([getattr(b, c) for b in blocks]) for c in ("ids", "sizes", "token", "pos"))
        return cls(ids, sizes, token[order], doc[order], pos[order])

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(id, n, pos)`` of some postings."""
        return self.ids[self.doc[at]], self.sizes[self.doc[at]].astype(np.int64), self.pos[at]


def _meet(old: _Block, new: _Block, p: JoinParams, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (new id, old id) that share a token and can still reach the threshold, and the tokens of hot lists.

    Of a token with more than ``hot`` squared pairs in these blocks, rows are paired with the heads of the lists and
    one row each only; the rest is looked at later. With ``same`` both are the batch itself: pairs count once.
    """
    lo, hi = np.searchsorted(new.token, old.token, "left"), np.searchsorted(new.token, old.token, "right")
    starts = np.searchsorted(old.token, old.token, "left")
    length = np.searchsorted(old.token, old.token, "right") - starts
    hot = (hi - lo) * length > p.hot**2
    at = np.flatnonzero((hi > lo) & ~hot)
    i = np.repeat(at, (hi - lo)[at])
    j = np.arange(len(i)) - np.repeat(np.cumsum((hi - lo)[at]) - (hi - lo)[at], (hi - lo)[at]) + lo[i]
    at = np.flatnonzero(hot)
    if len(at):
        mine, heads = np.arange(len(at)), np.flatnonzero(hot & (starts == np.arange(len(hot))))
        each = [np.arange(lo[x], hi[x]) for x in heads]
        i = np.concatenate([i, at, at, *(np.full(len(e), x) for e, x in zip(each, heads, strict=True))])
        j = np.concatenate([j, lo[at], lo[at] + (mine - np.searchsorted(at, starts[at]) + same) % (hi - lo)[at], *each])
    (a, na, pa_), (b, nb, pb) = new.rows(j), old.rows(i)
    ok = can_reach(na, pa_, nb, pb, p.threshold)
    a, b = a[ok], b[ok]
    if same:
        a, b = np.maximum(a, b), np.minimum(a, b)
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1], np.unique(old.token[at])


class HistoryIndex:
    """All accepted documents as an inverted index of rare-token prefixes, in a folder that all executors share.

    ``entries`` holds the postings partitioned by a hash of the token and the documents' shingle sets partitioned by id,
    ``keys`` the first owner of each hash, ``links`` what was found, ``levels`` the rarity order. :meth:`add` takes a
    batch: its postings are sent to the posting lists of the same buckets (at most ``most`` at once; a larger batch goes
    by slices of buckets), only pairs with one end in the batch are made, and only sets of their ends are read. Nothing
    of the history is shuffled, rewritten or compared with itself, and its texts are not read. The order is fixed by
    :meth:`start`; it decides speed only, and :meth:`reordered` makes a new index when the history has outgrown it.
    """

    def __init__(self, spark: SparkSession, path: str, p: JoinParams = NEAR, buckets: int = 8, most: int = 1_000_000):
        self.spark, self.path, self.p, self.buckets, self.most = spark, path, p, buckets, most
        self._levels, self._number = None, None

    def start(self, texts: DataFrame) -> HistoryIndex:
        """Fix the rarity order by a count over ``texts(id, text)``: what is at hand when the index begins."""
        levels = shingle_levels(texts, self.p)
        packed = zlib.compress(levels.tobytes(), 1)  # whole, the table went through the driver's heap several times
        self.spark.createDataFrame([(packed,)], "levels binary").coalesce(1).write.parquet(f"{self.path}/levels")
        self._levels = self.spark.sparkContext.broadcast(levels)
        return self

    def reordered(self, path: str, texts: DataFrame) -> HistoryIndex:
        """A new index of all accepted ``texts`` in an order that counts them all, to be made when they have grown fourfold."""
        new = HistoryIndex(self.spark, path, self.p, self.buckets, self.most).start(texts)
        for table in ("keys", "links"):
            if (old := self._table(table)) is not None:
                old.write.partitionBy("role").parquet(f"{path}/{table}")
        new._number, posted = self._number, self._read("doc").select("id", "batch")
        for (number,) in sorted(posted.select("batch").distinct().collect()):  # a row for each batch
            entries(texts.join(posted.where(F.col("batch") == number), "id", "left_semi"), new.levels, self.p, number, self.buckets).write.mode("append").option("compression", "zstd").partitionBy("kind", "part").parquet(f"{path}/entries")
        return new

    @property
    def levels(self):
        if self._levels is None:
            packed = self.spark.read.schema("levels binary").parquet(f"{self.path}/levels").head()[0]
            self._levels = self.spark.sparkContext.broadcast(np.frombuffer(zlib.decompress(packed), np.uint8))
        return self._levels

    KEYS = "kind string, key bigint, check bigint, id bigint, owner bigint, batch int, role string"

    def _there(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _table(self, table: str) -> DataFrame | None:
        return self.spark.read.schema(self.KEYS).parquet(f"{self.path}/{table}") if self._there(table) else None

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(ENTRY_DDL).option("basePath", f"{self.path}/entries").parquet(f"{self.path}/entries/kind={kind}")

    def links(self, batch: int | None = None) -> DataFrame:
        """``(a, b, kind, batch)``: document ``a`` repeats the earlier document ``b``, by which kind; of one batch or all."""
        found = [t.where("role = 'copy'") for t in map(self._table, ("keys", "links")) if t is not None]
        if not found:
            return self.spark.createDataFrame([], "a bigint, b bigint, kind string, batch int")
        out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        out = out if batch is None else out.where(F.col("batch") == batch)
        return out.select(F.col("id").alias("a"), F.col("owner").alias("b"), "kind", "batch")

    def add(self, batch: DataFrame) -> int:
        """Compare ``batch(id, text[, raw, norm])`` with all accepted documents and with itself, accept it, and give its number.

        Ids grow in the order of arrival. Equal raw or normalized hashes, equal texts and near-duplicate texts link a
        document to an earlier one; null hashes match nothing, texts of fewer than ``shingle`` words (null and empty ones
        too) only match by hash. Rows of null id are left out, repeated rows of one id count once (of different texts
        under one id each may link it), other columns are not looked at; an empty batch changes nothing.
        """
        if self._number is None:  # a new index, or a folder that an earlier session made
            known = self._table("keys")
            last = None if known is None else known.agg(F.max("batch")).head()[0]
            self._number = -1 if last is None else last
        number = self._number = self._number + 1
        batch = batch.where("id is not null")
        texts = batch.select("id", "text")
        if n := self._keys(batch, number):
            copies = self.links(number).where("kind = 'text'").select(F.col("a").alias("id")).distinct()
            texts = texts.join(F.broadcast(copies) if n <= SENT else copies, "id", "left_anti")
        seen = Observation()
        sizes = (F.sum(F.when(F.col("part") == i, F.octet_length("token"))).alias(str(i)) for i in range(self.buckets))
        made = entries(texts, self.levels, self.p, number, self.buckets).observe(seen, F.count_if(F.col("kind") == "doc").alias("docs"), *sizes)
        made.write.mode("append").option("compression", "zstd").partitionBy("kind", "part").parquet(f"{self.path}/entries")
        sizes = {part: n for part, n in seen.get.items() if n}
        docs = sizes.pop("docs", 0)
        if not sizes:
            return number
        pairs, cold, hot = self._pairs(number, {int(part): n // 4 for part, n in sizes.items()})
        self._verify(pairs.where("hot is null").select("a", "b"), cold, number, docs)
        if hot:
            more, told = materialize_and_count(self._hot(pairs.where("hot is not null"), number), "hot", n=F.count("*"))
            self._verify(more, told["n"] or 0, number, docs)
        return number

    def _keys(self, batch: DataFrame, number: int) -> int:
        """Give each hash of the batch its first owner, in the history or the batch; other documents of the hash link to it.

        The number of links by text is given back.
        """
        names = [c for c in ("raw", "norm") if c in batch.columns]
        own = with_key(batch.select("id", *names, "text"), self.p.shingle)
        hashes = [F.struct(F.lit("text").alias("kind"), "key", "check"), *(F.struct(F.lit(c).alias("kind"), F.xxhash64(c).alias("key"), F.xxhash64(F.length(c), c).alias("check")) for c in names)]
        there = [F.when(F.col(c).isNotNull(), h) for c, h in zip(["key", *names], hashes, strict=True)]
        own = materialize(own.select("id", F.explode(F.array_compact(F.array(*there))).alias("h")).select("id", "h.*"), "keys")  # a repeated row repeats its links, which changes no group
        first, names = own.groupBy("kind", "key", "check").agg(F.min("id").alias("first")), ["kind", "key", "check"]
        known = self._table("keys")
        first = first.withColumn("known", F.lit(None).cast("bigint")) if known is None else first.join(known.where("role = 'own'").select(*names, F.col("owner").alias("known")), names, "left")
        placed = own.join(first, names).select("kind", "key", "check", "id", F.coalesce("known", "first").alias("owner"), F.lit(number).alias("batch"), F.when(F.col("known").isNull() & (F.col("id") == F.col("first")), "own").otherwise("copy").alias("role"))
        seen = Observation()
        placed = placed.where("role = 'own' or id <> owner").observe(seen, F.count_if((F.col("kind") == "text") & (F.col("role") == "copy")).alias("n"))
        placed.write.mode("append").partitionBy("role").parquet(f"{self.path}/keys")
        return seen.get.get("n") or 0

    def _pairs(self, number: int, sizes: dict[int, int]) -> tuple[DataFrame, int, int]:
        """``(a, b, hot)``: candidates of the batch, of ``sizes`` postings in each bucket; of a hot list its token instead.
        With the numbers of candidates and of hot tokens."""
        lists, out, cold, hot = self._read("list"), None, 0, 0
        for parts in slices(sizes, self.most):
            there = lists.where(F.col("part").isin(parts))
            fresh: dict[int, list] = {}
            for block in there.where(F.col("batch") == number).select("part", *PACKED).toArrow().to_batches():  # most postings at most, or one bucket
                for i, part in enumerate(block.column(0).to_pylist()):
                    fresh.setdefault(part, []).append(_Block.of(block, i))
            sent = self.spark.sparkContext.broadcast({part: _Block.joined(blocks) for part, blocks in fresh.items()})
            got, told = materialize_and_count(self._probed(there, sent, number).distinct(), "pairs", n=F.count("*"), hot=F.count("hot"))
            sent.destroy()
            cold, hot = cold + (told["n"] or 0) - (told["hot"] or 0), hot + (told["hot"] or 0)
            out = got if out is None else out.unionByName(got)
        return out, cold, hot

    def _probed(self, lists: DataFrame, fresh, number: int) -> DataFrame:
        p = self.p

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, (part, of) in enumerate(zip(batch.column("part").to_pylist(), batch.column("batch").to_pylist(), strict=True)):
                    a, b, hot = _meet(_Block.of(batch, i), fresh.value[part], p, of == number)
                    none = pa.nulls(len(hot), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a, pa.int64()), none]), pa.concat_arrays([pa.array(b, pa.int64()), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(hot.astype(np.int64) | (part << 32), pa.int64())])], names=["a", "b", "hot"])

        return lists.select("part", "batch", *PACKED).mapInArrow(probe, "a bigint, b bigint, hot bigint")

    def _verify(self, pairs: DataFrame, n: int, number: int, n_new: int) -> None:
        """Keep as links those of the ``n`` pairs (new, old) that have the threshold's similarity; ``n_new`` documents are new.

        Parity sketches bound the difference of two sets from below; of what they leave, whole sets are compared, as
        32-bit hashes: two different ones of a pair fall together once in millions of pairs.
        """
        if not n:
            return
        docs, t = self._read("doc"), self.p.threshold
        new = docs.where(F.col("batch") == number)
        own = new.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa"))
        near = docs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb")).join(F.broadcast(pairs) if n <= SENT else pairs, "b")
        near = near.join(F.broadcast(own) if n_new <= SENT_DOCS else own, "a")
        apart, total = sum(F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(PROFILE)), F.col("na") + F.col("nb")
        near = near.where(total - apart >= 2 * F.ceil(t / (1 + t) * total - 1e-9)).select("a", "b")
        part = F.pmod("b", F.lit(self.buckets))
        near, told = materialize_and_count(near, "near", **{str(i): F.count_if(part == i) for i in range(self.buckets)})
        parts = [int(i) for i, k in told.items() if k]
        if not parts:
            return
        near = F.broadcast(near) if sum(filter(None, told.values())) <= SENT else near
        left = new.select(F.col("id").alias("a"), F.col("set").alias("xa")).join(near.select("a").distinct(), "a", "left_semi")
        both = docs.where(F.col("part").isin(parts)).select(F.col("id").alias("b"), F.col("set").alias("xb")).join(near, "b").join(left, "a")

        def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                    shared = len(np.intersect1d(x, y))
                    keep.append(shared >= t * (len(x) + len(y) - shared) - 1e-9)
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        links = both.select("a", "b", "xa", "xb").mapInArrow(similar, "a bigint, b bigint")
        none = F.lit(None).cast("bigint")
        links = links.select(F.lit("near").alias("kind"), none.alias("key"), none.alias("check"), F.col("a").alias("id"), F.col("b").alias("owner"), F.lit(number).alias("batch"), F.lit("copy").alias("role")).distinct()
        links.write.mode("append").partitionBy("role").parquet(f"{self.path}/links")

    def _hot(self, hot: DataFrame, number: int) -> DataFrame:
        """Candidates of hot lists between documents that no links connect yet, one of them new."""
        tokens = materialize(hot.select(F.col("hot").alias("token")).distinct(), "tokens")
        parts = [r.p for r in tokens.select(F.shiftright("token", 32).cast("int").alias("p")).distinct().collect()]  # buckets rows at most

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, (part, of) in enumerate(zip(batch.column("part").to_pylist(), batch.column("batch").to_pylist(), strict=True)):
                    block = _Block.of(batch, i)
                    ids, n, pos = block.rows(np.arange(len(block.token)))
                    yield pa.RecordBatch.from_arrays([pa.array(block.token.astype(np.int64) | (part << 32)), pa.array(np.full(len(ids), of == number)), pa.array(ids), pa.array(n.astype(np.int32)), pa.array(pos)], names=["token", "fresh", "id", "n", "pos"])

        blocks = self._read("list").where(F.col("part").isin(parts)).select("part", "batch", *PACKED)
        rows = blocks.mapInArrow(unpack, "token bigint, fresh boolean, id bigint, n int, pos int")
        rows = rows.join(broadcast_if_small(tokens), "token", "left_semi")
        pairs = hot_pairs(rows, connected_components(self.links(), "a", "b"), self.p)
        fresh = materialize(self._read("doc").where(F.col("batch") == number).select("id").distinct(), "fresh")
        for end in ("a", "b"):
            pairs = pairs.join(broadcast_if_small(fresh.select(F.col("id").alias(end), F.lit(True).alias(f"new_{end}"))), end, "left")
        a, b, both = F.col("a"), F.col("b"), F.col("new_a").isNotNull() & F.col("new_b").isNotNull()
        new = F.when(both, F.greatest(a, b)).when(F.col("new_a").isNotNull(), a).otherwise(b)
        old = F.when(both, F.least(a, b)).when(F.col("new_a").isNotNull(), b).otherwise(a)
        return pairs.where("new_a is not null or new_b is not null").select(new.alias("a"), old.alias("b")).distinct()

    def duplicates(self, number: int) -> DataFrame:
        """``(id, duplicate_of, matched_by)`` for each document of batch ``number`` that repeats an accepted or an earlier one of its batch.

        ``duplicate_of`` is the first document of its group, connected through all links so far; ``matched_by`` is the
        document's own strongest link: raw_hash, normalized_hash, else near_text. Groups are followed from the
        batch's own links, a step at a time, so that only groups that the batch touches are looked at.
        """
        own, links = materialize(self.links(number), "own"), self.links().select("a", "b")
        touched = materialize(own.select("a", "b"), "touched")
        known = touched.count()
        while True:
            ends = materialize(touched.select(F.explode(F.array("a", "b")).alias("x")).distinct(), "ends")
            ends = broadcast_if_small(ends)
            touched = materialize(links.join(ends, F.col("a") == F.col("x"), "left_semi").unionByName(links.join(ends, F.col("b") == F.col("x"), "left_semi")).distinct(), "touched")
            if (more := touched.count()) == known:
                break
            known = more
        strength = F.when(F.col("kind") == "raw", 0).when(F.col("kind") == "norm", 1).otherwise(2)
        by = own.groupBy(F.col("a").alias("id")).agg(F.min(strength).alias("s"))
        groups = connected_components(touched, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("duplicate_of"))
        ends = own.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        members = ends.join(own.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
        named = F.element_at(F.array(*map(F.lit, ("raw_hash", "normalized_hash", "near_text"))), F.col("s") + 1)
        return members.join(groups, "id").where("id <> duplicate_of").join(by, "id").select("id", "duplicate_of", named.alias("matched_by"))


def slices(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Buckets in runs of ``most`` postings at most, or one bucket."""
    out, held = [], 0
    for part, size in sorted(sizes.items()):
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(part)
        held += size
    return out


def batch_rows(documents: DataFrame) -> DataFrame:
    """The columns of ``documents`` that :class:`HistoryIndex` takes, for one batch."""
    return documents.select(F.col("doc_id").alias("id"), "text", clean_hash("raw_content_hash").alias("raw"), clean_hash("normalized_content_hash").alias("norm"))
