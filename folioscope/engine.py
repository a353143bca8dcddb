"""The index over folders of files as one object: scan, index, search, report."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.config import Config
from folioscope.functions import text as t
from folioscope.operators import analysis, chunking, dedup, embedding, retrieval as r, status, store, summaries, sync
from folioscope.plans.materialize import materialize
from folioscope.sources import files
from folioscope.streaming import watch


@dataclass(frozen=True)
class Plugins:
    """What can be replaced: the embedder (called once a task), a scorer of query and text, a parser of other files, and
    generators of summaries, of the questions that chunks answer and of a passage that might answer a query."""

    embedder: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: embedding.hash_vectors
    scorer: Callable[[], Callable[[list[str], list[str]], list[float]]] | None = None
    parser: Callable[[str, bytes], list[tuple]] | None = None
    summarizer: Callable[[list[str]], list[str | None]] | None = None
    questioner: Callable[[list[str]], list[list[str] | None]] | None = None
    hypothetical: Callable[[list[str]], list[str | None]] | None = None


class Engine:
    """Tables ``state``, ``documents``, ``sections``, ``chunks`` and ``points`` in one folder.

    Document ids follow from file paths, so indexing a file again replaces its rows and deleting it removes them.
    """

    KEYS = {"state": ["file_path"], "documents": ["doc_id"], "sections": ["section_id"], "chunks": ["chunk_id"], "points": ["point_id"]}

    def __init__(self, spark: SparkSession, config: Config, plugins: Plugins = Plugins()):
        self.spark, self.config, self.plugins = spark, config, plugins
        base = config.store if "://" in config.store else f"file://{config.store}"
        self.tables = {name: store.Table(spark, f"{base}/{name}", key) for name, key in self.KEYS.items()}

    def read(self, table: str) -> DataFrame:
        df = self.tables[table].read()
        if df is None:
            raise LookupError("nothing is indexed yet")
        return df

    def changes(self) -> DataFrame:
        """``(file_path, event_type)`` since the last run; contents are read and hashed only where times differ.

        Files that failed are tried again when their wait is over, and left alone before, unless they were changed.
        """
        now = files.listing(self.spark, list(self.config.folders.paths), list(self.config.folders.ignore))
        state = self.tables["state"].read()
        seen = now.select("file_path", F.col("modified_at").cast("string").alias("modified_at"))
        if state is None:
            return seen.select("file_path", F.lit("created").alias("event_type"))
        touched = seen.join(state.where("not is_deleted").select("file_path", F.col("modified_at").alias("m")), "file_path").where(~F.equal_null("modified_at", "m")).select("file_path")
        hashed = self._scan(materialize(touched, "touched")).select("file_path", "content_hash")
        old = state.select("file_path", F.col("content_hash").alias("h"))
        snapshot = seen.join(hashed, "file_path", "left").join(old, "file_path", "left").select("file_path", "modified_at", F.coalesce("content_hash", "h").alias("content_hash"))
        held = sync.held_back(state, F.current_timestamp(), t.iso_time(F.col("synced_at")))
        again = held.where("again").select("file_path").join(snapshot.select("file_path"), "file_path", "left_semi").withColumn("event_type", F.lit("modified"))
        return sync.rescan(snapshot, state).unionByName(again).dropDuplicates(["file_path"])

    def _scan(self, only: DataFrame) -> DataFrame:
        return files.scan(self.spark, list(self.config.folders.paths), list(self.config.folders.ignore), only)

    def index(self, paths: list[str] | None = None) -> dict[str, int]:
        """One run over what changed, or over the files of ``paths`` whether they changed or not; numbers of files by outcome."""
        if paths is None:
            events = materialize(self.changes(), "events")
        else:
            events = self.spark.createDataFrame([(p, "modified") for p in dict.fromkeys(paths)], "file_path string, event_type string")
        there = self._scan(events.where("event_type <> 'deleted'"))
        parsed = files.texts(there.where(F.col("file_type").isin("txt", "md"))).withColumn("doc_id", F.xxhash64("file_path"))
        parsed = materialize(parsed.drop("content"), "parsed")
        good = parsed.where("error is null")
        sections = self._sections(good, there)
        whole = status.assembled(sections).select("doc_id", F.sha2("text", 256).alias("norm_hash"), "text")
        docs = there.select("file_path", "folder_path", "file_type", "size_bytes", F.col("modified_at").cast("string").alias("modified_at"), F.col("content_hash").alias("raw_hash")).withColumn("doc_id", F.xxhash64("file_path")).join(whole, "doc_id")
        docs = materialize(docs.withColumns({"title": F.regexp_replace(t.file_name(F.col("file_path")), "\\.[^.]*$", ""), "folder_ancestors": t.folder_ancestors(F.col("folder_path")), "indexed_at": F.current_timestamp()}), "documents")
        known = self.tables["documents"].read()
        hashes = docs.select("file_path", "raw_hash", "norm_hash")
        decided = dedup.decide(hashes, hashes.limit(0) if known is None else known.join(docs.select("doc_id"), "doc_id", "left_anti").select("file_path", "raw_hash", "norm_hash"))
        docs = materialize(docs.join(decided, "file_path"), "decided")
        own = docs.where("outcome = 'index'").select("doc_id")
        sections = materialize(sections.join(own, "doc_id", "left_semi"), "sections")
        chunks = materialize(self._chunks(sections), "chunks")
        points = materialize(self._points(docs.where("outcome = 'index'"), sections, chunks), "points")
        gone = materialize(events.where("event_type = 'deleted'").select("file_path", F.xxhash64("file_path").alias("doc_id")), "gone")
        touched = docs.select("doc_id").unionByName(gone.select("doc_id")).distinct()
        for name, new in (("documents", docs.drop("text")), ("sections", sections), ("chunks", chunks), ("points", points)):
            old = self.tables[name].read()
            self.tables[name].write(new if old is None else old.join(touched, "doc_id", "left_anti").unionByName(new, allowMissingColumns=True))
        self._note(parsed, docs, gone)
        counts = {x["outcome"]: x["n"] for x in docs.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        return counts | {"deleted": gone.count(), "error": parsed.where("error is not null").count()}

    def _sections(self, good: DataFrame, there: DataFrame) -> DataFrame:
        md = files.markdown_sections(good.where("file_type = 'md'").select("doc_id", "text"))
        plain = good.where("file_type = 'txt'").select("doc_id", F.lit(0).alias("section_order"), F.lit(None).cast("string").alias("heading"), "text")
        rows = md.unionByName(plain)
        if self.plugins.parser is not None:
            items = files.parsed(there, self.plugins.parser, ["pdf", "docx"]).where("label <> 'error'").withColumn("doc_id", F.xxhash64("file_path"))
            rows = rows.unionByName(files.items_to_sections(items), allowMissingColumns=True)
        for c in ("page_start", "page_end"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("int"))
        rows = rows.withColumn("text", t.normalize_text(F.col("text"))).where("text <> ''")
        name = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("section"), F.col("section_order").cast("string"))
        return materialize(rows.withColumn("section_id", t.uuid5(name)), "normalized")

    def _chunks(self, sections: DataFrame) -> DataFrame:
        c = self.config.chunking
        cut = chunking.fixed_chunks(sections) if c.strategy == "fixed" else chunking.semantic_chunks(sections, self.plugins.embedder(), c.similarity_threshold, c.max_sentences)
        return cut.join(sections.select("section_id", F.col("heading").alias("section_heading"), "page_start", "page_end"), "section_id")

    def _points(self, docs: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
        own = chunks.select(F.col("chunk_id").alias("point_id"), "doc_id", F.lit("chunk").alias("record_type"), F.col("chunk_text").alias("text"), "chunk_order", "section_id")
        if self.plugins.questioner is not None:
            own = own.join(materialize(summaries.questions(own, "point_id", "text", self.plugins.questioner), "questions"), "point_id", "left")
        else:
            own = own.withColumn("questions", F.lit(None).cast("array<string>"))
        rows = summaries.summary_points(docs, sections, self.plugins.summarizer).unionByName(own, allowMissingColumns=True)
        shown = F.when(F.size("questions") > 0, t.augmented_text(F.col("text"), F.col("questions"))).otherwise(F.col("text"))
        return embedding.embedded(rows.withColumn("shown", shown), "shown", self.plugins.embedder).drop("shown")

    def _note(self, parsed: DataFrame, docs: DataFrame, gone: DataFrame) -> None:
        columns = ["file_path", "folder_path", "file_type", "size_bytes", "modified_at", "content_hash"]
        failed = parsed.where("error is not null").select(*columns[:4], F.col("modified_at").cast("string").alias("modified_at"), "content_hash", F.col("error").alias("error_message"))
        done = docs.select(*columns[:4], "modified_at", F.col("raw_hash").alias("content_hash"), F.lit(None).cast("string").alias("error_message"))
        state = self.tables["state"].read()
        tried = failed.withColumn("retry_count", F.lit(0)) if state is None else failed.join(state.where("not is_deleted").select("file_path", "retry_count"), "file_path", "left").fillna(0, ["retry_count"])
        rows = done.withColumns({"retry_count": F.lit(0), "process_status": F.lit("done")}).unionByName(sync.after_failure(tried))
        rows = rows.withColumns({"is_deleted": F.lit(False), "synced_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")})
        if state is not None:
            dead = state.join(gone.select("file_path"), "file_path", "left_semi").withColumn("is_deleted", F.lit(True))
            rows = rows.unionByName(dead.select(rows.columns))
        self.tables["state"].upsert(rows)

    def _documents(self, folder: str | None, subtree: bool, file_type: str | None, since: str | None) -> DataFrame:
        docs = self.read("documents")
        if folder is not None:
            docs = docs.where(F.array_contains("folder_ancestors", folder) if subtree else F.col("folder_path") == folder)
        if file_type is not None:
            docs = docs.where(F.col("file_type") == file_type)
        if since is not None:
            docs = docs.where(t.iso_time(F.substring("modified_at", 1, 19)) >= t.iso_time(F.lit(since)))
        return docs

    def _asked(self, queries: list[str]) -> DataFrame:
        """The queries with their vectors (of passages that might answer them, where there is a generator) and hints."""
        texts = list(queries)
        if self.plugins.hypothetical is not None:
            texts = [q if p is None else p for q, p in zip(queries, self.plugins.hypothetical(texts), strict=True)]
        rows = [(i, -1, q, q, [float(x) for x in v]) for i, (q, v) in enumerate(zip(queries, self.plugins.embedder()(texts), strict=True))]
        return analysis.analyzed(self.spark.createDataFrame(rows, "query_id bigint, own_doc bigint, query string, keywords string, vector array<double>"), "query")

    def _hits(self, asked: DataFrame, docs: DataFrame, now: str, config: r.SearchConfig) -> DataFrame:
        """The candidates of every query in order, filtered before the lanes are made."""
        points = self.read("points").join(docs.select("doc_id"), "doc_id", "left_semi").where(F.exists("vector", lambda x: x != 0))
        said = F.concat_ws("\n", "text", F.array_join("questions", "\n")) if "questions" in points.columns else F.col("text")
        lists = r.lanes(asked, points.withColumn("vector", F.col("vector").cast("array<double>")), points.withColumn("text", said), config)
        hits = r.fused(lists).withColumn("query_id", F.col("query_id").cast("bigint")).join(points.drop("vector"), "point_id")
        hits = hits.join(docs.select("doc_id", "title", "file_path", t.iso_time(F.substring("modified_at", 1, 19)).alias("modified")), "doc_id").join(asked.select("query_id", "query", "classification"), "query_id")
        hits = hits.join(self.read("chunks").select(F.col("chunk_id").alias("point_id"), "section_heading", "page_start", "page_end"), "point_id", "left")
        return r.best(r.weighted(hits, F.lit(now).cast("timestamp")), config.candidates)

    def _candidates(self, queries: list[str], now: str, config: r.SearchConfig, folder: str | None, subtree: bool, file_type: str | None, since: str | None) -> DataFrame:
        """Hits of all queries; a query that names a folder of the index is answered from that folder and those below it."""
        asked = materialize(self._asked(queries), "asked")
        docs = self._documents(folder, subtree, file_type, since)
        hints: dict[str, list[int]] = {}
        if folder is None:
            for row in asked.where("folder_hint is not null").select("query_id", "folder_hint").collect():  # a few queries
                hints.setdefault(row.folder_hint.rstrip("/"), []).append(row.query_id)
        found, rest = [], asked
        for hint, ids in hints.items():
            ends = F.lit(hint)
            inside = docs.where(F.endswith("folder_path", ends) | F.exists("folder_ancestors", lambda x: F.endswith(x, ends)))  # noqa: B023  used at once
            if hint and not inside.isEmpty():
                found.append(self._hits(asked.where(F.col("query_id").isin(ids)), inside, now, config))
                rest = rest.where(~F.col("query_id").isin(ids))
        if not rest.isEmpty():
            found.append(self._hits(rest, docs, now, config))
        return functools.reduce(DataFrame.unionByName, found)

    def search(self, queries: list[str], now: str, results: int = 0, folder: str | None = None, subtree: bool = False, file_type: str | None = None, since: str | None = None) -> DataFrame:
        """``(query, place, score, label, title, file_path, record_type, evidence)`` for each of a few query texts.

        ``now`` is the time that recency counts from. ``folder`` means that folder alone, with ``subtree`` also those
        below it; without it, a folder that a query names. ``since`` is a time or a date, which means its midnight.
        ``results`` of 0 means the configured number.
        """
        config = r.SearchConfig(candidates=self.config.reranking.candidates, results=results or self.config.reranking.results)
        top = self._candidates(queries, now, config, folder, subtree, file_type, since)
        if self.plugins.scorer is not None:
            top = materialize(top, "top")
            shown = r.rerank_text(F.col("record_type"), F.col("text"), F.col("title"), F.col("section_heading"))
            scored = r.scored(top.withColumn("text", shown), self.plugins.scorer)
            top = r.reranked(top.join(scored.select("query_id", "point_id", "logit"), ["query_id", "point_id"]), F.col("logit"), config.results)
        else:
            top = top.where(F.col("place") <= config.results)
        found = r.cited(r.with_context(top, self.read("chunks")))
        return found.select("query", "place", "score", "label", "title", "file_path", "record_type", "evidence").orderBy("query", "place")

    def quick_search(self, queries: list[str], now: str, folder: str | None = None, subtree: bool = False) -> DataFrame:
        """``(query, place, hits, title, file_path)``: documents in the order of their first hits, without reranking."""
        top = materialize(self._candidates(queries, now, r.SearchConfig(candidates=self.config.reranking.candidates), folder, subtree, None, None), "top")
        names = top.select("query_id", "query").distinct()
        docs = self.read("documents").select("doc_id", "title", "file_path")
        return r.by_document(top).join(names, "query_id").join(docs, "doc_id").select("query", "place", "hits", "title", "file_path").orderBy("query", "place")

    def recent(self, n: int = 20, folder: str | None = None) -> DataFrame:
        """``(file_path, title, indexed_at)`` of the ``n`` documents indexed last."""
        return self._documents(folder, True, None, None).select("file_path", "title", "indexed_at").orderBy(F.desc("indexed_at"), "file_path").limit(n)

    def context(self, chunk_id: str, window: int = 2) -> DataFrame:
        """``(chunk_id, chunk_order, section_heading, chunk_text)`` of a chunk and its neighbours within ``window``."""
        chunks = self.read("chunks")
        at = F.broadcast(chunks.where(F.col("chunk_id") == chunk_id).select("doc_id", F.col("chunk_order").alias("o")))  # one row
        near = chunks.join(at, "doc_id").where(F.abs(F.col("chunk_order") - F.col("o")) <= window)
        return near.select("chunk_id", "chunk_order", "section_heading", "chunk_text").orderBy("chunk_order")

    def watch(self, checkpoint: str, until_now: bool = False):
        """Index once for what changed since the last run, then after each batch of new or rewritten files.

        Gives the running query; with ``until_now`` it takes in what is there and stops. Deletions are found by the
        comparison with the folders that each batch makes.
        """
        self.index()
        changed = functools.reduce(DataFrame.unionByName, [watch.file_stream(self.spark, f) for f in self.config.folders.paths])

        def take(batch: DataFrame, _: int) -> None:
            if not batch.isEmpty():
                self.index()

        if until_now:
            return watch.run_once(changed, checkpoint, take, mode="append")
        return watch.run(changed, checkpoint, take, self.config.watching.batch, mode="append")

    def status(self) -> DataFrame:
        return status.folder_status(self.read("state"))

    def health(self) -> list[tuple[str, bool, float]]:
        """``(what, whether it works, seconds)`` of reading each table."""
        out = []
        for name, table in self.tables.items():
            began = time.time()
            df = table.read()
            out.append((name, df is not None and df.limit(1).count() >= 0, time.time() - began))
        return out

    def clear(self) -> None:
        for table in self.tables.values():
            table.clear()
