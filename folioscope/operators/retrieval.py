"""Hybrid retrieval for many queries at once: dense lanes and a keyword lane, fused, weighted, boosted, reranked, cited."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scores as sc
from folioscope.functions import text as t
from folioscope.operators.vectors import top_k
from folioscope.plans.materialize import broadcast_if_small, materialize

WORDS = "[\\p{L}\\p{N}]+"


@dataclass(frozen=True)
class SearchConfig:
    """Candidates of each lane, candidates that are reranked, results; 0 results mean the default."""

    summaries: int = 20
    chunks: int = 30
    keywords: int = 30
    candidates: int = 30
    results: int = 10


def word_tokens(c: Column, least: int = 3, most: int = 20) -> Column:
    """The distinct lower-case words of ``least`` to ``most`` characters."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w).between(least, most)))


def keyword_lane(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``(query_id, lane, point_id, score, place)``: texts that have all words of the query, by id.

    ``queries(query_id, own_doc, keywords)``, ``texts(point_id, doc_id, text)``. Queries meet texts at the query's
    rarest word only, counted over all texts; the other words are then looked up in the text's own list. Queries
    without a word match nothing.
    """
    asked = queries.select("query_id", "own_doc", word_tokens(F.col("keywords")).alias("wanted")).where(F.size("wanted") > 0)
    asked = materialize(asked, "asked")
    words = materialize(asked.select(F.explode("wanted").alias("word")).distinct(), "words")
    # only words that some query has, and only ids: whole word lists are fetched for what meets
    posted = texts.select("point_id", "doc_id", F.explode(word_tokens(F.col("text"))).alias("word")).join(broadcast_if_small(words), "word", "left_semi")
    posted = materialize(posted, "posted")
    often = posted.groupBy("word").agg(F.count("*").alias("n"))
    pairs = asked.select("query_id", "own_doc", "wanted", F.explode("wanted").alias("word")).join(often, "word", "left")
    rarest = pairs.groupBy("query_id", "own_doc", "wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("word"))
    met = rarest.join(posted, "word").where(~F.equal_null("doc_id", "own_doc"))
    single = met.where(F.size("wanted") == 1).select("query_id", "point_id")
    more = met.where(F.size("wanted") > 1).select("query_id", "point_id", F.explode("wanted").alias("word"), F.size("wanted").alias("all"))
    whole = more.join(posted.select("point_id", "word"), ["point_id", "word"]).groupBy("query_id", "point_id", "all").agg(F.count("*").alias("n")).where("n = all").select("query_id", "point_id")
    rank = Window.partitionBy("query_id").orderBy("point_id")
    found = single.unionByName(whole).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
    return found.select(F.col("query_id").cast("string").alias("query_id"), F.lit("keyword").alias("lane"), "point_id", F.lit(None).cast("double").alias("score"), "place")


def lanes(queries: DataFrame, points: DataFrame, texts: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """All four ranked lists, one below the other."""
    dense = points.withColumn("lane", F.col("record_type"))
    short = top_k(queries, dense.where("record_type <> 'chunk'"), config.summaries)
    long = top_k(queries, dense.where("record_type = 'chunk'"), config.chunks)
    return short.unionByName(long).unionByName(keyword_lane(queries, texts, config.keywords))


def fused(lists: DataFrame) -> DataFrame:
    """``(query_id, point_id, score)``: reciprocal ranks summed over the lists a point is in."""
    return lists.groupBy("query_id", "point_id").agg(F.sum(sc.rrf_share(F.col("place"))).alias("score"))


def weighted(hits: DataFrame, now: Column) -> DataFrame:
    """``hits(score, classification, record_type, modified)`` with the layer's weight and the recency factor put on."""
    return hits.withColumn("score", F.col("score") * sc.layer_weight(F.col("classification"), F.col("record_type")) * sc.recency_factor(F.col("modified"), now))


def best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query with their ``place``; ties by point id."""
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return hits.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)


def rerank_text(record_type: Column, text: Column, title: Column, heading: Column, topics: Column | None = None) -> Column:
    """What a reranker reads: summaries below their title and topics or heading, chunks as they are."""
    listed = F.array_join(topics, ", ") if topics is not None else F.lit(None).cast("string")
    extra = F.when(record_type == "document_summary", F.nullif(listed, F.lit(""))).otherwise(F.nullif(heading, F.lit("")))
    head = F.concat_ws(" | ", F.nullif(title, F.lit("")), extra)
    return F.when((record_type != "chunk") & (head != ""), F.concat(head, F.lit("\n"), text)).otherwise(text)


def overlap_logit(query: Column, text: Column) -> Column:
    """A scorer without a model: how many of the query's words the text has, between -4 and 4; -4 without words."""
    wanted = word_tokens(query)
    share = F.size(F.array_intersect(wanted, word_tokens(text))) / F.greatest(F.size(wanted), F.lit(1))
    return share * 8.0 - 4.0


def reranked(hits: DataFrame, logit: Column, k: int) -> DataFrame:
    """The ``k`` best hits by the sigmoid of ``logit``; a query's only hit keeps its score."""
    alone = F.count("*").over(Window.partitionBy("query_id")) == 1
    return best(hits.withColumn("score", F.when(alone, F.col("score")).otherwise(sc.sigmoid(logit))), k)


def scored(pairs: DataFrame, model: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> DataFrame:
    """``pairs(query, text)`` with ``logit`` from a cross-encoder; ``model()`` is called once a task."""

    @F.pandas_udf("double")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = model()
        for q, x in batches:
            yield pd.Series(score(q.tolist(), x.tolist()), dtype=float)

    return pairs.withColumn("logit", logits("query", "text"))


def with_context(hits: DataFrame, chunks: DataFrame, window: int = 1, first: int = 3) -> DataFrame:
    """``hits(query_id, point_id, doc_id, record_type, chunk_order, section_id, text)`` with ``evidence``.

    A chunk hit shows its neighbours within ``window`` merged without their overlaps; a document summary its first
    ``first`` chunks below it, a section summary all chunks of its section. Without any chunk the text stands alone.
    """
    key = ["query_id", "point_id"]
    c = chunks.select("doc_id", F.col("chunk_order").alias("o"), "chunk_text", F.col("section_id").alias("s"))
    near = hits.where("chunk_order is not null").select(*key, "doc_id", F.explode(F.sequence(F.col("chunk_order") - window, F.col("chunk_order") + window)).alias("o")).join(c, ["doc_id", "o"])
    rank = Window.partitionBy("doc_id").orderBy("o")
    top = hits.where("chunk_order is null and record_type = 'document_summary'").select(*key, "doc_id")
    start = c.join(top.select("doc_id").distinct(), "doc_id", "left_semi")  # only documents that were hit are ranked
    top = top.join(start.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= first), "doc_id")
    part = hits.where("chunk_order is null and record_type = 'section_summary'").select(*key, F.col("section_id").alias("s")).join(c, "s")
    rows = near.select(*key, "o", "chunk_text").unionByName(top.select(*key, "o", "chunk_text")).unionByName(part.select(*key, "o", "chunk_text"))
    texts = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o", "chunk_text"))).alias("x")).select(*key, t.merge_overlapping(F.transform("x", lambda s: s["chunk_text"])).alias("around"))
    kind = F.when(F.col("record_type") == "document_summary", "[Summary] ").otherwise("[Section Summary] ")
    shown = F.when(F.col("around").isNull(), F.col("text")).when(F.col("chunk_order").isNotNull(), F.col("around")).otherwise(F.concat(kind, F.col("text"), F.lit("\n\n"), F.col("around")))
    return hits.join(texts, key, "left").withColumn("evidence", shown).drop("around")


def cited(hits: DataFrame) -> DataFrame:
    """``hits(file_path, title, section_heading, page_start, page_end)`` with ``label`` and ``pages``."""
    name = t.file_name(F.coalesce("file_path", F.lit("")))
    label = t.citation_label(F.when(name != "", name).otherwise("Unknown"), F.col("section_heading"), F.col("page_start"), F.col("page_end"))
    return hits.withColumns({"label": label, "pages": t.pages(F.col("page_start"), F.col("page_end")), "title": F.coalesce("title", name)})


def by_document(hits: DataFrame) -> DataFrame:
    """``(query_id, doc_id, place, hits)``: documents in the order in which their first hits come."""
    docs = hits.groupBy("query_id", "doc_id").agg(F.min("place").alias("first"), F.count("*").alias("hits"))
    rank = Window.partitionBy("query_id").orderBy("first")
    return docs.select("query_id", "doc_id", F.row_number().over(rank).alias("place"), "hits")
