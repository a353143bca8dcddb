"""Queries of the retrieval side. Queries are taken from the tables: every document whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scores as sc
from folioscope.functions import text as t
from folioscope.operators import analysis, retrieval as r, vectors
from folioscope.plans.materialize import materialize
from folioscope.plans.registry import CHUNKS, ISO, NOW, POINTS, SECTIONS, SYNC, Registry
from folioscope.sources import tables as src

query = Registry()

_WORDS = r"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) BETWEEN 3 AND 20))"
_ASKED = f"asked AS (SELECT p.doc_id, arg_min(p.vector, p.point_id)::DOUBLE[] AS v, any_value(d.title) AS title, regexp_extract(any_value(d.title), '\\S+$') AS keywords FROM points p JOIN documents d USING (doc_id) WHERE p.doc_id % 20 = 0 GROUP BY p.doc_id)"
_DENSE = """dense AS (SELECT * FROM (SELECT a.doc_id AS query_id, p.record_type AS lane, p.point_id, round(list_cosine_similarity(a.v, p.vector::DOUBLE[]), 6) AS score FROM asked a, points p WHERE p.doc_id <> a.doc_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, point_id) <= CASE lane WHEN 'chunk' THEN 30 ELSE 20 END)"""
_KEYWORD = f"""words AS (SELECT chunk_id AS point_id, doc_id, {_WORDS.format(c='chunk_text')} AS w FROM {CHUNKS}),
wanted AS (SELECT doc_id, {_WORDS.format(c='keywords')} AS w FROM asked),
keyed AS (SELECT q.doc_id AS query_id, 'keyword' AS lane, c.point_id FROM wanted q JOIN words c ON len(q.w) > 0 AND list_has_all(c.w, q.w) AND c.doc_id <> q.doc_id QUALIFY row_number() OVER (PARTITION BY q.doc_id ORDER BY c.point_id) <= 30)"""
_BASE = f"WITH points AS MATERIALIZED {POINTS}, {_ASKED}, "


def _asked(spark: SparkSession, sf: str, points: DataFrame) -> DataFrame:
    """Queries by example: a document's first vector, its title, and the code at the title's end as keywords."""
    own = points.where("doc_id % 20 = 0").groupBy("doc_id").agg(F.min_by("vector", "point_id").alias("vector"))
    docs = src.documents(spark, sf).select("doc_id", "title")
    return materialize(own.join(docs, "doc_id").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("own_doc"), "vector", "title", F.regexp_extract("title", "\\S+$", 0).alias("keywords")), "queries")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(src.points(spark, sf).select("point_id", "record_type", "doc_id", "chunk_order", "vector"), "points")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return src.chunks(spark, sf).select(F.col("chunk_id").alias("point_id"), "doc_id", F.col("chunk_text").alias("text"))


@query("r1_analyzed_queries", r"""
WITH q AS (SELECT title AS q FROM documents UNION SELECT heading FROM parsed_sections UNION SELECT details FROM processing_log UNION SELECT 'what is ' || title FROM documents UNION SELECT 'find ' || folder_path || ' since ' || modified_at FROM documents),
w AS (SELECT q, coalesce(q, '') AS s, list_filter(regexp_split_to_array(lower(coalesce(q, '')), '\s+'), lambda x: x <> '') AS w FROM q),
n AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: x IN ('overview', 'summary', 'summarize', 'general', 'explain', 'describe', 'introduction'))) AS b FROM w),
x AS (SELECT *, b * 2.0 + CASE WHEN starts_with(lower(s), 'what is') AND n <= 5 THEN 2 ELSE 0 END + CASE WHEN n <= 3 THEN 1 ELSE 0 END AS broad,
  len(regexp_extract_all(s, '[a-z]+_[a-z]|[a-z][A-Z]|[a-zA-Z]+\.[a-zA-Z]+')) * 2.0 + len(regexp_extract_all(s, '\d+\.\d+')) * 1.5 + CASE WHEN n >= 6 AND b = 0 THEN 1.5 ELSE 0 END AS specific,
  len(list_filter(w, lambda x: x IN ('where', 'find', 'locate', 'location', 'path'))) * 2.0 + len(regexp_extract_all(s, '[/\\][\w.-]+')) * 2.0
    + CASE WHEN n BETWEEN 2 AND 4 AND b = 0 AND len(list_filter(w, lambda x: x IN ('what', 'how', 'why', 'when', 'which'))) = 0 THEN 1 ELSE 0 END AS nav FROM n)
SELECT q, CASE WHEN specific >= nav AND specific >= broad THEN 'specific' WHEN nav >= broad THEN 'navigational' ELSE 'broad' END AS classification,
  coalesce(nullif(regexp_extract(s, '(?i)(?:in\s+folder|from\s+folder|folder)\s+["'']?([/\w.-]+)["'']?', 1), ''), nullif(regexp_extract(s, '(?i)(?:in|from)\s+["'']?([/\w.-]*[/][/\w.-]*)["'']?', 1), '')) AS folder_hint,
  nullif(regexp_extract(s, '(?:since|after|before|from)\s+(\d{4}[-/]\d{2}(?:[-/]\d{2})?)', 1), '') AS date_hint FROM x""")
def analyzed_queries(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf)
    q = docs.select(F.col("title").alias("q")).union(src.read(spark, sf, "parsed_sections").select("heading")).union(src.read(spark, sf, "processing_log").select("details"))
    q = q.union(docs.select(F.concat(F.lit("what is "), "title"))).union(docs.select(F.concat(F.lit("find "), "folder_path", F.lit(" since "), "modified_at"))).distinct()
    return analysis.analyzed(q, "q")


@query("r8_dense_lanes", f"{_BASE} {_DENSE} SELECT query_id, lane, point_id, score FROM dense")
def dense_lanes(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    asked, dense = _asked(spark, sf, points), points.withColumn("lane", F.col("record_type"))
    found = vectors.top_k(asked, dense.where("record_type <> 'chunk'"), 20).unionByName(vectors.top_k(asked, dense.where("record_type = 'chunk'"), 30))
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), "lane", "point_id", "score")


@query("r9_keyword_lane", f"{_BASE} {_KEYWORD} SELECT query_id, point_id FROM keyed")
def keyword_lane(spark: SparkSession, sf: str) -> DataFrame:
    found = r.keyword_lane(_asked(spark, sf, _points(spark, sf)), _texts(spark, sf), 30)
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), "point_id")


_HITS = f"""{_BASE} {_DENSE}, {_KEYWORD},
placed AS (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, point_id) AS place FROM dense UNION ALL SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY point_id) FROM keyed),
fused AS (SELECT query_id, point_id, sum(1.0 / (60 + place)) AS score FROM placed GROUP BY ALL),
known AS (SELECT point_id, doc_id, record_type FROM points UNION SELECT chunk_id, doc_id, 'chunk' FROM {CHUNKS}),
kind AS (SELECT doc_id AS query_id, CASE WHEN len(regexp_split_to_array(coalesce(title, ''), '\\s+')) BETWEEN 2 AND 4 AND title IS NOT NULL THEN 'x' ELSE 'y' END AS k, title FROM asked),"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Fused candidates with everything that later steps read."""
    points = _points(spark, sf)
    asked = _asked(spark, sf, points)
    hits = r.fused(r.lanes(asked, points, _texts(spark, sf))).withColumn("query_id", F.col("query_id").cast("bigint"))
    chunks = src.chunks(spark, sf).select(F.col("chunk_id").alias("point_id"), "doc_id", "section_id", "chunk_order", "chunk_text", "section_heading", "page_start", "page_end")
    summaries = points.where("record_type <> 'chunk'").select("point_id", "doc_id", "record_type")
    known = chunks.withColumn("record_type", F.lit("chunk")).unionByName(summaries, allowMissingColumns=True)
    docs = src.documents(spark, sf).select("doc_id", "title", "file_path", t.iso_time(F.col("modified_at")).alias("modified"))
    kinds = analysis.analyzed(asked.select("query_id", F.col("title").alias("query")), "query").select("query_id", "query", "classification")
    return hits.join(known, "point_id").join(docs, "doc_id").join(kinds, "query_id")


_CLASS = """class AS (SELECT query_id, CASE WHEN sp >= nav AND sp >= broad THEN 'specific' WHEN nav >= broad THEN 'navigational' ELSE 'broad' END AS classification FROM (
  SELECT query_id, CASE WHEN n <= 3 THEN 1.0 ELSE 0 END + b * 2.0 AS broad, len(regexp_extract_all(s, '[a-z]+_[a-z]|[a-z][A-Z]|[a-zA-Z]+\\.[a-zA-Z]+')) * 2.0 + len(regexp_extract_all(s, '\\d+\\.\\d+')) * 1.5 + CASE WHEN n >= 6 AND b = 0 THEN 1.5 ELSE 0 END AS sp,
    len(list_filter(w, lambda x: x IN ('where', 'find', 'locate', 'location', 'path'))) * 2.0 + CASE WHEN n BETWEEN 2 AND 4 AND b = 0 AND len(list_filter(w, lambda x: x IN ('what', 'how', 'why', 'when', 'which'))) = 0 THEN 1 ELSE 0 END AS nav
  FROM (SELECT *, len(w) AS n, len(list_filter(w, lambda x: x IN ('overview', 'summary', 'summarize', 'general', 'explain', 'describe', 'introduction'))) AS b FROM (SELECT query_id, coalesce(title, '') AS s, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '\\s+'), lambda x: x <> '') AS w FROM kind)))),"""
_SCORED = f"""{_HITS} {_CLASS}
scored AS (SELECT f.query_id, f.point_id, k.doc_id, k.record_type, c.classification, f.score
  * CASE c.classification WHEN 'broad' THEN CASE k.record_type WHEN 'document_summary' THEN 1.5 WHEN 'section_summary' THEN 1.3 ELSE 1 END WHEN 'navigational' THEN CASE k.record_type WHEN 'section_summary' THEN 1.4 ELSE 1 END ELSE CASE k.record_type WHEN 'document_summary' THEN 0.7 WHEN 'section_summary' THEN 0.9 ELSE 1 END END
  * CASE WHEN d.m IS NULL THEN 1 ELSE 1 + 0.15 * pow(2.0, -greatest((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(d.m)) / 86400e6, 0) / 90) END AS score
  FROM fused f JOIN known k USING (point_id) JOIN (SELECT doc_id, title, file_path, {ISO.format(c='modified_at')} AS m FROM documents) d USING (doc_id) JOIN class c USING (query_id)),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS INTEGER) AS place FROM scored QUALIFY place <= 30)"""


@query("r10_fused", f"{_HITS[:-1]} SELECT query_id, point_id, round(score, 10) AS score FROM fused")
def fused(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    found = r.fused(r.lanes(_asked(spark, sf, points), points, _texts(spark, sf)))
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), "point_id", F.round("score", 10).alias("score"))


def _top(spark: SparkSession, sf: str, k: int = 30) -> DataFrame:
    return r.best(r.weighted(_hits(spark, sf), F.lit(NOW).cast("timestamp")), k)


@query("hybrid_search", f"""{_SCORED}
SELECT query_id, place, point_id, t.doc_id, record_type, classification, round(score, 8) AS score,
  concat_ws(', ', regexp_extract(d.file_path, '[^/]*$'), CASE WHEN c.section_heading <> '' THEN '§ ' || c.section_heading END, CASE WHEN page_end IS NOT NULL AND page_end <> page_start THEN 'pp. ' || page_start || '-' || page_end ELSE 'p. ' || page_start END) AS label
FROM top t JOIN documents d ON d.doc_id = t.doc_id LEFT JOIN {CHUNKS} c ON c.chunk_id = t.point_id AND t.record_type = 'chunk' WHERE place <= 10""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    found = r.cited(_top(spark, sf, 10))
    return found.select("query_id", "place", "point_id", "doc_id", "record_type", "classification", F.round("score", 8).alias("score"), "label")


@query("r13_reranked", f"""{_SCORED},
texts AS (SELECT t.* EXCLUDE (place), coalesce(kd.title, '') AS q, CASE WHEN t.record_type = 'chunk' THEN c.chunk_text ELSE d.title END AS text, count(*) OVER (PARTITION BY query_id) AS alone FROM top t JOIN documents d ON d.doc_id = t.doc_id LEFT JOIN {CHUNKS} c ON c.chunk_id = t.point_id AND t.record_type = 'chunk' JOIN kind kd USING (query_id)),
s AS (SELECT *, CASE WHEN alone = 1 THEN score ELSE 1 / (1 + exp(-(len(list_intersect({_WORDS.format(c='q')}, coalesce({_WORDS.format(c="coalesce(text, '')")}, []))) * 8.0 / greatest(len({_WORDS.format(c='q')}), 1) - 4.0))) END AS s FROM texts)
SELECT query_id, point_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, point_id) AS INTEGER) AS place, round(s, 8) AS score FROM s QUALIFY place <= 10""")
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    text = r.rerank_text(F.lit("chunk"), F.when(F.col("record_type") == "chunk", F.col("chunk_text")).otherwise(F.col("title")), F.col("title"), F.col("section_heading"))
    found = r.reranked(_top(spark, sf), r.overlap_logit(F.coalesce("query", F.lit("")), F.coalesce(text, F.lit(""))), 10)
    return found.select("query_id", "point_id", "place", F.round("score", 8).alias("score"))


@query("r16_rerank_texts", f"SELECT p.point_id, p.record_type, sha256(CASE WHEN p.record_type = 'document_summary' AND d.title <> '' THEN d.title || chr(10) || left(d.text, 200) WHEN p.record_type = 'chunk' THEN c.chunk_text ELSE left(d.text, 200) END) AS text_hash FROM {POINTS} p JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN {CHUNKS} c ON c.chunk_id = p.chunk_id")
def rerank_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.points(spark, sf).select("point_id", "record_type", "doc_id", "chunk_id").join(src.documents(spark, sf).select("doc_id", "title", F.left("text", F.lit(200)).alias("start")), "doc_id")
    rows = rows.join(src.chunks(spark, sf).select("chunk_id", "chunk_text", "section_heading"), "chunk_id", "left")
    shown = r.rerank_text(F.col("record_type"), F.when(F.col("record_type") == "chunk", F.col("chunk_text")).otherwise(F.col("start")), F.col("title"), F.lit(None).cast("string"))
    return rows.select("point_id", "record_type", F.sha2(shown, 256).alias("text_hash"))


@query("r15_expanded_context")
def expanded_context(spark: SparkSession, sf: str) -> DataFrame:
    hits = _top(spark, sf, 10).withColumn("text", F.coalesce("chunk_text", "title"))
    return r.with_context(hits, src.chunks(spark, sf)).select("query_id", "place", "point_id", "evidence")


@query("r20_quick_search", f"""{_SCORED}, g AS (SELECT query_id, doc_id, min(place) AS first, count(*) AS hits FROM top GROUP BY ALL)
SELECT query_id, g.doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS place, hits, d.title FROM g JOIN documents d ON d.doc_id = g.doc_id""")
def quick_search(spark: SparkSession, sf: str) -> DataFrame:
    return r.by_document(_top(spark, sf)).join(src.documents(spark, sf).select("doc_id", "title"), "doc_id")


@query("j1_neighbour_chunks", f"SELECT a.chunk_id, b.chunk_id AS neighbour_id, b.chunk_order - a.chunk_order AS step FROM {CHUNKS} a JOIN {CHUNKS} b ON a.doc_id = b.doc_id AND b.chunk_order BETWEEN a.chunk_order - 1 AND a.chunk_order + 1 AND a.chunk_id <> b.chunk_id")
def neighbour_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = src.chunks(spark, sf).select("chunk_id", "doc_id", "chunk_order")
    asked = c.select("chunk_id", "doc_id", F.col("chunk_order").alias("own"), F.explode(F.sequence(F.col("chunk_order") - 1, F.col("chunk_order") + 1)).alias("chunk_order"))
    found = asked.join(c.withColumnRenamed("chunk_id", "neighbour_id"), ["doc_id", "chunk_order"]).where("chunk_id <> neighbour_id")
    return found.select("chunk_id", "neighbour_id", (F.col("chunk_order") - F.col("own")).alias("step"))


@query("j2_first_chunks", f"SELECT doc_id, chunk_id, n FROM (SELECT doc_id, chunk_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_order, chunk_id) AS INTEGER) AS n FROM {CHUNKS}) WHERE n <= 3")
def first_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chunk_order", "chunk_id")
    return src.chunks(spark, sf).select("doc_id", "chunk_id", F.row_number().over(w).alias("n")).where("n <= 3")


@query("j3_section_chunks", f"SELECT s.section_id, s.heading, count(c.chunk_id) AS chunks, string_agg(c.chunk_id, ',' ORDER BY c.chunk_order, c.chunk_id) AS ids FROM {SECTIONS} s LEFT JOIN {CHUNKS} c USING (section_id) GROUP BY ALL")
def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = src.chunks(spark, sf).groupBy("section_id").agg(F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("chunk_order", "chunk_id"))).alias("x"))
    rows = src.sections(spark, sf).select("section_id", "heading").join(c, "section_id", "left")
    return rows.select("section_id", "heading", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.array_join(F.transform("x", lambda s: s["chunk_id"]), ",").alias("ids"))


@query("f8_neighbour_similarity", f"WITH p AS {POINTS} SELECT a.point_id, b.point_id AS next_id, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 6) AS cosine FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.record_type = 'chunk' AND b.record_type = 'chunk' AND b.chunk_order = a.chunk_order + 1")
def neighbour_similarity(spark: SparkSession, sf: str) -> DataFrame:
    p = src.points(spark, sf).where("record_type = 'chunk'").select("point_id", "doc_id", "chunk_order", sc.unit(F.col("vector")).alias("v"))
    nxt = p.select(F.col("point_id").alias("next_id"), "doc_id", (F.col("chunk_order") - 1).alias("chunk_order"), F.col("v").alias("w"))
    return p.join(nxt, ["doc_id", "chunk_order"]).select("point_id", "next_id", F.round(sc.dot(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("f11_recency_factors", f"SELECT doc_id, round(CASE WHEN m IS NULL THEN 1 ELSE 1 + 0.15 * pow(2.0, -greatest((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us(m)) / 86400e6, 0) / 90) END, 8) AS factor FROM (SELECT doc_id, {ISO.format(c='modified_at')} AS m FROM documents)")
def recency_factors(spark: SparkSession, sf: str) -> DataFrame:
    factor = sc.recency_factor(t.iso_time(F.col("modified_at")), F.lit(NOW).cast("timestamp"))
    return src.documents(spark, sf).select("doc_id", F.round(factor, 8).alias("factor"))


@query("f12_layer_weights", "SELECT DISTINCT point_id, record_type, CASE record_type WHEN 'document_summary' THEN 0.7 WHEN 'section_summary' THEN 0.9 ELSE 1.0 END::DOUBLE AS weight FROM vector_points")
def layer_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.read(spark, sf, "vector_points").select("point_id", "record_type").distinct()
    return rows.withColumn("weight", sc.layer_weight(F.lit("other"), F.col("record_type")))


@query("r21_document_context", f"SELECT d.doc_id, d.title, s.section_order, s.heading, left(s.text, 200) AS excerpt FROM documents d JOIN {SECTIONS} s USING (doc_id)")
def document_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.sections(spark, sf).select("doc_id", "section_order", "heading", F.left("text", F.lit(200)).alias("excerpt"))
    return src.documents(spark, sf).select("doc_id", "title").join(rows, "doc_id")


@query("w4_context_frames", f"SELECT chunk_id, count(*) OVER w AS frame_chunks, CAST(sum(coalesce(token_count, 0)) OVER w AS BIGINT) AS frame_tokens FROM {CHUNKS} WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_order RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def context_frames(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chunk_order").rangeBetween(-1, 1)
    return src.chunks(spark, sf).select("chunk_id", F.count("*").over(w).alias("frame_chunks"), F.sum(F.coalesce("token_count", F.lit(0))).over(w).alias("frame_tokens"))


@query("r23_sync_status", f"SELECT folder_path, count(*) AS files, count(*) FILTER (process_status = 'done') AS indexed, count(*) FILTER (process_status = 'error') AS errors, max(synced_at) AS last_synced FROM {SYNC} WHERE NOT is_deleted GROUP BY folder_path")
def sync_status(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("process_status")
    return src.sync_state(spark, sf).where("not is_deleted").groupBy("folder_path").agg(F.count("*").alias("files"), F.count_if(s == "done").alias("indexed"), F.count_if(s == "error").alias("errors"), F.max("synced_at").alias("last_synced"))
