"""Queries for lookups, projections and texts as they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import retrieval as r, store, summaries, sync
from folioscope.plans import searching as s
from folioscope.plans.registry import CHUNKS, LOG, SECTIONS, SYNC, Registry
from folioscope.sources import tables as src

query = Registry()
LEVELS = (8, 16, 32, 64, 128)


@query("prj5_states_by_path", f"SELECT d.doc_id, s.process_status, s.retry_count, s.is_deleted FROM documents d LEFT JOIN {SYNC} s USING (file_path) WHERE d.doc_id % 20 = 0")
def states_by_path(spark: SparkSession, sf: str) -> DataFrame:
    asked = src.documents(spark, sf).where("doc_id % 20 = 0").select("doc_id", "file_path")
    return asked.join(src.sync_state(spark, sf), "file_path", "left").select("doc_id", "process_status", "retry_count", "is_deleted")


@query("prj6_detail_levels", "SELECT doc_id, " + ", ".join(f"array_to_string(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')[1:{n}], ' ') AS summary_{n}w" for n in LEVELS) + " FROM documents")
def detail_levels(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.extractive(src.documents(spark, sf), "text", LEVELS).select("doc_id", *(f"summary_{n}w" for n in LEVELS))


@query("prj7_hits_with_defaults", f"SELECT DISTINCT p.point_id, coalesce(p.record_type, 'chunk') AS record_type, coalesce(p.doc_id, -1) AS doc_id, coalesce(length(c.chunk_text), 0) AS chars FROM (SELECT DISTINCT point_id, record_type, doc_id, chunk_id FROM vector_points) p LEFT JOIN {CHUNKS} c USING (chunk_id)")
def hits_with_defaults(spark: SparkSession, sf: str) -> DataFrame:
    points = src.read(spark, sf, "vector_points").select("point_id", "record_type", "doc_id", "chunk_id").distinct()
    rows = points.join(src.chunks(spark, sf).select("chunk_id", F.length("chunk_text").cast("bigint").alias("n")), "chunk_id", "left")
    return rows.select("point_id", F.coalesce("record_type", F.lit("chunk")).alias("record_type"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("n", F.lit(0)).alias("chars")).distinct()


@query("a8_failed_counts", f"SELECT count(*) FILTER (process_status = 'error') AS errors, count(*) FILTER (process_status = 'poison') AS poisoned FROM {SYNC} WHERE NOT is_deleted")
def failed_counts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("process_status")
    return src.sync_state(spark, sf).where("not is_deleted").agg(F.count_if(status == "error").alias("errors"), F.count_if(status == "poison").alias("poisoned"))


@query("f2_text_hashes", f"SELECT section_id, sha256(text) AS text_hash FROM {SECTIONS}")
def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return src.sections(spark, sf).select("section_id", F.sha2("text", 256).alias("text_hash"))


@query("f14_lower_case_texts", f"SELECT chunk_id, lower(chunk_text) = chunk_text_normalized AS as_recorded FROM {CHUNKS}")
def lower_case(spark: SparkSession, sf: str) -> DataFrame:
    return src.chunks(spark, sf).select("chunk_id", (F.lower("chunk_text") == F.col("chunk_text_normalized")).alias("as_recorded"))


@query("f21_section_prompts", f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_order, section_id) AS i FROM {SECTIONS})
SELECT doc_id, sha256(string_agg('--- Section ' || i || ': ' || coalesce(nullif(heading, ''), 'Untitled section') || ' ---' || chr(10) || left(text, 5000), chr(10) || chr(10) ORDER BY section_order, section_id)) AS prompt_hash FROM s GROUP BY doc_id""")
def section_prompts(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_order", "section_id"))
    rows = src.sections(spark, sf).withColumn("i", i)
    label = F.concat(F.lit("Section "), F.col("i").cast("string"), F.lit(": "), F.coalesce(F.nullif("heading", F.lit("")), F.lit("Untitled section")))
    return summaries.prompt(rows, "doc_id", ["section_order", "section_id"], label, "text").select("doc_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query("f24_progress_bars", f"SELECT folder_path, rpad(repeat('█', CAST(floor(20.0 * done / n) AS INTEGER)), 20, '░') AS bar FROM (SELECT folder_path, count(*) AS n, count(*) FILTER (process_status = 'done') AS done FROM {SYNC} WHERE NOT is_deleted GROUP BY 1)")
def progress_bars(spark: SparkSession, sf: str) -> DataFrame:
    sums = src.sync_state(spark, sf).where("not is_deleted").groupBy("folder_path").agg(F.count("*").alias("n"), F.count_if(F.col("process_status") == "done").alias("done"))
    return sums.select("folder_path", F.rpad(F.repeat(F.lit("█"), F.floor(F.col("done") * 20.0 / F.col("n")).cast("int")), 20, "░").alias("bar"))


@query("i19_files_let_through", f"""
SELECT d.file_path FROM documents d LEFT JOIN {SYNC} s USING (file_path)
WHERE s.file_path IS NULL OR (s.process_status <> 'poison' AND NOT coalesce(s.process_status = 'error' AND epoch(TIMESTAMPTZ '2020-01-10 00:00:00+00') < epoch(CAST(s.synced_at AS TIMESTAMPTZ)) + 30 * pow(2, s.retry_count), false))""")
def files_let_through(spark: SparkSession, sf: str) -> DataFrame:
    state = src.sync_state(spark, sf)
    may = sync.may_retry(state, F.lit("2020-01-10 00:00:00").cast("timestamp"), t.iso_time(F.col("synced_at"))).select("file_path")
    held = state.select("file_path").join(may, "file_path", "left_anti")
    return src.documents(spark, sf).select("file_path").join(held, "file_path", "left_anti")


@query("i23_batch_outcomes", f"""
WITH l AS (SELECT doc_id, max_by(lower(status), (created_at, log_id)) FILTER (stage = 'index') AS indexed, count(*) FILTER (lower(status) = 'error') AS errors FROM {LOG} WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT d.ingest_batch, coalesce(l.indexed, 'none') AS outcome, count(*) AS n, CAST(sum(coalesce(l.errors, 0)) AS BIGINT) AS errors FROM documents d LEFT JOIN l USING (doc_id) GROUP BY ALL""")
def batch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    log = src.processing_log(spark, sf).where("doc_id is not null")
    last = F.max(F.when(F.col("stage") == "index", F.struct("created_at", "log_id", F.lower("status").alias("status"))))["status"]
    sums = log.groupBy("doc_id").agg(last.alias("indexed"), F.count_if(F.lower("status") == "error").alias("errors"))
    rows = src.documents(spark, sf).select("doc_id", "ingest_batch").join(sums, "doc_id", "left")
    return rows.groupBy("ingest_batch", F.coalesce("indexed", F.lit("none")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.coalesce("errors", F.lit(0))).alias("errors"))


@query("k10_replaced_points", """
WITH p AS (SELECT DISTINCT point_id, doc_id, embedding_model_version AS version FROM vector_points), n AS (SELECT point_id, doc_id, 'topic-v3' AS version FROM p WHERE doc_id % 7 = 0 AND version = 'topic-v2')
SELECT * FROM n UNION ALL SELECT * FROM p WHERE doc_id NOT IN (SELECT doc_id FROM n)""")
def replaced_points(spark: SparkSession, sf: str) -> DataFrame:
    points = src.read(spark, sf, "vector_points").select("point_id", "doc_id", F.col("embedding_model_version").alias("version")).distinct()
    new = points.where("doc_id % 7 = 0 and version = 'topic-v2'").withColumn("version", F.lit("topic-v3"))
    return store.replace_points(points, new)


@query("k4_upsert_documents", """
WITH p AS (SELECT doc_id, title, parser_version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY parsed_at DESC NULLS LAST) AS n FROM parsed_documents) WHERE n = 1 AND title IS NOT NULL)
SELECT doc_id, title, parser_version FROM p UNION ALL SELECT doc_id, title, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)""")
def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    new = src.parsed_documents(spark, sf).where("title is not null").select("doc_id", "title", "parser_version")
    old = src.documents(spark, sf).select("doc_id", "title", F.lit(None).cast("string").alias("parser_version"))
    return store.upsert(old, new, ["doc_id"])


@query("r17_lane_counts", f"{s._BASE} {s._DENSE}, {s._KEYWORD} SELECT query_id, lane, count(*) AS n FROM (SELECT query_id, lane FROM dense UNION ALL SELECT query_id, lane FROM keyed) GROUP BY ALL")
def lane_counts(spark: SparkSession, sf: str) -> DataFrame:
    points = s._points(spark, sf)
    lists = r.lanes(s._asked(spark, sf, points), points, s._texts(spark, sf))
    return lists.groupBy(F.col("query_id").cast("bigint").alias("query_id"), "lane").agg(F.count("*").alias("n"))


@query("r19_result_lists", f"""{s._SCORED}, g AS (SELECT query_id, doc_id, min(place) AS first, count(*) AS hits FROM top GROUP BY ALL),
p AS (SELECT g.*, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM g)
SELECT query_id, string_agg(p.place || '. ' || coalesce(d.title, 'Untitled') || ' (' || p.hits || ')', chr(10) ORDER BY p.place) AS listing FROM p JOIN documents d ON d.doc_id = p.doc_id GROUP BY query_id""")
def result_lists(spark: SparkSession, sf: str) -> DataFrame:
    docs = r.by_document(s._top(spark, sf)).join(src.documents(spark, sf).select("doc_id", "title"), "doc_id")
    line = F.concat(F.col("place").cast("string"), F.lit(". "), F.coalesce("title", F.lit("Untitled")), F.lit(" ("), F.col("hits").cast("string"), F.lit(")"))
    lines = docs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("x"))
    return lines.select("query_id", F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("listing"))


@query("j10_snapshot_and_state", f"SELECT coalesce(d.file_path, s.file_path) AS file_path, d.doc_id, s.process_status, d.file_path IS NOT NULL AS seen, s.file_path IS NOT NULL AS tracked FROM documents d FULL JOIN {SYNC} s USING (file_path)")
def snapshot_and_state(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf).select("file_path", "doc_id", F.lit(True).alias("seen"))
    state = src.sync_state(spark, sf).select("file_path", "process_status", F.lit(True).alias("tracked"))
    return docs.join(state, "file_path", "full_outer").select("file_path", "doc_id", "process_status", F.coalesce("seen", F.lit(False)).alias("seen"), F.coalesce("tracked", F.lit(False)).alias("tracked"))


@query("l3_sections_in_order", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_order, section_id) AS INTEGER) AS n, section_id FROM {SECTIONS}")
def sections_in_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("section_order", "section_id")
    return src.sections(spark, sf).select("doc_id", F.row_number().over(w).alias("n"), "section_id")


@query("a11_documents_of_results", f"{s._SCORED} SELECT query_id, string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS docs, count(DISTINCT doc_id) AS n FROM top GROUP BY query_id")
def documents_of_results(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array_sort(F.collect_set(F.col("doc_id").cast("string")))
    return s._top(spark, sf).groupBy("query_id").agg(F.array_join(ids, ",").alias("docs"), F.size(ids).cast("bigint").alias("n"))


