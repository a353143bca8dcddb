"""Queries over the metadata: counts, folders, lookups, orderings, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import status, store
from folioscope.plans.registry import CHUNKS, ISO, LOG, SECTIONS, SYNC, Registry
from folioscope.sources import tables as src

query = Registry()
ROOTS = ("/corpus/finance/index", "/corpus/finance", "/corpus/ops", "/corpus/legal", "/corpus")
_ROOTS_SQL = "(VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(ROOTS)) + ") AS r(i, root)"


@query("a1_table_counts", f"""
SELECT 'documents' AS relation, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM {CHUNKS}
UNION ALL SELECT 'sections', count(*) FROM {SECTIONS} UNION ALL SELECT 'points', count(DISTINCT point_id) FROM vector_points""")
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        src.documents(spark, sf).agg(F.count("*").alias("n")).select(F.lit("documents").alias("relation"), "n"),
        src.chunks(spark, sf).agg(F.count("*").alias("n")).select(F.lit("chunks").alias("relation"), "n"),
        src.sections(spark, sf).agg(F.count("*").alias("n")).select(F.lit("sections").alias("relation"), "n"),
        src.read(spark, sf, "vector_points").agg(F.countDistinct("point_id").alias("n")).select(F.lit("points").alias("relation"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("a2_total_tokens", f"SELECT CAST(coalesce(sum(token_count), 0) AS BIGINT) AS total_tokens FROM {CHUNKS}")
def total_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return src.chunks(spark, sf).agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("total_tokens"))


@query("a3_status_counts", f"SELECT CASE WHEN process_status IN ('error', 'poison') THEN 'error' ELSE process_status END AS status, count(*) AS n FROM {SYNC} WHERE NOT is_deleted GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return status.status_counts(src.sync_state(spark, sf))


@query("a4_file_types", "SELECT file_type, count(*) AS n FROM documents GROUP BY file_type")
def file_types(spark: SparkSession, sf: str) -> DataFrame:
    return src.documents(spark, sf).groupBy("file_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_type")


@query("a5_folder_status", f"""
SELECT folder_path, count(*) AS file_count, count(*) FILTER (process_status = 'done') AS indexed,
  count(*) FILTER (process_status = 'error') AS errors, count(*) FILTER (process_status IN ('error', 'poison')) AS failed
FROM {SYNC} WHERE NOT is_deleted GROUP BY folder_path""")
def folder_status(spark: SparkSession, sf: str) -> DataFrame:
    return status.folder_status(src.sync_state(spark, sf))


@query("a6_root_status", f"""
WITH f AS (SELECT folder_path, count(*) AS file_count, count(*) FILTER (process_status = 'done') AS indexed, count(*) FILTER (process_status IN ('error', 'poison')) AS failed FROM {SYNC} WHERE NOT is_deleted GROUP BY 1),
m AS (SELECT f.*, min(i) AS i FROM f JOIN {_ROOTS_SQL} ON f.folder_path = r.root OR starts_with(f.folder_path, r.root || '/') GROUP BY ALL)
SELECT r.root, CAST(coalesce(sum(file_count), 0) AS BIGINT) AS file_count, CAST(coalesce(sum(indexed), 0) AS BIGINT) AS indexed, CAST(coalesce(sum(failed), 0) AS BIGINT) AS failed
FROM {_ROOTS_SQL} LEFT JOIN m ON m.i = r.i GROUP BY r.root""")
def root_status(spark: SparkSession, sf: str) -> DataFrame:
    return status.roll_up(status.folder_status(src.sync_state(spark, sf)), ROOTS)


@query("a7_sync_summary", f"""
SELECT max(synced_at) AS last_synced, count(*) AS total, count(*) FILTER (process_status = 'pending') AS pending, count(*) FILTER (process_status = 'error') AS errors, count(*) FILTER (process_status = 'poison') AS poisoned
FROM {SYNC} WHERE NOT is_deleted""")
def sync_summary(spark: SparkSession, sf: str) -> DataFrame:
    return status.sync_summary(src.sync_state(spark, sf))


@query("a9_optional_fields", f"SELECT count(*) AS chunks, count(citation_label) AS labelled, count(section_heading) AS headed, count(nullif(token_count, 0)) AS counted FROM {CHUNKS}")
def optional_fields(spark: SparkSession, sf: str) -> DataFrame:
    return src.chunks(spark, sf).agg(F.count("*").alias("chunks"), F.count("citation_label").alias("labelled"), F.count("section_heading").alias("headed"), F.count(F.nullif("token_count", F.lit(0))).alias("counted"))


@query("a13_outcomes", f"""
SELECT stage, lower(status) AS status, count(*) AS n, count(*) FILTER (duration_ms >= 0) AS timed, CAST(coalesce(sum(duration_ms) FILTER (duration_ms >= 0), 0) AS BIGINT) AS total_ms
FROM {LOG} GROUP BY ALL""")
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return status.outcomes(src.processing_log(spark, sf))


@query("a14_document_texts", f"SELECT doc_id, count(*) AS sections, sha256(string_agg(text, chr(10) || chr(10) ORDER BY section_order, section_id)) AS text_hash FROM {SECTIONS} WHERE text IS NOT NULL GROUP BY doc_id")
def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    whole = status.assembled(src.sections(spark, sf))
    return whole.select("doc_id", "sections", F.sha2("text", 256).alias("text_hash"))


@query("a15_reindex_guard", "SELECT greatest((SELECT count(*) FROM documents), (SELECT count(*) FROM sync_state), (SELECT count(*) FROM document_hashes)) AS n")
def reindex_guard(spark: SparkSession, sf: str) -> DataFrame:
    counts = [src.read(spark, sf, x).agg(F.count("*").alias(x)) for x in ("documents", "sync_state", "document_hashes")]
    return counts[0].join(counts[1]).join(counts[2]).select(F.greatest("documents", "sync_state", "document_hashes").alias("n"))


@query("j13_document_sizes", f"SELECT d.doc_id, d.title, count(c.chunk_id) AS chunks, CAST(coalesce(sum(c.token_count), 0) AS BIGINT) AS tokens FROM documents d LEFT JOIN {CHUNKS} c USING (doc_id) GROUP BY ALL")
def document_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return status.document_sizes(src.documents(spark, sf), src.chunks(spark, sf)).select("doc_id", "title", "chunks", "tokens")


@query("j6_chunks_with_documents", f"SELECT c.chunk_id, c.doc_id, d.title, d.file_path FROM {CHUNKS} c LEFT JOIN documents d USING (doc_id)")
def chunks_with_documents(spark: SparkSession, sf: str) -> DataFrame:
    return src.chunks(spark, sf).select("chunk_id", "doc_id").join(src.documents(spark, sf).select("doc_id", "title", "file_path"), "doc_id", "left")


@query("j8_duplicates_named", "SELECT d.doc_id, d.duplicate_of_doc_id, regexp_extract(o.file_path, '[^/]*$') AS original FROM documents d LEFT JOIN documents o ON o.doc_id = d.duplicate_of_doc_id WHERE d.duplicate_of_doc_id IS NOT NULL")
def duplicates_named(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf)
    named = docs.select(F.col("doc_id").alias("duplicate_of_doc_id"), t.file_name(F.col("file_path")).alias("original"))
    return docs.where("duplicate_of_doc_id is not null").select("doc_id", "duplicate_of_doc_id").join(named, "duplicate_of_doc_id", "left")


@query("j9_registered_not_indexed", "SELECT h.file_path, h.canonical_doc_id FROM document_hashes h ANTI JOIN (SELECT file_path FROM documents WHERE indexed_at IS NOT NULL) d USING (file_path)")
def registered_not_indexed(spark: SparkSession, sf: str) -> DataFrame:
    there = src.documents(spark, sf).where("indexed_at is not null").select("file_path")
    return src.read(spark, sf, "document_hashes").select("file_path", "canonical_doc_id").join(there, "file_path", "left_anti")


@query("j12_folder_roots", f"SELECT folder_path, arg_min(root, i) AS root FROM (SELECT DISTINCT folder_path FROM documents) JOIN {_ROOTS_SQL} ON folder_path = root OR starts_with(folder_path, root || '/') GROUP BY 1")
def folder_roots(spark: SparkSession, sf: str) -> DataFrame:
    return status.root_of(src.documents(spark, sf).select("folder_path").distinct(), ROOTS).select("folder_path", "root")


@query("l1_recent_documents", "SELECT doc_id, title, file_path FROM documents ORDER BY indexed_at DESC NULLS LAST, doc_id LIMIT 50")
def recent_documents(spark: SparkSession, sf: str) -> DataFrame:
    return status.recent_documents(src.documents(spark, sf), 50).select("doc_id", "title", "file_path")


@query("l1_recent_per_folder", "SELECT folder_path, doc_id, n FROM (SELECT folder_path, doc_id, CAST(row_number() OVER (PARTITION BY folder_path ORDER BY indexed_at DESC NULLS LAST, doc_id) AS INTEGER) AS n FROM documents) WHERE n <= 5")
def recent_per_folder(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("folder_path").orderBy(F.col("indexed_at").desc_nulls_last(), "doc_id")
    return src.documents(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 5").select("folder_path", "doc_id", "n")


@query("l2_pending_queue", f"SELECT file_path, created_at FROM {SYNC} WHERE process_status = 'pending' AND NOT is_deleted ORDER BY created_at, file_path LIMIT 100")
def pending_queue(spark: SparkSession, sf: str) -> DataFrame:
    return status.pending_queue(src.sync_state(spark, sf), 100)


@query("l4_last_errors", f"SELECT file_path, error_message, process_status FROM {SYNC} WHERE process_status IN ('error', 'poison') AND NOT is_deleted ORDER BY synced_at DESC NULLS LAST, file_path LIMIT 25")
def last_errors(spark: SparkSession, sf: str) -> DataFrame:
    return status.last_errors(src.sync_state(spark, sf), 25)


@query("u2_change_events", f"""
SELECT d.file_path, 'created' AS event_type FROM documents d WHERE d.file_path NOT IN (SELECT file_path FROM {SYNC} WHERE NOT is_deleted)
UNION ALL SELECT s.file_path, 'deleted' FROM {SYNC} s WHERE NOT s.is_deleted AND s.file_path NOT IN (SELECT file_path FROM documents WHERE indexed_at IS NOT NULL)""")
def change_events(spark: SparkSession, sf: str) -> DataFrame:
    docs, state = src.documents(spark, sf), src.sync_state(spark, sf).where("not is_deleted")
    new = docs.join(state.select("file_path"), "file_path", "left_anti").select("file_path", F.lit("created").alias("event_type"))
    gone = state.join(docs.where("indexed_at is not null").select("file_path"), "file_path", "left_anti").select("file_path", F.lit("deleted").alias("event_type"))
    return new.unionByName(gone)


@query("u3_stale_points", f"SELECT DISTINCT p.point_id, p.doc_id FROM vector_points p ANTI JOIN {CHUNKS} c ON c.chunk_id = p.point_id AND c.embedding_model_version = p.embedding_model_version WHERE p.record_type = 'chunk'")
def stale_points(spark: SparkSession, sf: str) -> DataFrame:
    points = src.read(spark, sf, "vector_points").where("record_type = 'chunk'").select("point_id", "doc_id", "embedding_model_version")
    keep = src.chunks(spark, sf).select(F.col("chunk_id").alias("point_id"), "embedding_model_version")
    return store.stale(points, keep, ["point_id", "embedding_model_version"]).select("point_id", "doc_id").distinct()


@query("u5_known_paths", f"(SELECT file_path FROM document_hashes UNION SELECT file_path FROM {SYNC}) EXCEPT SELECT file_path FROM {SYNC} WHERE is_deleted")
def known_paths(spark: SparkSession, sf: str) -> DataFrame:
    state = src.sync_state(spark, sf)
    known = src.read(spark, sf, "document_hashes").select("file_path").unionByName(state.select("file_path")).distinct()
    return known.join(state.where("is_deleted").select("file_path"), "file_path", "left_anti")


@query("k3_upsert_sync_state", f"""
WITH new AS (SELECT d.file_path, 'pending' AS process_status, 0 AS retry_count FROM documents d WHERE d.ingest_batch >= 10)
SELECT file_path, process_status, retry_count FROM new UNION ALL SELECT file_path, process_status, retry_count FROM {SYNC} s WHERE s.file_path NOT IN (SELECT file_path FROM new)""")
def upsert_sync_state(spark: SparkSession, sf: str) -> DataFrame:
    new = src.documents(spark, sf).where("ingest_batch >= 10").select("file_path", F.lit("pending").alias("process_status"), F.lit(0).alias("retry_count"))
    return store.upsert(src.sync_state(spark, sf).select("file_path", "process_status", "retry_count"), new, ["file_path"])


@query("k6_register_hashes", r"""
WITH new AS (SELECT file_path, regexp_extract(lower(raw_content_hash), '([0-9a-f]{64})\s*$', 1) AS raw_hash, doc_id AS canonical_doc_id FROM documents WHERE raw_content_hash IS NOT NULL AND duplicate_of_doc_id IS NULL)
SELECT file_path, raw_hash, canonical_doc_id FROM new UNION ALL
SELECT file_path, regexp_extract(lower(raw_hash), '([0-9a-f]{64})\s*$', 1), canonical_doc_id FROM document_hashes WHERE file_path NOT IN (SELECT file_path FROM new)""")
def register_hashes(spark: SparkSession, sf: str) -> DataFrame:
    clean = lambda c: F.regexp_extract(F.lower(c), "([0-9a-f]{64})\\s*$", 1)
    docs = src.documents(spark, sf).where("raw_content_hash is not null and duplicate_of_doc_id is null")
    new = docs.select("file_path", clean("raw_content_hash").alias("raw_hash"), F.col("doc_id").alias("canonical_doc_id"))
    old = src.read(spark, sf, "document_hashes").select("file_path", clean("raw_hash").alias("raw_hash"), "canonical_doc_id")
    return store.upsert(old, new, ["file_path"])


@query("k14_deleted_cascade", f"""
WITH gone AS (SELECT d.doc_id FROM documents d JOIN {SYNC} s USING (file_path) WHERE s.is_deleted)
SELECT 'documents' AS relation, count(*) AS n FROM documents ANTI JOIN gone USING (doc_id) UNION ALL SELECT 'sections', count(*) FROM {SECTIONS} ANTI JOIN gone USING (doc_id)
UNION ALL SELECT 'chunks', count(*) FROM {CHUNKS} ANTI JOIN gone USING (doc_id)""")
def deleted_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf)
    gone = docs.join(src.sync_state(spark, sf).where("is_deleted").select("file_path"), "file_path", "left_semi").select("doc_id")
    left = store.delete_documents({"documents": docs.select("doc_id"), "sections": src.sections(spark, sf), "chunks": src.chunks(spark, sf)}, gone)
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("relation"), "n") for k, df in left.items()])


@query("k2_migrated_sections", f"SELECT section_id, doc_id, heading, section_order, text AS section_text, CAST(NULL AS VARCHAR) AS generated_questions FROM {SECTIONS}")
def migrated_sections(spark: SparkSession, sf: str) -> DataFrame:
    upgraded = store.migrate(src.sections(spark, sf), 1, {2: lambda df: df.withColumnRenamed("text", "section_text"), 3: lambda df: df.withColumn("generated_questions", F.lit(None).cast("string"))})
    return upgraded.select("section_id", "doc_id", "heading", "section_order", "section_text", "generated_questions")


@query("prj1_search_filter", """
SELECT DISTINCT p.point_id, p.doc_id FROM vector_points p JOIN documents d USING (doc_id)
WHERE p.folder_path = '/corpus/inbox/unsorted' AND p.record_type = 'chunk' AND d.file_type = 'md' AND """ + ISO.format(c="d.modified_at") + " >= TIMESTAMPTZ '2019-12-01 00:00:00+00'")
def search_filter(spark: SparkSession, sf: str) -> DataFrame:
    points = src.read(spark, sf, "vector_points").where("folder_path = '/corpus/inbox/unsorted' and record_type = 'chunk'").select("point_id", "doc_id")
    return points.join(src.documents(spark, sf).where((F.col("file_type") == "md") & (t.iso_time(F.col("modified_at")) >= t.iso_time(F.lit("2019-12-01")))).select("doc_id"), "doc_id", "left_semi").distinct()


@query("prj1_subtree_filter", f"SELECT file_path FROM {SYNC} WHERE list_contains(folder_ancestors, '/corpus/finance')")
def subtree_filter(spark: SparkSession, sf: str) -> DataFrame:
    return src.sync_state(spark, sf).where(F.array_contains("folder_ancestors", "/corpus/finance")).select("file_path")


@query("prj4_active_files", f"SELECT file_path, retry_count FROM {SYNC} WHERE NOT is_deleted AND process_status IN ('pending', 'error') AND retry_count < 3")
def active_files(spark: SparkSession, sf: str) -> DataFrame:
    return src.sync_state(spark, sf).where("not is_deleted and process_status in ('pending', 'error') and retry_count < 3").select("file_path", "retry_count")


@query("prj8_folder_ancestors", "SELECT DISTINCT folder_path, list_concat(['/'], list_transform(range(1, len(list_filter(string_split(folder_path, '/'), lambda x: x <> '')) + 1), lambda i: '/' || array_to_string(list_filter(string_split(folder_path, '/'), lambda x: x <> '')[1:i], '/'))) AS ancestors FROM documents")
def folder_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return src.documents(spark, sf).select("folder_path").distinct().withColumn("ancestors", t.folder_ancestors(F.col("folder_path")))


_PAGES = "CASE WHEN page_end IS NOT NULL AND page_end <> page_start THEN 'pp. ' || page_start || '-' || page_end ELSE 'p. ' || page_start END"


@query("prj9_citation_labels", f"SELECT c.chunk_id, concat_ws(', ', coalesce(d.title, regexp_extract(d.file_path, '[^/]*$')), CASE WHEN section_heading <> '' THEN '§ ' || section_heading END, {_PAGES}) AS label, {_PAGES} AS pages FROM {CHUNKS} c JOIN documents d USING (doc_id)")
def citation_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.chunks(spark, sf).join(src.documents(spark, sf).select("doc_id", "title", "file_path"), "doc_id")
    label = t.citation_label(F.coalesce("title", t.file_name(F.col("file_path"))), F.col("section_heading"), F.col("page_start"), F.col("page_end"))
    return rows.select("chunk_id", label.alias("label"), t.pages(F.col("page_start"), F.col("page_end")).alias("pages"))


@query("prj11_truncated", "SELECT doc_id, CASE WHEN length(text) > 800 THEN substr(text, 1, 797) || '...' ELSE text END AS excerpt, CASE WHEN length(f) > 24 THEN substr(f, 1, 23) || '…' ELSE rpad(f, 24, ' ') END AS name FROM (SELECT *, regexp_extract(file_path, '[^/]*$') AS f FROM documents)")
def truncated(spark: SparkSession, sf: str) -> DataFrame:
    return src.documents(spark, sf).select("doc_id", t.truncate(F.col("text"), 800).alias("excerpt"), t.fit_name(t.file_name(F.col("file_path")), 24).alias("name"))


@query("prj12_details_decoded", f"SELECT log_id, CASE WHEN json_valid(details) THEN json_extract_string(details, '$.outcome') END AS outcome FROM {LOG} WHERE details IS NOT NULL")
def details_decoded(spark: SparkSession, sf: str) -> DataFrame:
    return src.processing_log(spark, sf).where("details is not null").select("log_id", F.get_json_object("details", "$.outcome").alias("outcome"))
