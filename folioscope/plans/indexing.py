"""Queries of the indexing side: scans, normalisation, duplicates, chunks, ids, embeddings, the file state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import scores as sc
from folioscope.functions import text as t
from folioscope.operators import chunking, dedup, embedding, jsontools, summaries, sync
from folioscope.plans.registry import CHUNKS, LOG, NOW, SECTIONS, SYNC, Registry
from folioscope.sources import files, tables as src

query = Registry()
IGNORE = ["*/archive/*", "*.docx", "*/inbox", "budget-*"]
_BLANKS = r"[\t\r\f\v \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NORM = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({{c}}, chr(0), ''), '\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '{_BLANKS}', ' ', 'g'), ' \n', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_HASH = r"nullif(regexp_extract(lower({c}), '([0-9a-f]{{64}})\s*$', 1), '')"


def _norm(c: str) -> str:
    return _NORM.replace("{{", "{").replace("}}", "}").replace("{{", "{").replace("}}", "}").replace("{c}", c)


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('{t.NAMESPACE_HEX}') || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


@query("s2_ignored_files", r"""
SELECT file_path, (file_path LIKE '%/archive/%' OR regexp_matches(file_path, '/archive(/|$)') OR file_path LIKE '%.docx' OR list_contains(string_split(file_path, '/'), '.docx')
  OR regexp_matches(file_path, '/inbox$') OR list_contains(string_split(file_path, '/'), 'inbox') OR starts_with(file_path, 'budget-') OR list_contains(string_split(file_path, '/'), 'budget-')) AS ignored FROM documents""")
def ignored_files(spark: SparkSession, sf: str) -> DataFrame:
    return src.documents(spark, sf).select("file_path", sync.ignored(F.col("file_path"), IGNORE).alias("ignored"))


@query("s3_file_types", f"SELECT file_path, CASE WHEN lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) IN ('pdf', 'docx', 'txt', 'md') THEN lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) END AS file_type FROM {SYNC}")
def file_types(spark: SparkSession, sf: str) -> DataFrame:
    return src.sync_state(spark, sf).select("file_path", t.file_type(F.col("file_path")).alias("file_type"))


@query("s4_text_file_hashes", rf"SELECT doc_id, sha256(text) AS content_hash, sha256(text) IS NOT DISTINCT FROM {_HASH.format(c='raw_content_hash')} AS as_recorded FROM documents WHERE file_type IN ('txt', 'md')")
def text_file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf).where("file_type in ('txt', 'md')").withColumn("content_hash", F.sha2("text", 256))
    return docs.select("doc_id", "content_hash", F.equal_null("content_hash", dedup.clean_hash(F.col("raw_content_hash"))).alias("as_recorded"))


_SNAP = "(SELECT file_path, modified_at, {h} AS content_hash FROM documents WHERE indexed_at IS NOT NULL)".format(h=_HASH.format(c="raw_content_hash"))


@query("s5_rescan", f"""
WITH s AS (SELECT * FROM {SYNC} WHERE NOT is_deleted), d AS {_SNAP}
SELECT coalesce(d.file_path, s.file_path) AS file_path, CASE WHEN s.file_path IS NULL THEN 'created' WHEN d.file_path IS NULL THEN 'deleted' ELSE 'modified' END AS event_type
FROM d FULL JOIN s ON d.file_path = s.file_path
WHERE s.file_path IS NULL OR d.file_path IS NULL OR s.process_status = 'processing' OR (d.modified_at IS DISTINCT FROM s.modified_at AND d.content_hash IS DISTINCT FROM s.content_hash)""")
def rescan(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents(spark, sf).where("indexed_at is not null")
    return sync.rescan(docs.select("file_path", "modified_at", dedup.clean_hash(F.col("raw_content_hash")).alias("content_hash")), src.sync_state(spark, sf))


@query("s9_markdown_sections", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE file_type = 'md'),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}[\t\f\v ]+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l),
p AS (SELECT doc_id, part, max(CASE WHEN regexp_matches(line, '^#{1,6}[\t\f\v ]+\S') THEN trim(regexp_replace(line, '^#{1,6}[\t\f\v ]+', ''), ' ' || chr(9) || chr(13)) END) AS heading,
  trim(coalesce(string_agg(CASE WHEN regexp_matches(line, '^#{1,6}[\t\f\v ]+\S') THEN NULL ELSE line END, chr(10) ORDER BY i), ''), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM g GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS section_order, heading, sha256(text) AS text_hash FROM p WHERE heading IS NOT NULL OR text <> ''""")
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    found = files.markdown_sections(src.documents(spark, sf).where("file_type = 'md'").select("doc_id", "text"))
    return found.select("doc_id", "section_order", "heading", F.sha2("text", 256).alias("text_hash"))


@query("s11_parse_timeouts", f"SELECT file_path, least(600, greatest(60, CAST(floor(60 + coalesce(size_bytes, 0) / 1048576.0 * 30) AS INTEGER))) AS seconds FROM {SYNC}")
def parse_timeouts(spark: SparkSession, sf: str) -> DataFrame:
    return src.sync_state(spark, sf).select("file_path", t.parse_timeout(F.col("size_bytes")).alias("seconds"))


@query("s13_classified", f"""
SELECT file_path, coalesce(file_type, 'txt') AS kind, coalesce(file_type, 'txt') IN ('pdf', 'docx') AS ocr,
  CASE WHEN coalesce(file_type, 'txt') = 'pdf' AND size_bytes > 5000000 THEN 'high' WHEN coalesce(file_type, 'txt') IN ('pdf', 'docx') THEN 'medium' ELSE 'low' END AS complexity FROM {SYNC}""")
def classified(spark: SparkSession, sf: str) -> DataFrame:
    return sync.classified(src.sync_state(spark, sf)).select("file_path", "kind", "ocr", "complexity")


@query("s15_disk_counts", f"SELECT folder_path, count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM {SYNC} WHERE NOT is_deleted AND lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) IN ('pdf', 'docx', 'txt', 'md') GROUP BY folder_path")
def disk_counts(spark: SparkSession, sf: str) -> DataFrame:
    there = src.sync_state(spark, sf).where(~F.col("is_deleted") & t.file_type(F.col("file_path")).isNotNull())
    return there.groupBy("folder_path").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("bytes"))


@query("f1_normalized_texts", f"SELECT doc_id, sha256({_norm('text')}) AS norm_hash FROM documents")
def normalized_texts(spark: SparkSession, sf: str) -> DataFrame:
    return src.documents(spark, sf).select("doc_id", F.sha2(t.normalize_text(F.col("text")), 256).alias("norm_hash"))


@query("i1_normalized_sections", f"SELECT section_id, trim(heading) AS heading, section_order, length(x) AS chars, sha256(x) AS text_hash FROM (SELECT *, {_norm('text')} AS x FROM {SECTIONS}) WHERE x <> ''")
def normalized_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.sections(spark, sf).withColumn("x", t.normalize_text(F.col("text"))).where("x <> ''")
    return rows.select("section_id", F.trim("heading").alias("heading"), "section_order", F.length("x").cast("bigint").alias("chars"), F.sha2("x", 256).alias("text_hash"))


@query("f3_derived_ids", f"SELECT doc_id, section_order, {_uuid5(chr(39) + 's:' + chr(39) + ' || doc_id || ' + chr(39) + ':section:' + chr(39) + ' || section_order')} AS id FROM {SECTIONS}")
def derived_ids(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("s:"), F.col("doc_id").cast("string"), F.lit(":section:"), F.col("section_order").cast("string"))
    return src.sections(spark, sf).select("doc_id", "section_order", t.uuid5(name).alias("id"))


@query("f4_sentences", rf"SELECT section_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0)) AS n FROM {SECTIONS}")
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return src.sections(spark, sf).select("section_id", F.size(t.sentences(F.col("text"))).cast("bigint").alias("n"))


@query("f5_segmented_sentences")
def segmented(spark: SparkSession, sf: str) -> DataFrame:
    return src.sections(spark, sf).select("section_id", F.posexplode(t.segment_sentences(F.col("text"))).alias("n", "sentence"))


@query("f6_token_drift", f"SELECT chunk_id, token_count AS recorded, CAST(coalesce(len(regexp_extract_all(chunk_text, '{_TOKEN}')), 0) AS INTEGER) AS counted FROM {CHUNKS} WHERE token_count IS DISTINCT FROM len(regexp_extract_all(chunk_text, '{_TOKEN}'))")
def token_drift(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.chunks(spark, sf).select("chunk_id", F.col("token_count").alias("recorded"), t.count_tokens(F.col("chunk_text")).alias("counted"))
    return rows.where(~F.equal_null("recorded", "counted"))


@query("f7_code_blocks", r"SELECT doc_id, len(regexp_extract_all(text, '```[\s\S]*?```')) AS blocks, length(regexp_replace(text, '```[\s\S]*?```', '', 'g')) AS chars_outside FROM documents WHERE contains(text, '```')")
def code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.documents(spark, sf).where(F.contains("text", F.lit("```")))
    outside = F.length(F.regexp_replace("text", "```[\\s\\S]*?```", ""))
    return rows.select("doc_id", F.size(t.code_blocks(F.col("text"))).cast("bigint").alias("blocks"), outside.cast("bigint").alias("chars_outside"))


@query("f9_growth_thresholds", f"SELECT section_id, n, round(0.35 + 0.65 / (1 + exp(-(n - 15) / 2.0)), 8) AS threshold FROM (SELECT section_id, count(*) AS n FROM {CHUNKS} GROUP BY section_id)")
def growth_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.chunks(spark, sf).groupBy("section_id").agg(F.count("*").alias("n"))
    return rows.withColumn("threshold", F.round(sc.boundary_threshold(F.lit(0.35), F.col("n"), F.lit(15)), 8))


@query("f13_augmented_texts", f"SELECT chunk_id, sha256('Questions this content answers:' || chr(10) || '- What is ' || coalesce(section_heading, 'this') || '?' || chr(10) || '- Which label has it?' || chr(10) || chr(10) || chunk_text) AS text_hash FROM {CHUNKS}")
def augmented(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.array(F.concat(F.lit("What is "), F.coalesce("section_heading", F.lit("this")), F.lit("?")), F.lit("Which label has it?"))
    return src.chunks(spark, sf).select("chunk_id", F.sha2(t.augmented_text(F.col("chunk_text"), asked), 256).alias("text_hash"))


@query("f20_cleaned_details", rf"SELECT log_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(chr(27) || '[1m> ' || details || chr(10) || '```json', '\x1b\[[0-9;]*[A-Za-z]', '', 'g'), chr(10)), lambda x: CASE WHEN starts_with(x, '> ') THEN regexp_replace(x, '^[> ]+', '') ELSE x END), lambda x: trim(x) NOT IN ('json', '```json', '```')), chr(10)) AS cleaned FROM {LOG} WHERE details IS NOT NULL")
def cleaned_details(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("\x1b[1m> "), F.col("details"), F.lit("\n```json"))
    return src.processing_log(spark, sf).where("details is not null").select("log_id", t.clean_output(raw).alias("cleaned"))


@query("f17_details_as_json", f"SELECT log_id, json_valid(details) AND details LIKE '{{%' AS found, CASE WHEN json_valid(details) THEN json_extract_string(details, '$.outcome') END AS outcome, CASE WHEN json_valid(details) THEN CAST(json_extract(details, '$.retry') AS INTEGER) END AS retry FROM {LOG} WHERE details IS NOT NULL")
def details_as_json(spark: SparkSession, sf: str) -> DataFrame:
    found = jsontools.extracted(src.processing_log(spark, sf).where("details is not null"), "log_id", "details")
    return found.select("log_id", F.col("json").isNotNull().alias("found"), F.get_json_object("json", "$.outcome").alias("outcome"), F.get_json_object("json", "$.retry").cast("int").alias("retry"))


@query("f17_extracted_outcomes")
def extracted_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return jsontools.extracted(src.processing_log(spark, sf).where("details is not null"), "log_id", "details").where("json is not null").select("log_id", "json")


@query("f22_retry_allowed", f"SELECT file_path, retry_count FROM {SYNC} WHERE process_status <> 'poison' AND NOT coalesce(process_status = 'error' AND epoch(TIMESTAMPTZ '2020-01-10 00:00:00+00') < epoch(CAST(synced_at AS TIMESTAMPTZ)) + 30 * pow(2, retry_count), false)")
def retry_allowed(spark: SparkSession, sf: str) -> DataFrame:
    state = src.sync_state(spark, sf)
    return sync.may_retry(state, F.lit("2020-01-10 00:00:00").cast("timestamp"), t.iso_time(F.col("synced_at"))).select("file_path", "retry_count")


@query("f23_display_values", f"""
SELECT file_path, CASE WHEN size_bytes IS NULL THEN NULL WHEN size_bytes < 1024 THEN format('{{:.1f}} B', size_bytes * 1.0::DOUBLE) WHEN size_bytes < 1048576 THEN format('{{:.1f}} KB', (size_bytes / 1024.0)::DOUBLE) ELSE format('{{:.1f}} MB', (size_bytes / 1048576.0)::DOUBLE) END AS size,
  CASE WHEN x IS NULL THEN NULL WHEN s >= 86400 THEN (s // 86400) || 'd ago' WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || 'h ago' WHEN s % 86400 >= 60 THEN (s % 86400 // 60) || 'm ago' ELSE 'just now' END AS ago
FROM (SELECT *, CAST(floor(epoch(TIMESTAMPTZ '{NOW}+00')) - floor(epoch(x)) AS BIGINT) AS s FROM (SELECT *, CAST(synced_at AS TIMESTAMPTZ) AS x FROM {SYNC}))""")
def display_values(spark: SparkSession, sf: str) -> DataFrame:
    ago = t.time_ago(t.iso_time(F.col("synced_at")), F.lit(NOW).cast("timestamp"))
    return src.sync_state(spark, sf).select("file_path", t.size_text(F.col("size_bytes")).alias("size"), ago.alias("ago"))


@query("f26_hash_embeddings", """
WITH w AS (SELECT doc_id, sha256(x) AS h FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: x <> '')) AS x FROM documents WHERE title IS NOT NULL)),
p AS (SELECT doc_id, CAST('0x' || substr(h, CAST(i * 4 + 1 AS INTEGER), 4) AS INTEGER) % 1024 AS place FROM w, range(16) r(i)),
n AS (SELECT doc_id, place, count(*) AS n FROM p GROUP BY ALL), l AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM n GROUP BY doc_id)
SELECT doc_id, place, round(n / l, 8) AS weight FROM n JOIN l USING (doc_id)""")
def hash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    found = embedding.sparse_hash(src.documents(spark, sf).where("title is not null"), "doc_id", "title")
    return found.withColumn("weight", F.round("weight", 8))


_DECIDE = f"""
WITH f AS (SELECT file_path, {_HASH.format(c='raw_content_hash')} AS r, {_HASH.format(c='normalized_content_hash')} AS n FROM documents),
k AS (SELECT file_path, {_HASH.format(c='raw_hash')} AS r, {_HASH.format(c='normalized_hash')} AS n FROM document_hashes),
x AS (SELECT f.*, k0.r AS known, (SELECT min(file_path) FROM k WHERE k.r = f.r) AS rk, (SELECT min(file_path) FROM f g WHERE g.r = f.r) AS rb, (SELECT min(file_path) FROM k WHERE k.n = f.n) AS nk, (SELECT min(file_path) FROM f g WHERE g.n = f.n) AS nb
  FROM f LEFT JOIN k k0 ON k0.file_path = f.file_path),
y AS (SELECT *, coalesce(nullif(rk, file_path), CASE WHEN rb < file_path THEN rb END, nullif(nk, file_path), CASE WHEN nb < file_path THEN nb END) AS o FROM x)
SELECT file_path, CASE WHEN coalesce(known = r, false) THEN 'unchanged' WHEN o IS NOT NULL THEN 'duplicate' ELSE 'index' END AS outcome, CASE WHEN coalesce(known = r, false) THEN NULL ELSE o END AS original FROM y"""


@query("i2_dedup_decisions", _DECIDE)
def dedup_decisions(spark: SparkSession, sf: str) -> DataFrame:
    h = lambda c, a: dedup.clean_hash(F.col(c)).alias(a)
    docs = src.documents(spark, sf).select("file_path", h("raw_content_hash", "raw_hash"), h("normalized_content_hash", "norm_hash"))
    known = src.read(spark, sf, "document_hashes").select("file_path", h("raw_hash", "raw_hash"), h("normalized_hash", "norm_hash"))
    return dedup.decide(docs, known)


@query("j7_known_hashes", f"SELECT d.doc_id, h.canonical_doc_id FROM documents d JOIN (SELECT {_HASH.format(c='normalized_hash')} AS n, min(canonical_doc_id) AS canonical_doc_id FROM document_hashes GROUP BY 1) h ON h.n = {_HASH.format(c='d.normalized_content_hash')} WHERE h.canonical_doc_id <> d.doc_id")
def known_hashes(spark: SparkSession, sf: str) -> DataFrame:
    known = src.read(spark, sf, "document_hashes").select(dedup.clean_hash(F.col("normalized_hash")).alias("n"), "canonical_doc_id")
    docs = src.documents(spark, sf).select("doc_id", dedup.clean_hash(F.col("normalized_content_hash")).alias("n"))
    return docs.join(dedup.firsts(known, "n", "canonical_doc_id").withColumnRenamed("first", "canonical_doc_id"), "n").where("canonical_doc_id <> doc_id").select("doc_id", "canonical_doc_id")


_FULL = "len(r.held) > 0 AND list_sum(r.sizes) + s.n > 512"
_KEPT = "len(list_filter(range(1, len(r.sizes) + 1), lambda k: list_sum(r.sizes[-k:]) <= 64))"


@query("i4_fixed_chunks", rf"""
WITH RECURSIVE l AS (SELECT doc_id, section_id, section_order, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0) AS x FROM {SECTIONS}),
s AS (SELECT section_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM l), sn AS (SELECT *, len(regexp_extract_all(x, '{_TOKEN}')) AS n FROM s),
r AS (SELECT section_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS held, CAST([] AS BIGINT[]) AS sizes, CAST(NULL AS VARCHAR) AS out, CAST(NULL AS BIGINT) AS n FROM l
  UNION ALL SELECT s.section_id, s.i,
    CASE WHEN {_FULL} THEN list_append(r.held[len(r.held) - {_KEPT} + 1:], s.x) WHEN len(r.held) = 0 AND s.n > 512 THEN r.held ELSE list_append(r.held, s.x) END,
    CASE WHEN {_FULL} THEN list_append(r.sizes[len(r.sizes) - {_KEPT} + 1:], s.n) WHEN len(r.held) = 0 AND s.n > 512 THEN r.sizes ELSE list_append(r.sizes, s.n) END,
    CASE WHEN {_FULL} THEN array_to_string(r.held, ' ') WHEN len(r.held) = 0 AND s.n > 512 THEN s.x END,
    CASE WHEN {_FULL} THEN CAST(list_sum(r.sizes) AS BIGINT) WHEN len(r.held) = 0 AND s.n > 512 THEN s.n END
  FROM r JOIN sn s ON s.section_id = r.section_id AND s.i = r.i + 1),
e AS (SELECT section_id, i, out, n FROM r WHERE out IS NOT NULL UNION ALL
  SELECT section_id, i + 1, array_to_string(held, ' '), len(regexp_extract_all(array_to_string(held, ' '), '{_TOKEN}')) FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY i DESC) AS k FROM r) WHERE k = 1 AND len(held) > 0),
c AS (SELECT e.section_id, l.doc_id, l.section_order, e.out, e.n, row_number() OVER (PARTITION BY e.section_id ORDER BY e.i) - 1 AS chunk_idx FROM e JOIN l USING (section_id))
SELECT section_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_order, section_id, chunk_idx) - 1 AS INTEGER) AS chunk_order, CAST(n AS INTEGER) AS token_count, sha256(out) AS text_hash FROM c""")
def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    found = chunking.fixed_chunks(src.sections(spark, sf))
    return found.select("section_id", "chunk_idx", "chunk_order", "token_count", F.sha2("chunk_text", 256).alias("text_hash"))


@query("i5_semantic_chunks")
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.semantic_chunks(src.sections(spark, sf), embedding.hash_vectors)


@query("w2_chunk_orders", f"SELECT chunk_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY s.section_order, c.chunk_order, c.chunk_id) - 1 AS INTEGER) AS running, c.chunk_order FROM {CHUNKS} c JOIN {SECTIONS} s USING (section_id)")
def chunk_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.chunks(spark, sf).select("chunk_id", "doc_id", "section_id", "chunk_order").join(src.sections(spark, sf).select("section_id", "section_order"), "section_id")
    w = Window.partitionBy("doc_id").orderBy("section_order", "chunk_order", "chunk_id")
    return rows.select("chunk_id", (F.row_number().over(w) - 1).alias("running"), "chunk_order")


@query("w9_prompt_batches", f"""
WITH RECURSIVE o AS (SELECT doc_id, section_order, section_id, least(length(text), 5000) + length(coalesce(heading, 'Untitled section')) + 50 AS size, row_number() OVER (PARTITION BY doc_id ORDER BY section_order, section_id) AS i FROM {SECTIONS}),
r AS (SELECT *, 0 AS batch, size AS total FROM o WHERE i = 1 UNION ALL
  SELECT o.*, CASE WHEN r.total + o.size > 80000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.total + o.size > 80000 THEN o.size ELSE r.total + o.size END FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1)
SELECT section_id, batch FROM r""")
def prompt_batches(spark: SparkSession, sf: str) -> DataFrame:
    size = F.least(F.length("text"), F.lit(t.MAX_EXCERPT)) + F.length(F.coalesce("heading", F.lit("Untitled section"))) + 50
    return chunking.batches_by_size(src.sections(spark, sf), "doc_id", ["section_order", "section_id"], size).select("section_id", "batch")


@query("i16_summary_points", f"""
WITH s AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_order, section_id) - 1 AS INTEGER) AS i FROM {SECTIONS} WHERE {_norm('text')} <> '')
SELECT {_uuid5("doc_id || ':document_summary'")} AS point_id, doc_id, 'document_summary' AS record_type FROM documents
UNION ALL SELECT {_uuid5("doc_id || ':section_summary:' || i")}, doc_id, 'section_summary' FROM s""")
def summary_points(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.summary_points(src.documents(spark, sf), src.sections(spark, sf)).select("point_id", "doc_id", "record_type")


@query("i14_extractive_summaries", f"SELECT section_id, array_to_string(regexp_extract_all(regexp_replace(text, '\\s+', ' ', 'g'), '[^ ]+')[1:8], ' ') AS summary_8w, array_to_string(regexp_extract_all(regexp_replace(text, '\\s+', ' ', 'g'), '[^ ]+')[1:32], ' ') AS summary_32w FROM {SECTIONS}")
def extractive(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.extractive(src.sections(spark, sf), "text", (8, 32)).select("section_id", "summary_8w", "summary_32w")


@query("i18_after_failures", f"SELECT file_path, CASE WHEN retry_count + 1 >= 3 THEN 'poison' ELSE 'error' END AS process_status, retry_count + 1 AS retry_count FROM {SYNC} WHERE process_status IN ('processing', 'error')")
def after_failures(spark: SparkSession, sf: str) -> DataFrame:
    return sync.after_failure(src.sync_state(spark, sf).where("process_status in ('processing', 'error')")).select("file_path", "process_status", "retry_count")


@query("i21_ensured_state", f"SELECT file_path, process_status FROM {SYNC} UNION ALL SELECT file_path, 'pending' FROM documents WHERE file_path NOT IN (SELECT file_path FROM {SYNC})")
def ensured_state(spark: SparkSession, sf: str) -> DataFrame:
    return sync.ensured(src.sync_state(spark, sf), src.documents(spark, sf)).select("file_path", "process_status")


@query("j15_questions_assigned", f"""
WITH q AS (SELECT doc_id, CAST(json_extract(details, '$.retry') AS INTEGER) AS chunk_order, min(log_id) AS log_id FROM {LOG} WHERE json_valid(details) AND json_extract(details, '$.retry') IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL)
SELECT c.chunk_id, q.log_id FROM {CHUNKS} c LEFT JOIN q USING (doc_id, chunk_order)""")
def questions_assigned(spark: SparkSession, sf: str) -> DataFrame:
    order = F.get_json_object("details", "$.retry").cast("int")
    said = src.processing_log(spark, sf).where("doc_id is not null").select("doc_id", order.alias("chunk_order"), "log_id").where("chunk_order is not null")
    said = said.groupBy("doc_id", "chunk_order").agg(F.min("log_id").alias("log_id"))
    return src.chunks(spark, sf).select("chunk_id", "doc_id", "chunk_order").join(said, ["doc_id", "chunk_order"], "left").select("chunk_id", "log_id")
