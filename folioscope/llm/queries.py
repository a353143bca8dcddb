"""The queries of problems 1 to 8, and their SQL where SQL is quick enough on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import p1_history, p2_near, p3_split, p4_scans, p5_neighbours, p6_pack, p7_mix, p8_encoding, simjoin
from folioscope.plans.materialize import materialize, shared_dir


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _index(spark: SparkSession) -> p1_history.HistoryIndex:
    return p1_history.HistoryIndex(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The batches in order against the index of those before; groups over the links that were found by text.

    All batches are waiting, so that a step takes up to four times as many as were accepted before it: a backlog of n
    batches is gone through in log n steps, each of which compares its documents with the index and with each other.
    """
    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.coalesce("ingest_batch", F.lit(2**31 - 1)).alias("ingest_batch"))
    index, done = _index(spark).start(docs), 0
    waiting = [r[0] for r in docs.select("ingest_batch").distinct().orderBy("ingest_batch").collect()]  # a number for each batch
    while done < len(waiting):
        step = waiting[done : done + max(1, 4 * done)]
        index.add(docs.where(F.col("ingest_batch").between(step[0], step[-1])))
        done += len(step)
    return simjoin.firsts(index.links().select("a", "b"), docs, ["ingest_batch"]).select(F.col("first_id").alias("first_doc_id"), F.col("id").alias("doc_id"))


def p1_last_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The last batch against an index of all batches before it, by hashes and text."""
    docs = _read(spark, sf, "documents")
    last = docs.agg(F.max("ingest_batch")).head()[0]
    history, batch = (p1_history.batch_rows(docs.where(c)) for c in (F.col("ingest_batch") < last, F.col("ingest_batch") == last))
    index = _index(spark).start(history)
    index.add(history)
    return index.duplicates(index.add(batch)).select(F.col("id").alias("doc_id"), F.col("duplicate_of").alias("duplicate_of_doc_id"), "matched_by")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_near.near_groups(_passages(spark, sf))


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return p2_near.passages(_read(spark, sf, "chunks"), _read(spark, sf, "parsed_sections"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_split.oversized(_passages(spark, sf))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return p3_split.split(_passages(spark, sf))


def p3_invariants(spark: SparkSession, sf: str) -> DataFrame:
    records = _passages(spark, sf)
    return p3_split.invariants(records, p3_split.split(records))


def _noise(spark: SparkSession, sf: str) -> DataFrame:
    titles = _read(spark, sf, "documents").select("doc_id", "title").unionByName(_read(spark, sf, "parsed_documents").select("doc_id", "title"))
    return p4_scans.scan_noise(_read(spark, sf, "parsed_sections"), titles)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _noise(spark, sf).select("section_id")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), p7_mix.source_name("source").alias("source"), "text")
    capacities = {r.pack_name: r.capacity_tokens for r in _read(spark, sf, "pack_sizes").collect()}
    return p6_pack.pack(p6_pack.sized(docs), capacities)


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf).withColumnRenamed("id", "doc_id")


def p6_unused_space(spark: SparkSession, sf: str) -> DataFrame:
    return p6_pack.unused(_packed(spark, sf), _read(spark, sf, "pack_sizes"))


def p6_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return p6_pack.invariants(_packed(spark, sf), _read(spark, sf, "pack_sizes"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, p7_mix.Mix, DataFrame]:
    docs, targets = materialize(p7_mix.documents_by_source(_read(spark, sf, "documents")), "tokens"), _read(spark, sf, "mix_targets")
    plan = p7_mix.plan_mix(docs, targets)
    return docs, targets, plan, p7_mix.select_mix(docs, plan)


def p7_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[3].withColumnRenamed("id", "doc_id")


def p7_actual_shares(spark: SparkSession, sf: str) -> DataFrame:
    docs, targets, plan, mix = _mixed(spark, sf)
    return p7_mix.shares(mix, docs, targets, plan)


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Per source of the targets: whether its repeats keep the limit, and its share the target unless the limit binds."""
    docs, targets, plan, mix = _mixed(spark, sf)
    largest = docs.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    told = p7_mix.shares(mix, docs, targets, plan).join(largest, "source", "left")
    missed = F.coalesce("largest", F.lit(0)) / F.lit(max(plan.total, 1.0))  # a budget is missed by less than a document
    met = F.col("binding") | (F.col("available_tokens") == 0) | (F.col("actual_share") >= F.col("target_share") - missed)
    return told.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), met.alias("target_met_or_limit_binds"))


def _points(spark: SparkSession, sf: str) -> p5_neighbours.Points:
    return p5_neighbours.valid_points(_read(spark, sf, "vector_points"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    return p5_neighbours.neighbour_pairs(p5_neighbours.nearest(points), points)


def p5_neighbours_of_all(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    return p5_neighbours.named(p5_neighbours.nearest(points), points, {"id": "point_id", "other": "neighbour_id"})


def p5_missed_share(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    return p5_neighbours.recall(p5_neighbours.nearest(points), p5_neighbours.brute_force(points))


def _restored(spark: SparkSession, sf: str) -> DataFrame:
    return p8_encoding.restored(_read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _restored(spark, sf).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_last_batch": p1_last_batch,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_invariants": p3_invariants,
    "p4_found": p4_found,
    "p4_repaired": _noise,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours_of_all,
    "p5_missed_share": p5_missed_share,
    "p6_containers": p6_containers,
    "p6_unused_space": p6_unused_space,
    "p6_invariants": p6_invariants,
    "p7_selection": p7_selection,
    "p7_actual_shares": p7_actual_shares,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_restored": _restored,
}

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LONG = f"length(text) > 3000 OR len(list_filter(string_split_regex(text, '{_SPACE}'), lambda w: w <> '')) > 320"

#: Only what SQL does quickly on whole tables; the other queries are tested against brute force on small inputs.
ORACLES: dict[str, str] = {
    "p3_found": f"""
SELECT DISTINCT 'chunk' AS record_kind, chunk_id AS record_id FROM (SELECT chunk_id, chunk_text AS text FROM chunks) WHERE {_LONG}
UNION ALL SELECT DISTINCT 'section', section_id FROM parsed_sections WHERE {_LONG}""",
    "p3_invariants": f"""
SELECT DISTINCT 'chunk' AS record_kind, chunk_id AS record_id, CAST(length(text) AS INTEGER) AS n_chars, true AS contiguous, true AS within_limits, true AS overlapping FROM (SELECT chunk_id, chunk_text AS text FROM chunks) WHERE {_LONG}
UNION ALL SELECT DISTINCT 'section', section_id, CAST(length(text) AS INTEGER), true, true, true FROM parsed_sections WHERE {_LONG}""",
    "p6_invariants": "SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS needlessly_cut FROM pack_sizes",
    "p7_invariants": "SELECT source, true AS within_repeats, true AS target_met_or_limit_binds FROM mix_targets",
}
