import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import analysis, chunking, components, dedup, jsontools, store, summaries, sync, vectors
from folioscope.operators import retrieval as r
from folioscope.operators.components import connected_components
from folioscope.operators.embedding import hash_vectors


def count(s):
    return len(re.findall(r"[\w]+|[^\w\s]", s))


def packed_slowly(sentences, target, overlap):
    """What the fold must give, written as a loop over the sentences."""
    out, at = [], 0
    start = at
    held = []
    while at < len(sentences):
        s = sentences[at]
        if not held and count(s) > target:
            out.append((s, count(s)))
        elif held and sum(map(count, held)) + count(s) > target:
            out.append((" ".join(held), sum(map(count, held))))
            keep = 0
            while keep < len(held) and sum(map(count, held[len(held) - keep - 1 :])) <= overlap:
                keep += 1
            held = held[len(held) - keep :] + [s]
        else:
            held.append(s)
        at += 1
    return out + ([(" ".join(held), count(" ".join(held)))] if held else []) if start == 0 else out


def test_fixed_chunks_are_those_of_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        parts = [" ".join("w" for _ in range(rng.choice([1, 3, 9, 30]))) + "." for _ in range(rng.randrange(0, 25))]
        rows.append((i % 7, f"s{i}", i, " ".join(parts) if parts else ["", None, "  "][i % 3]))
    df = spark.createDataFrame(rows, "doc_id bigint, section_id string, section_order int, text string")
    got = {}
    for x in chunking.fixed_chunks(df, 24, 8).collect():
        got.setdefault(x.section_id, {})[x.chunk_idx] = (x.chunk_text, x.token_count)
    for _, key, _, text in rows:
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
        want = packed_slowly(sentences, 24, 8)
        assert [got.get(key, {})[i] for i in range(len(want))] == want and len(got.get(key, {})) == len(want)
    orders = chunking.fixed_chunks(df, 24, 8).groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_order")).alias("o")).collect()
    assert all(x.o == list(range(len(x.o))) for x in orders)


def test_boundaries_where_the_topic_changes():
    a, b = np.eye(2)
    assert chunking.boundaries(np.array([a, a, b, b, a]), 0.35, 15) == [0, 2, 4]
    assert chunking.boundaries(np.array([a] * 60), 0.35, 15) == [0] or max(np.diff(chunking.boundaries(np.array([a] * 60), 0.35, 15))) >= 15
    assert chunking.boundaries(np.zeros((0, 2)), 0.35, 15) == []


def test_small_groups_join_and_large_ones_split():
    n = lambda s: len(s.split())
    assert chunking.merged_small([["a"], ["b " * 9], ["c"]], n, 5) == [["a", "b " * 9, "c"]]
    assert chunking.merged_small([["a"]], n, 5) == [["a"]]
    assert chunking.split_large([["x " * 4, "y " * 4, "z " * 4], ["big " * 50]], n, 10) == [["x " * 4], ["y " * 4, "z " * 4], ["big " * 50]]


def test_semantic_chunks_keep_code_whole(spark):
    text = "Alpha beta one. Alpha beta two. ```py\nX. Y. Z.\n``` Alpha beta three. Completely other topic. Other topic again."
    df = spark.createDataFrame([(1, "s", 0, text), (1, "t", 1, "One. Two."), (2, "u", 0, None)], "doc_id bigint, section_id string, section_order int, text string")
    got = chunking.semantic_chunks(df, hash_vectors).orderBy("doc_id", "chunk_order").collect()
    assert [x.chunk_order for x in got] == list(range(len(got))) and any("```py\nX. Y. Z.\n```" in x.chunk_text for x in got)
    assert [x.chunk_text for x in got if x.section_id == "t"] == ["One. Two."]


def test_batches_by_size(spark):
    rows = [("g", i, s) for i, s in enumerate([5, 5, 5, 20, 1, 9, 1])] + [("h", 0, 3)]
    df = spark.createDataFrame(rows, "g string, i int, s int")
    got = {(x.g, x.i): x.batch for x in chunking.batches_by_size(df, "g", ["i"], F.col("s"), 10).collect()}
    assert [got["g", i] for i in range(7)] == [0, 0, 1, 2, 3, 3, 4] and got["h", 0] == 0


def test_components_that_a_node_of_two_smaller_ones_connects(spark):
    edges = spark.createDataFrame([(5, 1), (5, 3), (6, 2), (6, 3)], "src bigint, dst bigint")
    assert dict(map(tuple, connected_components(edges).collect())) == {i: 1 for i in (1, 2, 3, 5, 6)}
    stars = components._own_stars(edges.coalesce(1), most=2)
    assert components._settled(components._own_stars(edges.coalesce(1))) and not components._settled(edges)
    assert dict(map(tuple, connected_components(stars).collect())) == {i: 1 for i in (1, 2, 3, 5, 6)}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    parent = list(range(31))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    linked = {i for a, b in edges if a != b for i in (a, b)}
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()))
    assert got == {i: top(i) for i in linked}


def test_a_long_chain_is_one_component(spark):
    got = connected_components(spark.range(300).selectExpr("id as src", "id + 1 as dst"))
    assert got.count() == 301 and got.where("component <> 0").count() == 0


def test_dedup_decisions(spark):
    files = spark.createDataFrame([("a", "r1", "n1"), ("b", "r1", "n9"), ("c", "r2", "n1"), ("d", "r3", "n3"), ("e", None, None), ("f", None, None), ("g", "r5", "n5"), ("h", "r6", "n7")], "file_path string, raw_hash string, norm_hash string")
    known = spark.createDataFrame([("d", "r3", "n3"), ("x", "r5", "n6"), ("y", "r9", "n7"), ("z", "r9", "n7")], "file_path string, raw_hash string, norm_hash string")
    got = {x.file_path: (x.outcome, x.original) for x in dedup.decide(files, known).collect()}
    assert got == {"a": ("index", None), "b": ("duplicate", "a"), "c": ("duplicate", "a"), "d": ("unchanged", None), "e": ("index", None), "f": ("index", None), "g": ("duplicate", "x"), "h": ("duplicate", "y")}


def test_rescan(spark):
    new = spark.createDataFrame([("same", "t1", "h1"), ("touched", "t2", "h1"), ("edited", "t2", "h2"), ("stuck", "t1", "h1"), ("back", "t1", "h1"), ("new", "t", "h")], "file_path string, modified_at string, content_hash string")
    old = spark.createDataFrame([("same", "t1", "h1", "done", False), ("touched", "t1", "h1", "done", False), ("edited", "t1", "h1", "done", False), ("stuck", "t1", "h1", "processing", False), ("back", "t1", "h1", "done", True), ("gone", "t1", "h1", "done", False), ("long gone", "t", "h", "done", True)], "file_path string, modified_at string, content_hash string, process_status string, is_deleted boolean")
    assert dict(map(tuple, sync.rescan(new, old).collect())) == {"edited": "modified", "stuck": "modified", "back": "created", "new": "created", "gone": "deleted"}


def test_failures_and_retries(spark):
    state = spark.createDataFrame([("a", "error", 1, "2020-01-01 00:00:00"), ("b", "error", 2, "2020-01-01 00:00:00"), ("c", "poison", 3, None), ("d", "error", 1, None), ("e", "pending", 0, None)], "file_path string, process_status string, retry_count int, at string").withColumn("at", F.col("at").cast("timestamp"))
    may = lambda now: {x.file_path for x in sync.may_retry(state, F.lit(now).cast("timestamp"), F.col("at")).collect()}
    assert may("2020-01-01 00:00:59") == {"d", "e"} and may("2020-01-01 00:01:00") == {"a", "d", "e"} and may("2020-01-01 00:02:00") == {"a", "b", "d", "e"}
    after = {x.file_path: (x.process_status, x.retry_count) for x in sync.after_failure(state).collect()}
    assert after["a"] == ("error", 2) and after["b"] == ("poison", 3)


def test_ignored(spark):
    paths = {"/x/.git/config": True, "/x/a.md": False, "/x/node_modules/b/c.md": True, "/x/y.tmp": True, "/x/tmp/y.md": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {x.p: x.i for x in df.select("p", sync.ignored(F.col("p"), ["*/.git/*", "*/node_modules/*", "*.tmp"]).alias("i")).collect()}
    assert got == paths


def test_keyed_table(spark, tmp_path):
    table = store.Table(spark, f"file://{tmp_path}/t", ["k"])
    assert table.read() is None
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    table.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    table.delete(spark.createDataFrame([(1,)], "k int"))
    assert sorted(map(tuple, table.read().collect())) == [(2, "c"), (3, "d")]
    table.clear()
    assert table.read().count() == 0 and table.read().columns == ["k", "v"]
    store.append_log(spark.createDataFrame([(1,)], "n int"), f"file://{tmp_path}/log")
    store.append_log(spark.createDataFrame([(2,)], "n int"), f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 2


def test_points_of_documents_indexed_anew(spark):
    old = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 2)], "point_id string, doc_id int")
    new = spark.createDataFrame([("p1", 1)], "point_id string, doc_id int")
    assert sorted(x.point_id for x in store.replace_points(old, new).collect()) == ["p1", "p3"]


@pytest.mark.parametrize("text, want", [('{"a": 1}', {"a": 1}), ('noise\n```json\n{"a": [1]}\n```', {"a": [1]}), ('say {"a": {"b": 2}} end', {"a": {"b": 2}}), ('{"a": "x", "b": [1, 2', {"a": "x", "b": [1, 2]}), ('{"a": "cut of', {"a": "cut of"}), ('{"a": 1, "b": tru', {"a": 1}), ("[1]", None), ("none", None), ('{"a": "q\\"', {"a": 'q"'})])
def test_json_out_of_noise(text, want):
    assert jsontools.extract(text) == want


def test_incomplete_objects_are_dropped():
    assert jsontools.complete([{"a": 1, "b": 2}, {"a": 1}, "x"], {"a", "b"}) == [{"a": 1, "b": 2}]


QUERIES = {"give me an overview": "broad", "what is a ledger": "broad", "where is the config file": "navigational", "error in load_data v1.2": "specific", "find /docs/plan.md": "navigational", "how do the indexing workers handle retry storms": "specific", "": "broad", "budget report": "navigational"}


def test_analysis(spark):
    df = spark.createDataFrame([(q,) for q in QUERIES], "q string")
    assert {x.q: x.classification for x in analysis.analyzed(df, "q").collect()} == QUERIES
    hints = [("notes in folder finance", "finance", None), ("notes from 2025/01", "2025/01", "2025/01"), ("in /a/b since 2024-05-01", "/a/b", "2024-05-01"), ("plain", None, None)]
    got = analysis.analyzed(spark.createDataFrame([(q,) for q, *_ in hints], "q string"), "q").collect()
    assert [(x.q, x.folder_hint, x.date_hint) for x in got] == hints


def test_exact_vectors_in_blocks(spark):
    rng = np.random.default_rng(1)
    q, p = rng.normal(size=(7, 8)), rng.normal(size=(90, 8))
    queries = spark.createDataFrame([(i, i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id bigint, own_doc bigint, vector array<double>")
    points = spark.createDataFrame([(f"p{i:02d}", i % 30, "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(p)], "point_id string, doc_id bigint, lane string, vector array<double>")
    got = {}
    for x in vectors.top_k(queries, points, 4, block=3).orderBy("place").collect():
        got.setdefault((int(x.query_id), x.lane), []).append(x.point_id)
    cos = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T, 6)
    for i in range(7):
        for lane in (0, 1):
            own = [j for j in range(90) if j % 2 == lane and j % 30 != i]
            assert got[i, "ab"[lane]] == [f"p{j:02d}" for j in sorted(own, key=lambda j: (-cos[i, j], j))[:4]]


def test_keyword_lane(spark):
    queries = spark.createDataFrame([(1, -1, "Python programming"), (2, -1, "of"), (3, -1, "programming"), (4, 2, "programming"), (5, -1, None)], "query_id bigint, own_doc bigint, keywords string")
    texts = spark.createDataFrame([("a", 1, "python PROGRAMMING language"), ("b", 2, "programming in go"), ("c", 3, "python the snake"), ("d", 4, None)], "point_id string, doc_id bigint, text string")
    got = sorted((x.query_id, x.point_id) for x in r.keyword_lane(queries, texts, 30).collect())
    assert got == [("1", "a"), ("3", "a"), ("3", "b"), ("4", "a")]


def test_fusion_and_reranking(spark):
    lists = spark.createDataFrame([("1", "x", 1), ("1", "x", 3), ("1", "y", 1)], "query_id string, point_id string, place int")
    assert {x.point_id: x.score for x in r.fused(lists).collect()} == pytest.approx({"x": 1 / 61 + 1 / 63, "y": 1 / 61})
    hits = spark.createDataFrame([("1", "a", 0.1), ("1", "b", 0.2), ("2", "c", 0.05)], "query_id string, point_id string, score double")
    got = {x.point_id: (x.place, x.score) for x in r.reranked(hits, F.when(F.col("point_id") == "a", 2.0).otherwise(0.0), 5).collect()}
    assert got["a"][0] == 1 and got["b"] == (2, 0.5) and got["c"] == (1, 0.05)


def test_context(spark):
    chunks = spark.createDataFrame([(1, i, f"part {i} ends. part {i + 1}", "s0" if i < 2 else "s1") for i in range(5)], "doc_id bigint, chunk_order int, chunk_text string, section_id string")
    hits = spark.createDataFrame([(1, "c", 1, "chunk", 2, "s1", "t"), (1, "d", 1, "document_summary", None, None, "sum"), (1, "s", 1, "section_summary", None, "s0", "sum"), (1, "n", 9, "chunk", 0, "x", "alone")], "query_id bigint, point_id string, doc_id bigint, record_type string, chunk_order int, section_id string, text string")
    got = {x.point_id: x.evidence for x in r.with_context(hits, chunks).collect()}
    assert got["c"] == "part 1 ends. part 2 ends. part 3 ends. part 4" and got["n"] == "alone"
    assert got["d"].startswith("[Summary] sum\n\npart 0 ends.") and got["d"].endswith("part 3") and got["s"] == "[Section Summary] sum\n\npart 0 ends. part 1 ends. part 2"


def test_rerank_texts(spark):
    df = spark.createDataFrame([("chunk", "t", "T", "H"), ("document_summary", "t", "T", None), ("section_summary", "t", "T", "H"), ("section_summary", "t", None, None)], "k string, x string, title string, h string")
    assert [y.v for y in df.select(r.rerank_text(F.col("k"), F.col("x"), F.col("title"), F.col("h")).alias("v")).collect()] == ["t", "T\nt", "T | H\nt", "t"]


def test_summaries(spark):
    docs = spark.createDataFrame([(1, "one two  three"), (2, None)], "doc_id bigint, text string")
    got = {x.doc_id: x.summary_8w for x in summaries.extractive(docs, "text", (8,)).collect()}
    assert got[1] == "one two three" and not got[2]
    made = summaries.generated(docs, "doc_id", "text", lambda xs: [x.upper() or None for x in xs])
    assert {x.doc_id: x.summary for x in summaries.with_fallback(docs, made, "doc_id", "text").collect()}[1] == "ONE TWO  THREE"
    p = summaries.prompt(docs.where("doc_id = 1").withColumn("i", F.lit(0)), "doc_id", ["i"], F.lit("Section 1"), "text").head().prompt
    assert p == "--- Section 1 ---\none two  three"
