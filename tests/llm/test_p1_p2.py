"""The similarity joins against brute force, with nulls, empty and very long texts, copies, hot lists and empty tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import p1_history, p2_near, simjoin
from folioscope.llm.shingles import minhash, shingles

WORDS = [f"w{i}" for i in range(400)]


def sets(text, k=3):
    w = re.findall(r"\w+", (text or "").replace("\0", "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def similarity(a, b, k=3):
    a, b = sets(a, k), sets(b, k)
    return len(a & b) / len(a | b) if a | b else 0.0


def groups(rows, threshold=0.6, k=3):
    """{id: first} by comparing all pairs; rows are (id, text) in order."""
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if similarity(a, b, k) >= threshold:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    members = defaultdict(list)
    for i, _ in rows:
        members[top(i)].append(i)
    return {(min(m), i) for m in members.values() for i in m if i != min(m)}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = rng.choice(WORDS)
        elif kind < 0.7:
            words.insert(at, rng.choice(WORDS))
        elif len(words) > 4:
            del words[at]
    return words


def corpus(seed, n=60):
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = [rng.choice(WORDS[:60] if rng.random() < 0.3 else WORDS) for _ in range(rng.randrange(5, 60))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            out.append(" ".join(edited(rng, base, rng.randrange(0, 9))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, seed):
    texts = corpus(seed)
    texts += [None, "", "one two", "one two", texts[0].upper() + ".", texts[0].replace(" ", "\n  "), texts[3] + "\0", "x y z " * 4000, "x y z " * 4000 + " end"]
    rows = [(i + 1, t, i // 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, text string, ingest_batch int").withColumns({"x": F.lit(1), "first_id": F.lit("a"), "token": F.lit(0)})
    got = {tuple(r) for r in simjoin.near_duplicate_groups(df, ["ingest_batch"], p1_history.NEAR).select("first_id", "id").collect()}
    assert got == groups([(i, t) for i, t, _ in rows])


def test_hot_lists_lose_no_link(spark):
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(40)]
    texts = [" ".join(edited(rng, base, rng.randrange(1, 6))) for _ in range(80)] + corpus(9, 15)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "id bigint, text string")
    p = simjoin.JoinParams(shingle=3, threshold=0.6, hot=8)
    got = {tuple(r) for r in simjoin.near_duplicate_groups(df, [], p).select("first_id", "id").collect()}
    assert got == groups(rows)


def test_default_is_five_words_and_point_eight(spark):
    texts = corpus(4, 25)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {tuple(r) for r in simjoin.near_duplicate_groups(df, [], simjoin.JoinParams()).select("first_id", "id").collect()}
    assert got == groups(list(enumerate(texts)), 0.8, 5)


def test_no_rows_and_null_ids(spark):
    df = spark.createDataFrame([], "id bigint, text string, ingest_batch int")
    assert simjoin.near_duplicate_groups(df, ["ingest_batch"], p1_history.NEAR).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "a b c d")], "id bigint, text string")
    assert simjoin.near_duplicate_groups(df, [], p1_history.NEAR).count() == 0


def test_a_repeated_row_counts_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "id bigint, text string")
    assert [tuple(r) for r in simjoin.near_duplicate_groups(df, [], p1_history.NEAR).select("first_id", "id").collect()] == [(1, 2)]


def fold(spark, path, rows, cut, **kw):
    """The index after batches of ``cut`` rows each, with the numbers of the batches."""
    df = spark.createDataFrame([(i, t, n // cut) for n, (i, t) in enumerate(rows)], "id bigint, text string, batch int").withColumns({"n": F.lit(1), "token": F.lit("x"), "part": F.lit(0)})
    index = p1_history.HistoryIndex(spark, f"file://{path}/index", **{"buckets": 4} | kw).start(df.where("batch = 0"))
    for k in range(-(-len(rows) // cut)):
        index.add(df.where(F.col("batch") == k))
    return index, df


def first_of_groups(index, df):
    return {tuple(r) for r in simjoin.firsts(index.links().select("a", "b"), df, []).select("first_id", "id").collect()}


def test_batches_find_what_all_pairs_find(spark, tmp_path):
    texts = corpus(7, 40)
    texts += [None, "", "one two", "one two", texts[0], texts[1].replace(" ", "\n  "), "x y z " * 4000, "x y z " * 4000 + " end", texts[3] + "\0"]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    index, df = fold(spark, tmp_path, rows, 25, most=60)  # the postings of a batch go by slices
    assert first_of_groups(index, df) == groups(rows)
    # every link has its later end in the batch that found it
    assert index.links().where("a <= b").count() == 0


def test_hot_lists_of_an_index_lose_no_link(spark, tmp_path):
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(40)]
    texts = [" ".join(edited(rng, base, rng.randrange(1, 6))) for _ in range(70)] + corpus(9, 15)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    index, df = fold(spark, tmp_path, rows, 40, p=simjoin.JoinParams(shingle=3, threshold=0.6, hot=3))
    assert first_of_groups(index, df) == groups(rows)


def test_an_index_in_a_new_order_finds_the_same(spark, tmp_path):
    rows = [(i + 1, t) for i, t in enumerate(corpus(8, 30))]
    index, df = fold(spark, tmp_path, rows[:40], 20)
    new = index.reordered(f"file://{tmp_path}/new", df)
    rest = spark.createDataFrame(rows[40:], "id bigint, text string")
    found = []
    for i in (index, new):
        number = i.add(rest)
        found.append({tuple(r) for r in i.duplicates(number).collect()})
    want = {i: f for f, i in groups(rows)}
    assert found[0] == found[1] == {(i, want[i], "near_text") for i, _ in rows[40:] if i in want}


def test_an_empty_index_and_null_ids(spark, tmp_path):
    empty = spark.createDataFrame([], "id bigint, text string")
    index = p1_history.HistoryIndex(spark, f"file://{tmp_path}/index", buckets=4).start(empty)
    assert index.duplicates(index.add(empty)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (4, "A b, c d"), (5, "a b c d"), (6, None)], "id bigint, text string")
    assert {tuple(r) for r in index.duplicates(index.add(rows)).collect()} == {(4, 3, "near_text"), (5, 3, "near_text")}


def test_hashes_link_documents_to_the_first_of_their_group(spark, tmp_path):
    old = " ".join(WORDS[:20])
    rows = [(1, old, "a"), (5, old + " more", "b"), (6, "scanned otherwise entirely", "b"), (7, "alone here now", "c"), (8, old + " again", "b")]
    docs = spark.createDataFrame([(i, t, h * 64) for i, t, h in rows], "doc_id bigint, text string, raw_content_hash string")
    docs = docs.withColumn("normalized_content_hash", F.when(F.col("doc_id") == 7, F.lit(p1_history.EMPTY_FILE)))
    index = p1_history.HistoryIndex(spark, f"file://{tmp_path}/index", buckets=4)
    history, batch = p1_history.batch_rows(docs.where("doc_id = 1")), p1_history.batch_rows(docs.where("doc_id > 1"))
    index.start(history).add(history)
    assert {tuple(r) for r in index.duplicates(index.add(batch)).collect()} == {(5, 1, "near_text"), (6, 1, "raw_hash"), (8, 1, "raw_hash")}
    again = p1_history.batch_rows(docs.where("doc_id = 6").withColumn("doc_id", F.lit(9).cast("long")).withColumn("raw_content_hash", F.concat(F.lit("SHA256:"), F.upper("raw_content_hash"))))
    assert [tuple(r) for r in index.duplicates(index.add(again)).collect()] == [(9, 1, "raw_hash")]


def test_the_order_is_kept_packed(spark, tmp_path):
    index, _ = fold(spark, tmp_path, [(1, "a b c d"), (2, "a b c d e")], 2)
    again = p1_history.HistoryIndex(spark, index.path, buckets=4)  # as a later session opens it
    assert index.levels.value.any() and np.array_equal(again.levels.value, index.levels.value)
    assert len(spark.read.parquet(f"{index.path}/levels").head()[0]) < 1_000_000  # of 16 MB


def test_a_batch_costs_few_jobs(spark, tmp_path):
    """The plans of a job stay in the driver's memory; counts of what is written come with the writing."""
    rows = [(i + 1, t) for i, t in enumerate(corpus(6, 20))]
    index, df = fold(spark, tmp_path, rows[:20], 20)
    next_job = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    start = next_job()
    index.add(spark.createDataFrame(rows[20:], "id bigint, text string"))
    added = next_job()
    assert added - start <= 22
    alone = index.add(spark.createDataFrame([(999, " ".join(f"z{i}" for i in range(30)))], "id bigint, text string"))
    assert next_job() - added <= 10 and index.links(alone).count() == 0
    assert first_of_groups(index, spark.createDataFrame(rows, "id bigint, text string")) == groups(rows)


def test_slices_hold_every_bucket_once():
    assert p1_history.slices({3: 5, 1: 4, 2: 6, 9: 20}, 10) == [[1, 2], [3], [9]] and p1_history.slices({}, 10) == []


def test_records_within_their_kind(spark):
    texts = [t for t in corpus(11, 40) if len(t.split()) >= 20]
    rows = [("chunk" if i % 2 else "section", f"r{i}", t) for i, t in enumerate(texts)]
    rows += [("chunk", "short", "a b c d"), ("section", "none", None), ("chunk", None, texts[0]), ("chunk", "r1", texts[1]), ("chunk", "zz", texts[1])]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, text string").withColumn("id", F.lit("clash"))
    got = {tuple(r) for r in p2_near.near_groups(df).select("record_kind", "first_id", "other_id").collect()}
    want = set()
    for kind in ("chunk", "section"):
        own = sorted({(i, t) for k, i, t in rows if k == kind and i and t and len(t.split()) >= 20})
        want |= {(kind, a, b) for a, b in groups(own)}
    assert got == want


def test_bayesian_bounds():
    least = [p2_near.least_matches(n, 0.6, 1e-5) for n in (16, 32, 64, 128)]
    assert least == sorted(least) and least[-1] < 0.6 * 128
    assert p2_near.least_matches(128, 0.6, 1e-2) > least[-1]


def test_minhash_agrees_as_often_as_sets():
    texts = corpus(3, 30)
    sig = minhash(texts, 3, 256)
    for i in range(0, len(texts) - 1, 5):
        s = similarity(texts[i], texts[i + 1])
        assert abs((sig[i] == sig[i + 1]).mean() - (s + (1 - s) / 256)) < 0.13
    assert not minhash(["a b", None], 3, 8).any()


def test_shingles_are_sets_by_text():
    of, s, n = shingles(["a b c a b c", "", None, "A\0 b  c"], 3)
    assert n.tolist() == [3, 0, 0, 1] and len(s) == 4 and s[3] in s[:3] and np.all(np.diff(of.astype(int)) >= 0)
