import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import scores as sc
from folioscope.functions import text as t
from folioscope.operators.embedding import embedded, hash_vectors, sparse_hash


def value(spark, column, **cells):
    names = list(cells) or ["x"]
    df = spark.createDataFrame([tuple(cells.values()) or (1,)], ", ".join(f"{n} {'array<string>' if isinstance(cells.get(n), list) else 'string' if isinstance(cells.get(n), str) or cells.get(n) is None else 'double' if isinstance(cells[n], float) else 'bigint'}" for n in names))
    return df.select(column.alias("v")).head().v


@pytest.mark.parametrize("text, want", [("a\0b", "ab"), ("a\n\n\n\nb", "a\n\nb"), ("a \t  b", "a b"), ("a  \nb ", "a\nb"), (" \n ", ""), ("a\r\nb", "a\nb"), (None, None), ("", "")])
def test_normalize(spark, text, want):
    assert value(spark, t.normalize_text(F.col("x")), x=text) == want


def test_uuid5(spark):
    ns = uuid.UUID(t.NAMESPACE_HEX)
    for name in ("1:0:0", "doc:section:3", "é", ""):
        assert value(spark, t.uuid5(F.col("x")), x=name) == str(uuid.uuid5(ns, name))


def test_sentences(spark):
    assert value(spark, t.sentences(F.col("x")), x="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert value(spark, t.sentences(F.col("x")), x="  ") == []
    seg = lambda s: value(spark, t.segment_sentences(F.col("x")), x=s)
    assert seg("Dr. Smith came. He left.") == ["Dr. Smith came.", "He left."]
    assert seg("See 3. Then go. “Quoted” text. lower stays") == ["See 3. Then go.", "“Quoted” text. lower stays"]
    assert seg("as in e.g. Paris it rains") == ["as in e.g.", "Paris it rains"]  # the part after the last inner dot alone is looked up
    assert seg("") == []


def test_labels(spark):
    label = t.citation_label(F.col("n"), F.col("h"), F.col("a"), F.col("b"))
    assert value(spark, label, n="f.pdf", h="Intro", a=12, b=14) == "f.pdf, § Intro, pp. 12-14"
    assert value(spark, label, n="f.pdf", h="", a=3, b=3) == "f.pdf, p. 3"
    assert value(spark, label.cast("string"), n="f.pdf", h=None, a=5, b=5) == "f.pdf, p. 5"


def test_paths(spark):
    assert value(spark, t.folder_ancestors(F.col("x")), x="/a/b") == ["/", "/a", "/a/b"] and value(spark, t.folder_ancestors(F.col("x")), x="/") == ["/"]
    for path, kind in (("/a/B.PDF", "pdf"), ("/a/x.tar.md", "md"), ("/a.b/x", None), ("/a/.md", None), ("/a/x.log", None)):
        assert value(spark, t.file_type(F.col("x")), x=path) == kind
    assert value(spark, t.truncate(F.col("x"), 8), x="123456789") == "12345..." and value(spark, t.fit_name(F.col("x"), 4), x="ab") == "ab  " and value(spark, t.fit_name(F.col("x"), 4), x="abcde") == "abc…"


def test_sizes_and_times(spark):
    assert [value(spark, t.size_text(F.col("x")), x=n) for n in (0, 1023, 1536, 5 * 1024**2, 3 * 1024**4)] == ["0.0 B", "1023.0 B", "1.5 KB", "5.0 MB", "3.0 TB"]
    ago = lambda s: value(spark, t.time_ago(F.lit("2020-01-10 00:00:00").cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(s)), F.lit("2020-01-10 00:00:00").cast("timestamp")))
    assert [ago(s) for s in (5, 120, 7200, 200_000)] == ["just now", "2m ago", "2h ago", "2d ago"]
    assert [value(spark, t.parse_timeout(F.col("x")), x=n) for n in (0, 1024**2, 100 * 1024**2)] == [60, 90, 600]
    iso = lambda s: value(spark, F.date_format(t.iso_time(F.col("x")), "yyyy-MM-dd HH:mm"), x=s)
    assert iso("2020-01-02") == "2020-01-02 00:00" and iso("2020-01-02T03:04:05+01:00") == "2020-01-02 02:04" and iso("2020-01-02T03:04:05Z") == "2020-01-02 03:04"
    assert iso("21/12/2019 22:01") is None and iso("n/a") is None and iso(None) is None


def test_overlaps_are_merged(spark):
    merged = lambda *x: value(spark, t.merge_overlapping(F.col("x")), x=list(x))
    assert merged("one two three", "two three four", "five") == "one two three four\n\nfive"
    assert merged("a") == "a" and merged() == ""
    assert merged("abc" * 300, "abc" * 300) == "abc" * 300 + "abc" * 134  # at most 500 characters are compared: 498 of them match


def test_code_blocks(spark):
    text = "a\n```x\n1$1\n```\nb ```y``` c"
    assert value(spark, t.code_blocks(F.col("x")), x=text) == ["```x\n1$1\n```", "```y```"]
    assert value(spark, t.without_code_blocks(F.col("x")), x=text) == "a\n\0CODE_BLOCK_0\0\nb \0CODE_BLOCK_1\0 c"
    assert value(spark, t.with_code_blocks(t.without_code_blocks(F.col("x")), t.code_blocks(F.col("x"))), x=text) == text


def test_clean_output_and_questions(spark):
    assert value(spark, t.clean_output(F.col("x")), x="\x1b[31m> hi\x1b[0m\n```json\n{}\n```") == "hi\n{}"
    assert value(spark, t.augmented_text(F.col("x"), F.array(F.lit("q1"), F.lit("q2"))), x="t") == "Questions this content answers:\n- q1\n- q2\n\nt"


def test_scores(spark):
    now = F.lit("2020-06-30 00:00:00").cast("timestamp")
    factor = lambda days: value(spark, sc.recency_factor(now - F.make_dt_interval(F.lit(days)), now))
    assert [factor(d) for d in (0, 90, 180, -5)] == pytest.approx([1.15, 1.075, 1.0375, 1.15])
    assert value(spark, sc.recency_factor(F.lit(None).cast("timestamp"), now)) == 1
    assert value(spark, sc.rrf_share(F.lit(1)) + sc.rrf_share(F.lit(2))) == pytest.approx(1 / 61 + 1 / 62)
    w = lambda c, r: value(spark, sc.layer_weight(F.lit(c), F.lit(r)))
    assert w("broad", "document_summary") == 1.5 and w("odd", "document_summary") == 0.7 and w("broad", "odd") == 1.0
    assert value(spark, sc.sigmoid(F.lit(0.0))) == 0.5
    assert value(spark, sc.boundary_threshold(F.lit(0.35), F.lit(15), F.lit(15))) == pytest.approx(0.675)
    assert value(spark, sc.dot(sc.unit(F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(1.0), F.lit(0.0)))) == pytest.approx(0.6)


def test_hash_vectors(spark):
    df = spark.createDataFrame([(1, "The the cat"), (2, ""), (3, None)], "id int, text string")
    rows = {r.id: r.vector for r in embedded(df, "text", lambda: hash_vectors).collect()}
    assert rows[3] is None and not any(rows[2]) and math.isclose(sum(x * x for x in rows[1]), 1, rel_tol=1e-6)
    sparse = {r.place: r.weight for r in sparse_hash(df.where("id = 1"), "id", "text").collect()}
    dense = hash_vectors(["The the cat"])[0]
    assert sparse == pytest.approx({int(i): dense[i] for i in np.flatnonzero(dense)})
