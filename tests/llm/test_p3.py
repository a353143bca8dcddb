import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm.p3_split import SplitParams, oversized, split, split_text

SMALL = SplitParams(max_words=12, max_chars=80, overlap_words=3, overlap_chars=20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", "longer-word", ".", "\n", "\n\n", " ", "  ", "x" * 50, "é", ",", "\xa0", "## H"]), max_size=120))
def test_pieces_give_the_text_and_keep_the_limits(parts):
    text = "".join(parts)
    pieces = split_text(text, SMALL)
    assert "".join(text[a:b] for _, a, b in pieces) == text
    for i, (start, own, end) in enumerate(pieces):
        assert end - start <= SMALL.max_chars and len(text[start:end].split()) <= SMALL.max_words
        assert start == own or (i and pieces[i - 1][1] <= start)


def test_cuts_at_the_strongest_boundary_near_the_middle():
    text = "one two three four five six. seven eight\n\nnine ten eleven. twelve thirteen fourteen"
    pieces = split_text(text, SMALL)
    assert text[pieces[0][1] : pieces[0][2]].endswith("eight\n\n")
    assert text[pieces[1][0] : pieces[1][1]].split() == ["six.", "seven", "eight"]


def test_words_without_blanks_are_cut_hard():
    pieces = split_text("x" * 500, SMALL)
    assert len(pieces) > 6 and all(b - a <= 60 for _, a, b in pieces)


@pytest.mark.parametrize("text", ["漢" * 6000, "x" * 7000, ("x" * 400 + " ") * 20, "e\u0301" * 4000])
def test_text_without_blanks_overlaps_too(text):
    pieces = split_text(text)
    assert all(0 < own - start <= 320 for start, own, _ in pieces[1:]) and all(end - start <= 3000 for start, _, end in pieces)


def test_an_overlap_without_blanks_begins_after_a_sentence():
    text = ("漢" * 99 + "。") * 60
    assert all(text[start - 1] == "。" for start, _, _ in split_text(text)[1:])


@pytest.mark.parametrize("words, chars, found", [(320, 1, False), (321, 1, True), (10, 3000, False), (10, 3001, True)])
def test_limits(spark, words, chars, found):
    text = " ".join(["w"] * words)
    text += "y" * max(0, chars - len(text))
    df = spark.createDataFrame([("chunk", "a", text)], "record_kind string, record_id string, text string")
    assert bool(oversized(df).count()) is found


def test_rows_that_give_nothing_and_rows_given_twice(spark):
    long = "word " * 400
    rows = [("chunk", "a", long), ("chunk", "a", long), ("section", "a", long), ("chunk", None, long), ("chunk", "n", None), ("chunk", "e", ""), ("chunk", "v", "word. " * 200_000)]
    df = spark.createDataFrame(rows, "record_kind string, record_id string, text string").withColumns({"piece": F.lit(1), "start": F.lit("x")})
    assert sorted(map(tuple, oversized(df).collect())) == [("chunk", "a"), ("chunk", "v"), ("section", "a")]
    assert split(df.limit(0)).count() == 0
    assert split(df).groupBy("record_kind", "record_id", "piece").count().where("count > 1").count() == 0
