"""Summaries in steps of length: a generator that can be plugged in, and an extractive one that needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as t

LENGTHS = (8, 16, 32, 64, 128)


def extractive(rows: DataFrame, text: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """``rows`` with ``summary_{n}w``: the first n words; null for null texts."""
    words = F.filter(F.split(F.regexp_replace(text, "\\s+", " "), " "), lambda w: w != "")
    return rows.withColumns({f"summary_{n}w": F.array_join(F.slice(words, 1, n), " ") for n in lengths})


def generated(rows: DataFrame, key: str, text: str, generate: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """``(key, generated)`` from a plugged-in generator, called with the texts of a batch; null where it gives None, for the whole batch if it fails."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text].fillna("").str.slice(0, t.MAX_EXCERPT).tolist()
            try:
                found = list(generate(texts))
            except Exception:  # noqa: BLE001  a generator may fail in any way
                found = [None] * len(texts)
            yield pd.DataFrame({key: batch[key], "generated": pd.Series(found, dtype=object).to_numpy()})

    return rows.select(key, text).mapInPandas(each, f"{key} {dict(rows.dtypes)[key]}, generated string")


def with_fallback(rows: DataFrame, first: DataFrame, key: str, text: str, words: int = 128) -> DataFrame:
    """``rows`` with ``summary``: what was generated, else the first words."""
    return extractive(rows, text, (words,)).join(first, key, "left").withColumn("summary", F.coalesce("generated", f"summary_{words}w")).drop("generated", f"summary_{words}w")


def summary_points(documents: DataFrame, sections: DataFrame, generate: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """``(point_id, doc_id, record_type, text)``: a point for each document and one for each section that is not blank.

    A section's id follows from its place among the document's sections that are not blank, not from its order. With
    ``generate`` the texts are what it makes of batches of texts; where it gives None or fails, the first words.
    """

    def shown(rows: DataFrame, key: str) -> DataFrame:
        if generate is None:
            return extractive(rows, "text", (128,))
        return with_fallback(rows, generated(rows, key, "text", generate), key, "text").withColumnRenamed("summary", "summary_128w")

    docs = shown(documents, "doc_id")
    name = lambda *parts: t.uuid5(F.concat_ws(":", *parts))
    docs = docs.select(name(F.col("doc_id").cast("string"), F.lit("document_summary")).alias("point_id"), "doc_id", F.lit("document_summary").alias("record_type"), F.col("summary_128w").alias("text"))
    full = shown(sections.where(t.normalize_text(F.col("text")) != ""), "section_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_order", "section_id")) - 1
    full = full.withColumn("i", place)
    return docs.unionByName(full.select(name(F.col("doc_id").cast("string"), F.lit("section_summary"), F.col("i").cast("string")).alias("point_id"), "doc_id", F.lit("section_summary").alias("record_type"), F.col("summary_128w").alias("text")))


def prompt(rows: DataFrame, group: str, order: list[str], label, text: str) -> DataFrame:
    """``(group, prompt)``: excerpts one below the other, each under its label between dashes."""
    part = F.concat(F.lit("--- "), label, F.lit(" ---\n"), F.substring(text, 1, t.MAX_EXCERPT))
    parts = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, part.alias("p")))).alias("x"))
    return parts.select(group, F.array_join(F.transform("x", lambda s: s["p"]), "\n\n").alias("prompt"))


def questions(rows: DataFrame, key: str, text: str, ask: Callable[[list[str]], list[list[str] | None]]) -> DataFrame:
    """``(key, questions)``: what each text answers, from a plugged-in generator called with the texts of a batch.

    Null where it gives None, gives as many answers as it was not asked for, or fails.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text].fillna("").tolist()
            try:
                found = list(ask(texts))
            except Exception:  # noqa: BLE001  a generator may fail in any way
                found = []
            found = found if len(found) == len(texts) else [None] * len(texts)
            yield pd.DataFrame({key: batch[key], "questions": pd.Series(found, dtype=object)})

    return rows.select(key, text).mapInPandas(each, f"{key} {dict(rows.dtypes)[key]}, questions array<string>")
