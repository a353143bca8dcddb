"""Files as tables: scans of folders, text and Markdown, and parsers that can be plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators.sync import ignored
from folioscope.plans.materialize import broadcast_if_small


def _files(spark: SparkSession, places: list[str], patterns: list[str]) -> DataFrame:
    """Supported files below or at ``places`` with their ``content``, which is read only where it is used."""
    there = [p for p in places if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "file_path string, folder_path string, file_type string, size_bytes bigint, modified_at timestamp, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(there)
    rows = files.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    rows = rows.withColumns({"file_type": t.file_type(F.col("file_path")), "folder_path": F.regexp_replace("file_path", "/[^/]*$", "")})
    return rows.where(F.col("file_type").isNotNull() & ~ignored(F.col("file_path"), patterns)).select("file_path", "folder_path", "file_type", "size_bytes", "modified_at", "content")


def listing(spark: SparkSession, folders: list[str], patterns: list[str] | None = None) -> DataFrame:
    """``(file_path, folder_path, file_type, size_bytes, modified_at)`` of supported files below ``folders``; contents are not read.

    Folders that do not exist are passed over.
    """
    return _files(spark, folders, patterns or []).drop("content")


def _exists(spark: SparkSession, folder: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def scan(spark: SparkSession, folders: list[str], patterns: list[str] | None = None, only: DataFrame | None = None, few: int = 10_000) -> DataFrame:
    """:func:`listing` with ``content`` and ``content_hash``, every file as a created event.

    With ``only(file_path)`` just these files: if they are ``few`` at most, they alone are listed and read; of more, all
    files are gone through. Contents come from the scan that lists them and are not shuffled.
    """
    if only is None:
        rows = _files(spark, folders, patterns or [])
    else:
        wanted = only.select("file_path").limit(few + 1).collect()
        if len(wanted) <= few:
            rows = _files(spark, [r.file_path for r in wanted], patterns or [])
        else:
            rows = _files(spark, folders, patterns or []).join(broadcast_if_small(only.select("file_path")), "file_path", "left_semi")
    return rows.withColumns({"content_hash": F.sha2("content", 256), "event_type": F.lit("created")})


def texts(files: DataFrame) -> DataFrame:
    """``files(content)`` with ``text`` and ``error``: UTF-8, else Latin-1; blank contents are errors."""
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.withColumn("text", text).withColumn("error", F.when(F.col("text").isNull() | (F.regexp_replace("text", "\\s", "") == ""), "no text"))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """``(doc_id, section_order, heading, text)`` of ``docs(doc_id, text)``.

    A heading is a line of one to six hash marks, blanks and a text; what stands before the first is a section
    without heading. A document without headings is one section; orders count from 0; sections that have neither
    heading nor text are left out.
    """
    rx = "^#{1,6}[\\t\\f\\x0b ]+\\S"
    blank = "[ \\t\\n\\r]"
    lines = F.split("text", "\n")
    heads = F.filter(F.transform(lines, lambda x, i: F.when(F.rlike(x, F.lit(rx)), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.concat(F.array(F.lit(0)), heads))
    rows = docs.where("text is not null").select("doc_id", lines.alias("lines"), starts.alias("starts"))
    rows = rows.select("doc_id", "lines", "starts", F.posexplode("starts").alias("k", "a"))
    end = F.coalesce(F.get("starts", F.col("k") + 1), F.size("lines"))
    first = F.get("lines", F.col("a"))
    headed = F.rlike(first, F.lit(rx))
    heading = F.when(headed, F.regexp_replace(F.regexp_replace(first, "^#{1,6}[\\t\\f\\x0b ]+", ""), f"^{blank}+|{blank}+$", ""))
    begin = F.col("a") + headed.cast("int")
    body = F.array_join(F.slice("lines", begin + 1, end - begin), "\n")
    rows = rows.select("doc_id", "k", heading.alias("heading"), F.regexp_replace(body, f"^{blank}+|{blank}+$", "").alias("text")).where("heading is not null or text <> ''")
    kept = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "heading", "text"))).alias("s"))
    return kept.select("doc_id", F.posexplode("s").alias("section_order", "x")).select("doc_id", "section_order", "x.heading", "x.text")


def items_to_sections(items: DataFrame) -> DataFrame:
    """``(doc_id, section_order, heading, text, page_start, page_end)`` of parsed ``items(doc_id, n, label, text, page)``.

    Every item whose label speaks of a heading starts a section; the texts of the others are joined by newlines.
    """
    from pyspark.sql import Window

    head = F.contains(F.lower("label"), F.lit("head"))
    w = Window.partitionBy("doc_id").orderBy("n")
    rows = items.withColumns({"part": F.sum(head.cast("int")).over(w), "head": head})
    rows = rows.groupBy("doc_id", "part").agg(F.max(F.when(F.col("head"), F.col("text"))).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("n", "text")))).alias("x"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return rows.select("doc_id", order.alias("section_order"), "heading", F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("text"), "page_start", "page_end")


def parsed(files: DataFrame, parse: Callable[[str, bytes], list[tuple]], kinds: list[str], seconds: Column | None = None) -> DataFrame:
    """``(file_path, n, label, text, page)`` from a plugged-in parser for files of the types ``kinds``.

    A failure gives a row of label ``error``, and so does a file that takes longer than ``seconds``, by default
    :func:`functions.text.parse_timeout` of its size; its thread is left behind.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, limit in zip(batch.file_path, batch.content, batch.seconds, strict=True):
                pool = ThreadPoolExecutor(1)
                try:
                    rows += [(path, n, *item) for n, item in enumerate(pool.submit(lambda p=path, c=content: list(parse(p, c))).result(float(limit)))]
                except TimeoutError:
                    rows.append((path, 0, "error", f"parsing took more than {limit:g} seconds", None))
                except Exception as e:  # noqa: BLE001  a parser may fail in any way
                    rows.append((path, 0, "error", str(e), None))
                pool.shutdown(wait=False, cancel_futures=True)
            yield pd.DataFrame(rows, columns=["file_path", "n", "label", "text", "page"]).astype({"page": "Int32"})

    limit = t.parse_timeout(F.col("size_bytes")) if seconds is None else seconds
    return files.where(F.col("file_type").isin(*kinds)).select("file_path", "content", limit.cast("double").alias("seconds")).mapInPandas(each, "file_path string, n int, label string, text string, page int")
