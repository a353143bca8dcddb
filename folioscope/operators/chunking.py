"""Texts into chunks: greedy packing of sentences, and boundaries where the topic changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as t

TARGET_TOKENS, OVERLAP_TOKENS = 512, 64
MIN_TOKENS, MAX_TOKENS = 64, 768


def packed(sentences: Column, tokens: Column, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """``array<struct<text, tokens>>``: sentences filled into chunks of ``target`` tokens, in one ordered fold.

    A chunk takes whole sentences as long as they fit and starts with as many last sentences of the chunk before as
    fit into ``overlap`` tokens. A sentence above the target stands alone if nothing waits before it. All but the last
    chunk record the sum of their sentences' tokens; the last one is counted anew by :func:`functions.text.count_tokens`.
    """
    kind = "struct<done:array<struct<text:string,tokens:int>>,held:array<string>,sizes:array<int>>"
    none = F.struct(F.array().alias("done"), F.array().alias("held"), F.array().alias("sizes")).cast(kind)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    chunk = lambda text, n: F.array(F.struct(text.alias("text"), n.cast("int").alias("tokens")))

    def state(done: Column, held: Column, sizes: Column) -> Column:
        return F.struct(done.alias("done"), held.alias("held"), sizes.alias("sizes")).cast(kind)

    def add(s: Column, x: Column) -> Column:
        waiting, n = F.size(s["held"]) > 0, x["n"]
        full = waiting & (total(s["sizes"]) + n > target)
        # the longest tail within the overlap: sums of tails only grow with their length
        tails = F.sequence(F.lit(1), F.size(s["held"]))
        kept = F.size(F.filter(tails, lambda k: total(F.slice(s["sizes"], -k, k)) <= overlap))
        tail = lambda a: F.when(kept > 0, F.slice(a, -F.greatest(kept, F.lit(1)), kept)).otherwise(F.slice(a, 1, 0))
        flushed = state(F.concat(s["done"], chunk(F.array_join(s["held"], " "), total(s["sizes"]))), F.concat(tail(s["held"]), F.array(x["s"])), F.concat(tail(s["sizes"]), F.array(n)))
        alone = state(F.concat(s["done"], chunk(x["s"], n)), s["held"], s["sizes"])
        more = state(s["done"], F.concat(s["held"], F.array(x["s"])), F.concat(s["sizes"], F.array(n)))
        return F.when(full, flushed).when(~waiting & (n > target), alone).otherwise(more)

    def finish(s: Column) -> Column:
        rest = F.array_join(s["held"], " ")
        return F.when(F.size(s["held"]) > 0, F.concat(s["done"], chunk(rest, t.count_tokens(rest)))).otherwise(s["done"])

    return F.aggregate(F.arrays_zip(sentences.alias("s"), tokens.alias("n")), none, add, finish)


def fixed_chunks(sections: DataFrame, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """``(doc_id, section_id, section_order, chunk_idx, chunk_order, chunk_id, chunk_text, chunk_text_normalized, token_count)``.

    ``sections(doc_id, section_id, section_order, text)``, each section by itself; null and blank texts have no chunk.
    Ids follow from document, section order and place, so that chunking again gives the same ids.
    """
    s = sections.select("doc_id", "section_id", "section_order", t.sentences(F.col("text")).alias("s"))
    s = s.withColumn("n", F.transform("s", t.count_tokens))
    rows = s.select("doc_id", "section_id", "section_order", F.posexplode(packed(F.col("s"), F.col("n"), target, overlap)).alias("chunk_idx", "c"))
    return _numbered(rows.select("doc_id", "section_id", "section_order", "chunk_idx", F.col("c.text").alias("chunk_text"), F.col("c.tokens").alias("token_count")))


def _numbered(rows: DataFrame) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_order", "section_id", "chunk_idx")) - 1
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("section_order").cast("string"), F.col("chunk_idx").cast("string"))
    return rows.withColumns({"chunk_order": order, "chunk_id": t.uuid5(key), "chunk_text_normalized": F.lower("chunk_text")})


def boundaries(vectors: np.ndarray, threshold: float, most: int) -> list[int]:
    """Places of the sentences that start a chunk: the first, and each whose best similarity to the chunk so far is
    below a threshold that rises from ``threshold`` to 1 as the chunk grows past ``most`` sentences."""
    if not len(vectors):
        return []
    starts = [0]
    for i in range(1, len(vectors)):
        pressure = 1 / (1 + np.exp(-((i - starts[-1]) - most) / 2))
        if (vectors[starts[-1] : i] @ vectors[i]).max() < threshold + (1 - threshold) * pressure:
            starts.append(i)
    return starts


def merged_small(groups: list[list[str]], count: Callable[[str], int], least: int = MIN_TOKENS) -> list[list[str]]:
    """Groups of fewer than ``least`` tokens joined to the one before, a small first one to the one after."""
    out: list[list[str]] = []
    for g in groups:
        if out and count(" ".join(g)) < least:
            out[-1] = out[-1] + g
        else:
            out.append(list(g))
    if len(out) > 1 and count(" ".join(out[0])) < least:
        out[:2] = [out[0] + out[1]]
    return out


def split_large(groups: list[list[str]], count: Callable[[str], int], most: int = MAX_TOKENS) -> list[list[str]]:
    """Groups above ``most`` tokens cut once, at the middle sentence."""
    out = []
    for g in groups:
        cut = len(g) // 2 if len(g) > 1 and count(" ".join(g)) > most else 0
        out += [g[:cut], g[cut:]] if cut else [g]
    return out


def semantic_chunks(sections: DataFrame, embed: Callable[[list[str]], np.ndarray], threshold: float = 0.35, most: int = 15, count: Callable[[str], int] | None = None, calls: int = 128) -> DataFrame:
    """The columns of :func:`fixed_chunks`, with chunks that end where the topic changes.

    ``embed`` gives unit vectors of sentences, ``calls`` of them at a time whatever sections they are from; fewer than
    three sentences are one chunk. Fenced code blocks are kept whole: placeholders stand for them while sentences are cut.
    """
    count = count or word_count
    s = sections.where("text is not null").select("doc_id", "section_id", "section_order", t.code_blocks(F.col("text")).alias("blocks"), t.segment_sentences(t.without_code_blocks(F.col("text"))).alias("s"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, every = [], [x for s in batch.s if len(s) >= 3 for x in s]
            vectors, at = [np.asarray(embed(every[a : a + calls])) for a in range(0, len(every), calls)], 0
            vectors = np.concatenate(vectors) if vectors else None
            for r in batch.itertuples(index=False):
                found = list(r.s)
                groups = [found] if found else []
                if len(found) >= 3:
                    starts = [*boundaries(vectors[at : at + len(found)], threshold, most), len(found)]
                    at += len(found)
                    groups = [found[a:b] for a, b in zip(starts, starts[1:], strict=False)]
                    groups = split_large(merged_small(groups, count), count)
                rows += [(r.doc_id, r.section_id, r.section_order, i, " ".join(g), list(r.blocks)) for i, g in enumerate(groups)]
            yield pd.DataFrame(rows, columns=["doc_id", "section_id", "section_order", "chunk_idx", "chunk_text", "blocks"])

    ddl = "doc_id bigint, section_id string, section_order int, chunk_idx int, chunk_text string, blocks array<string>"
    rows = s.mapInPandas(cut, ddl).withColumn("chunk_text", t.with_code_blocks(F.col("chunk_text"), F.col("blocks"))).drop("blocks")
    return _numbered(rows.withColumn("token_count", t.count_tokens(F.col("chunk_text"))))


def word_count(text: str) -> int:
    import re

    return len(re.findall(r"\w+|[^\w\s]", text))


def batches_by_size(rows: DataFrame, group: str, order: list[str], size: Column, limit: int = 80_000) -> DataFrame:
    """``rows`` with ``batch``: filled in order until the next row would take its batch above ``limit``.

    A row above the limit is a batch of its own; null sizes count as 0, rows without a group are left out. Only the order and the sizes are shuffled and
    sorted, by group, for one pass over the numbers.
    """
    sized = rows.withColumn("_size", F.coalesce(size, F.lit(0)).cast("bigint"))

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, n, begun = None, 0, 0, False
        for part in parts:
            batches = []
            for g, x in zip(part[group].tolist(), part["_size"].tolist(), strict=True):
                if not begun or g != last:
                    last, held, n, begun = g, 0, 0, True
                if held and held + x > limit:
                    n, held = n + 1, 0
                held += x
                batches.append(n)
            yield part.drop(columns="_size").assign(batch=batches)

    narrow = sized.where(F.col(group).isNotNull()).select(group, *order, "_size").repartition(group).sortWithinPartitions(group, *order)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_size") + ", batch int"
    return sized.drop("_size").join(narrow.mapInPandas(fill, ddl), [group, *order])
