"""Problem 3: oversized texts cut at natural boundaries by recursive bisection, with overlaps."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitParams:
    """A piece has at most ``max_words`` white-space separated words and ``max_chars`` characters, its overlap included.

    The overlap is the last ``overlap_words`` words of the piece before, or as many of them as fit into
    ``overlap_chars`` characters; where not even the last word fits (text without blanks), its last ``overlap_chars``
    characters, from a sentence mark on if there is one.
    """

    max_words: int = 320
    max_chars: int = 3000
    overlap_words: int = 32
    overlap_chars: int = 320


#: Boundaries, strongest first; a cut lies after the match. Fixed values.
BOUNDARIES = [re.compile(p) for p in (r"\n[ \t\r]*\n\s*(?=#)", r"\n[ \t\r]*\n\s*", r"\n\s*(?=(?:[-*|]|\d+[.)])\s)", r"[.!?…][\"'”’»)\]]*\s+", r"\n\s*", r"[;:,]\s+", r"\s+")]
WORD = re.compile(r"\S+")
MARK = re.compile(r"[.!?…。！？、，；]")


def _cut(text: str, lo: int, hi: int) -> int:
    """The strongest boundary of ``text[lo:hi]`` near its midpoint; a hard cut at the midpoint if there is none.

    Near is within a quarter of the length; white space is also looked for in all of the text.
    """
    mid, reach = (lo + hi) // 2, max(1, (hi - lo) // 4)
    for k, boundary in enumerate(BOUNDARIES):
        a, b = (lo, hi) if k == len(BOUNDARIES) - 1 else (mid - reach, mid + reach)
        best = min((m.end() for m in boundary.finditer(text, max(lo, a - 1), min(hi, b + 1)) if lo < m.end() < hi), key=lambda e: abs(e - mid), default=None)
        if best is not None:
            return best
    return mid


def _overlap(text: str, before: int, at: int, p: SplitParams) -> int:
    """Where the overlap of a piece that begins ``at`` begins, the piece before having begun at ``before``."""
    words = [m.start() for m in WORD.finditer(text, before, at)][-p.overlap_words :] if p.overlap_words else []
    if not words:
        return at
    fits = next((w for w in words if at - w <= p.overlap_chars), at)
    if fits < at:
        return fits
    start = at - p.overlap_chars
    mark = MARK.search(text, start, at - 1)
    start = mark.end() if mark else start
    while start < at and unicodedata.combining(text[start]):
        start += 1
    return start


def split_text(text: str, p: SplitParams = SplitParams()) -> list[tuple[int, int, int]]:
    """``(start, own_start, end)`` of each piece: ``text[own_start:end]`` are consecutive, ``text[start:own_start]`` the overlap.

    A text within the limits is one piece; the empty text is one empty piece. Splitting goes on while a part exceeds
    the limits less the overlap.
    """

    def words(a: int, b: int) -> int:
        return len(text[a:b].split())

    if len(text) <= p.max_chars and words(0, len(text)) <= p.max_words:
        return [(0, 0, len(text))]
    own, stack = [], [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if b - a > 1 and (b - a > p.max_chars - p.overlap_chars or words(a, b) > p.max_words - p.overlap_words):
            m = _cut(text, a, b)
            stack += [(m, b), (a, m)]
        else:
            own.append((a, b))
    out = []
    for i, (a, b) in enumerate(own):
        start = _overlap(text, own[i - 1][0], a, p) if i else a
        out.append((start, a, b))
    return out


def too_long(records: DataFrame, p: SplitParams = SplitParams()) -> DataFrame:
    """Rows of ``records(record_kind, record_id, text)`` that may exceed the limits: no text that does is left out.

    A text of at most twice ``max_words`` characters cannot have more than ``max_words`` words.
    """
    # an upper bound of the number of words in Python's sense: every white-space character may end one
    loose = F.length("text") > p.max_chars
    gaps = F.length("text") - F.length(F.regexp_replace("text", "(?U)[\\s\\x1c-\\x1f]+", ""))
    return records.where(loose | ((F.length("text") > 2 * p.max_words) & (gaps >= p.max_words)))


def split(records: DataFrame, p: SplitParams = SplitParams()) -> DataFrame:
    """``(record_kind, record_id, piece, start, own_start, end, n_words, text)`` of every text beyond the limits.

    Texts within the limits (null and empty ones too) and rows of null id give no row; repeated rows of one id give its pieces
    once; an empty table gives none.
    ``piece`` counts from 0; positions are code points of the text.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, key, text in zip(batch.record_kind, batch.record_id, batch.text, strict=True):
                cut = split_text(text, p)
                if len(cut) > 1:
                    rows += [(kind, key, i, s, a, b, len(text[s:b].split()), text[s:b]) for i, (s, a, b) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=["record_kind", "record_id", "piece", "start", "own_start", "end", "n_words", "text"])

    long = too_long(records.where("record_id is not null").select("record_kind", "record_id", "text"), p)
    ddl = "record_kind string, record_id string, piece int, start int, own_start int, end int, n_words int, text string"
    return long.mapInPandas(pieces, ddl).dropDuplicates(["record_kind", "record_id", "piece"])


def oversized(records: DataFrame, p: SplitParams = SplitParams()) -> DataFrame:
    """``(record_kind, record_id)`` of the records that :func:`split` cuts, each once."""
    return split(records, p).where("piece = 0").select("record_kind", "record_id")


def invariants(records: DataFrame, pieces: DataFrame, p: SplitParams = SplitParams()) -> DataFrame:
    """``(record_kind, record_id, n_chars, contiguous, within_limits, overlapping)`` of the records that were cut.

    Pieces must give the whole text one after the other, keep both limits, and repeat the end of the piece before.
    """
    order = Window.partitionBy("record_kind", "record_id").orderBy("piece")
    seen = pieces.withColumns({"before_end": F.lag("end").over(order), "before_start": F.lag("own_start").over(order), "last": F.lead("piece").over(order).isNull()})
    follows = F.when(F.col("piece") == 0, F.col("own_start") == 0).otherwise(F.col("own_start") == F.col("before_end"))
    within = (F.length("text") == F.col("end") - F.col("start")) & (F.length("text") <= p.max_chars) & (F.col("n_words") <= p.max_words)
    repeats = F.when(F.col("piece") == 0, F.col("start") == F.col("own_start")).otherwise((F.col("start") < F.col("own_start")) & (F.col("start") >= F.col("before_start")))
    whole = seen.groupBy("record_kind", "record_id").agg(F.max("end").alias("n_chars"), F.every(follows).alias("contiguous"), F.every(within).alias("within_limits"), F.every(repeats).alias("overlapping"))
    long = records.where("text is not null").select("record_kind", "record_id", F.length("text").alias("n_text")).distinct()
    return whole.join(long, ["record_kind", "record_id"]).select("record_kind", "record_id", "n_chars", (F.col("contiguous") & (F.col("n_text") == F.col("n_chars"))).alias("contiguous"), "within_limits", "overlapping")
