"""Problem 4: noise of scanned pages: hyphenation across lines, misread characters, running headers, page numbers.

Headers are found by fuzzy repetition of lines at page edges within a document (its title is one too), page numbers as
lines of their own that rise or stand at the edge of a page; words are judged by the vocabulary of the whole corpus.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.plans.materialize import materialize


@dataclass(frozen=True)
class ScanParams:
    """``least_places`` hyphenated or misread places together are noise. A word is misread if a word that looks like
    it is ``ratio`` times as frequent. The vocabulary that is sent to the tasks has ``words`` entries at most: where the
    corpus has more, the rarest stay in a table, where sections look for what they need of them; this changes no result."""

    least_places: int = 3
    ratio: float = 12.0
    words: int = 500_000
    header_chars: int = 90


#: What a scanner makes of characters, each written in its most broken form, so that a word and its misreadings fall
#: together; first the longer ones. Fixed values.
BROKEN_FORMS = (("é", "e'"), ("nn", "rrn"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("ü", "ii"), ("u", "ii"), ("ﬁ", "fi"), ("ﬂ", "fl"))
SAME_LOOK = str.maketrans({"1": "l", "i": "l", "í": "l", "t": "f", "0": "o", "e": "c", "g": "q", "9": "q", "h": "b", "8": "b", "6": "b", "5": "s", "2": "z"})
HYPHENS = "-‐¬­"
WORD = re.compile(r"[^\W_]+(?:[-‐’'][^\W_]+)*")
DIGITS = str.maketrans("123456789", "000000000")
#: A line that is a page number: a bare or dressed number, with or without a word for page and a total.
PAGE_NUMBER = re.compile(r"\s*(?:[-–—\[(|]\s*)?(?:(?:p|pp|pg|page|seite|s|pág|página|str|strona|стр|страница)\.?\s*)?[0-9lIOoSB]{1,4}(?:\s*(?:of|/|von|de|sur|z|из)\s*[0-9lIOoSB]{1,4})?(?:\s*[-–—\])|])?\s*", re.IGNORECASE)
BARE = re.compile(r"[0-9lIOoSB]{1,4}")
BROKEN = re.compile(rf"([^\W\d_]+)[{HYPHENS}][ \t]*\r?\n\s*([^\W\d_]+)")
_MIXED = re.compile(r"[^\W\d_]\d|\d[^\W\d_]")


def shape(word: str) -> str:
    """Lower case; digits as 0 unless they are mixed with letters, as in a misread word."""
    low = word.lower()
    return low if _MIXED.search(low) else low.translate(DIGITS)


def look(word: str) -> str:
    """The same for all words in lower case that a scanner may take for each other."""
    for x, broken in BROKEN_FORMS:
        word = word.replace(x, broken)
    return word.translate(SAME_LOOK)


def line_key(line: str) -> str:
    """What is left of a line when case, confusable characters, blanks and marks are disregarded."""
    return look(re.sub(r"[\W_]+", "", line.lower()))


def close(a: str, b: str) -> bool:
    """Whether two keys are the same but for one place in eight."""
    if abs(len(a) - len(b)) > max(len(a), len(b)) // 8:
        return False
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1] <= max(len(a), len(b)) // 8


class Unknown(Exception):
    """Keys of counts that are neither in the vocabulary nor told."""


class Vocabulary:
    """Counts of the corpus's words by :func:`shape`, and for each look the most frequent word.

    Words that are not in ``counts`` occur ``floor`` times at most. Where that does not settle a question, the answer
    follows from ``told``, rows of :func:`rare_words` by key; what is not there is put into ``asked``, and the word is
    taken for right. What was found of a text holds once nothing of it is asked any more.
    """

    def __init__(self, counts: dict[str, int], p: ScanParams = ScanParams(), floor: int = 0):
        self.n, self.p, self.floor, self.best = counts, p, floor, {}
        self.told: dict[str, tuple[int, str | None]] = {}
        self.asked: set[str] = set()
        self._here: frozenset = frozenset()
        for word in sorted(counts, key=lambda w: (counts[w], w)):
            self.best[vague_look(word)] = word
        self._kept = functools.lru_cache(300_000)(self._reading)  # keeps no exceptions
        self.reading = self._reading_or_ask if floor else self._kept

    def begin(self, text: str) -> None:
        """Take up a text of the corpus: its words occur at least once."""
        self.asked = set()
        if self.floor:
            self._here = frozenset(WORD.findall(text.lower()))

    def known(self, word: str) -> int:
        """The count of ``word``; 0 while it is asked."""
        key = shape(word)
        if self.floor and key not in self.n:
            if "n" + key in self.told:
                return self.told["n" + key][0]
            self.asked.add("n" + key)
        return self.n.get(key, 0)

    def occurs(self, word: str) -> bool:
        return word.lower() in self._here or self.known(word) > 0

    def commoner(self, word: str, other: str) -> bool:
        """Whether ``word`` is more frequent than ``other``; if one of them is in the vocabulary, the rest is rarer."""
        a, b = self.n.get(shape(word), 0), self.n.get(shape(other), 0)
        return a > b if a or b else self.known(word) > self.known(other)

    def _reading_or_ask(self, low: str) -> str | None:
        try:
            return self._kept(low)
        except Unknown as e:
            self.asked.update(e.args)
            return None

    def _need(self, *keys: str) -> None:
        if missing := [k for k in keys if k not in self.told and (k[0] == "l" or k[1:] not in self.n)]:
            raise Unknown(*missing)

    def _count(self, word: str) -> int:
        key = shape(word)
        if key in self.n or not self.floor:
            return self.n.get(key, 0)
        self._need("n" + key)
        return self.told["n" + key][0]

    def _outnumbered(self, low: str, n: int) -> bool:
        """Whether ``n`` is ``ratio`` times the count of ``low``, and 3 at least."""
        if n < 3 or low in self._here and n < self.p.ratio:
            return False
        return n >= self.p.ratio * self.n.get(shape(low), self.floor) or bool(self.floor) and n >= self.p.ratio * self._count(low)

    def _reading(self, low: str) -> str | None:
        """The most frequent word that looks like ``low``, if it is ``ratio`` times as frequent; None if ``low`` is right."""
        if len(low) < 3 or len(low) > 60:
            return None
        like = look(low)
        best = self.best.get(like)
        if best is not None:
            n = self.n[best]
        else:
            number = self._as_number(low) if any(c.isdigit() for c in low) else None
            if self.floor:
                most = max(self.floor, self.n.get(shape(number), 0) if number else 0)
                if most < max(3, self.p.ratio * self.n.get(shape(low), low in self._here)):
                    return None
                self._need("l" + like, "n" + shape(low), *(["n" + shape(number)] if number else []))
                n, best = self.told["l" + like]
            if best is None:
                return number if number and self._outnumbered(low, self._count(number)) else None
        if best == low or not any(c.isalpha() for c in best):
            return None
        if len(low) == 3 and len(best) != 3:
            return None
        return best if self._outnumbered(low, n) else None

    @staticmethod
    def _as_number(low: str) -> str | None:
        """A code or number whose digits were read as letters, or letters as digits, read the other way."""
        parts = re.split(r"([-‐’'])", low)
        reading = [x.translate(_AS_DIGITS) if any(c.isdigit() for c in x) and all(c in _DIGIT_LIKE for c in x) else x.translate(_AS_LETTERS) for x in parts]
        to = "".join(reading)
        return to if to != low else None

    def correction(self, word: str) -> str | None:
        """The right form of a misread ``word``, in its case; None if it is right or beyond help."""
        if word.isdigit():
            return None
        right = self.reading(word.lower())
        if right is None:
            return None
        letters = [c for c in word if c.isalpha()]
        if all(c.isupper() for c in letters) and (len(letters) > 1 or any(c.isdigit() for c in right)):
            return right.upper()
        return right[:1].upper() + right[1:] if word[:1].isupper() else right


def vague_look(word: str) -> str:
    """The look of a word of the vocabulary, whose digits are like no letter."""
    return look(word.translate(_ANY_DIGIT))


#: Digits of a known word's shape stand for themselves only as 0; letters read as digits, and the other way. Fixed values.
_ANY_DIGIT = str.maketrans("0123456789", "\x01" * 10)
_AS_DIGITS = str.maketrans("lioszbgqí", "110528991")
_AS_LETTERS = str.maketrans("0158", "olsb")
_DIGIT_LIKE = frozenset("0123456789lioszbgqí")


_BLANK = " \t\x0c\xa0"


def _page_lines(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text, form feeds as lines of their own, and the places of those that hold something."""
    lines = text.replace("\r\n", "\n").replace("\x0c", "\n\x0c\n").split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(_BLANK)]


def _is_number(lines: list[str], i: int) -> bool:
    s = lines[i].strip(_BLANK)
    return bool(PAGE_NUMBER.fullmatch(s)) and any(c.isdigit() for c in s) and not (s.isdigit() and _in_list(lines, i))


def body_lines(text: str, headers: frozenset, p: ScanParams = ScanParams(), rising: bool = False) -> tuple[list[str], int]:
    """The lines of ``text`` without page furniture, and how many lines of it there were.

    Page numbers and headers count only between other lines, and not within code fences or tables. A bare number is a
    page number only if the document's bare numbers are ``rising``, or a form feed or header beside it shows the edge of
    a page, or if it has up to three digits and stands between blank lines, is centred, or follows a line of wrapped
    text, which would have gone on in its line; with a word for page, dashes or brackets it always is one.
    """
    lines, full = _page_lines(text)
    if len(full) < 3:
        return lines, 0
    first, last, code = full[0], full[-1], False
    open_, drop, numbers = [], set(), []
    for i, x in enumerate(lines):
        s = x.strip(_BLANK)
        code ^= s.startswith("```")
        if s and not code and first < i < last:
            open_.append(i)
            if _is_number(lines, i):
                numbers.append(i)
            elif len(s) <= p.header_chars and headers and not s.startswith(("#", "|", "- ", "* ")) and is_header(s, headers):
                drop.add(i)
    for i in numbers:
        s = lines[i].strip(_BLANK)
        near = [next((j for j in range(i + step, -1 if step < 0 else len(lines), step) if lines[j].strip(" \t\xa0")), i) for step in (-1, 1)]
        edge = any(j in drop or "\x0c" in lines[j] for j in near)
        before = lines[i - 1].strip(_BLANK)
        alone = not before and not lines[i + 1].strip(_BLANK)
        centred = len(lines[i]) - len(lines[i].lstrip(" \t")) >= 8
        unwrapped = len(before) >= 30 and not before.endswith(":")  # wrapping would have filled the line of a number in a text
        if not BARE.fullmatch(s) or rising or edge or len(s) <= 3 and (alone or centred or unwrapped):
            drop.add(i)
    n = len(drop)
    if n:  # blank lines and form feeds around furniture go with it, so that the paragraph goes on
        for i in list(drop):
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(lines) and (not lines[j].strip(_BLANK) or j in drop):
                    drop.add(j)
                    j += step
    return [x for i, x in enumerate(lines) if i not in drop and x != "\x0c"], n


def _in_list(lines: list[str], i: int) -> bool:
    """A bare number beside another line that is a bare number is a column, not a page number."""
    return any(0 <= j < len(lines) and lines[j].strip().isdigit() for j in (i - 1, i + 1))


def is_header(line: str, headers: frozenset) -> bool:
    whole = line_key(line)
    parts = [whole, *(line_key(x) for x in re.split(r"\s*[|—–]\s*|\s{3,}", line))]
    cut = line_key(line.rstrip(".…")) if line.endswith(("...", "…")) else ""
    for h in headers:
        if any(len(k) >= 6 and close(k, h) for k in parts) or (len(cut) >= 6 and close(cut, h[: len(cut)])):
            return True
    return False


def repaired(text: str, headers: frozenset, vocabulary: Vocabulary, p: ScanParams = ScanParams(), rising: bool = False) -> tuple[int, int, int, str]:
    """Numbers of hyphenated words, misread words and furniture lines, and the text as continuous paragraphs.

    A text without enough of them comes back as it is, its misread words uncounted. Where ``vocabulary`` leaves words
    out, ``text`` is one of those it was counted over, and ``vocabulary.asked`` says what this has still to be told.
    """
    vocabulary.begin(text)
    lines, furniture = body_lines(text, headers, p, rising)
    joined, hyphenated = "\n".join(x.rstrip() for x in lines), 0

    def join(m: re.Match) -> str:
        nonlocal hyphenated
        a, b = m.group(1), m.group(2)
        mark = m.group(0)[len(a)]
        if mark == "-" and vocabulary.commoner(f"{a}-{b}", a + b):
            return f"{a}-{b}"  # a compound that was wrapped at its own hyphen
        if mark != "-" or vocabulary.occurs(a + b) or vocabulary.reading((a + b).lower()) or not (vocabulary.occurs(a) and vocabulary.occurs(b)):
            hyphenated += 1
            return a + b
        return f"{a}-{b}"

    joined = BROKEN.sub(join, joined)
    misread = 0

    def right(m: re.Match) -> str:
        nonlocal misread
        new = vocabulary.correction(m.group())
        if new is None:
            return m.group()
        misread += 1
        return new

    if hyphenated + sum(vocabulary.correction(w) is not None for w in WORD.findall(joined)) < p.least_places and not furniture:
        return hyphenated, 0, 0, text
    joined = WORD.sub(right, joined)
    paragraphs = re.split(r"\n[ \t]*(?:\n[ \t]*)+", joined)
    joined = "\n\n".join(re.sub(r"[ \t]*\n[ \t]*", " ", x) if not re.search(r"```|^\s*\|", x, re.MULTILINE) else x for x in paragraphs)
    return hyphenated, misread, furniture, joined.strip()


class _Shapes(dict):
    def __missing__(self, word: str) -> str:
        out = self[word] = shape(word)
        return out


def word_counts(sections: DataFrame) -> DataFrame:
    """``(word, n)`` over all of ``sections(text)``, materialized; words by their :func:`shape`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = Counter(), _Shapes()

        def flush() -> pa.RecordBatch:
            shapes.clear()
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})
            words.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(map(shapes.__getitem__, WORD.findall(text.lower())))
            if len(words) > 500_000 or len(shapes) > 1_000_000:
                yield flush()
        yield flush()

    return materialize(sections.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")


def frequent_words(counted: DataFrame, p: ScanParams = ScanParams()) -> tuple[dict[str, int], int]:
    """All of ``counted(word, n)`` if it is no more than ``words``, else the words with more than a number of
    occurrences, the least one less than a power of two that leaves so few; and this number."""
    left = counted.agg(*(F.count_if(F.col("n") >= 1 << i).alias(str(i)) for i in range(48))).head()
    floor = next((1 << i) - 1 for i in range(48) if left[i] <= p.words)
    kept = counted.where(F.col("n") > floor).toPandas()  # p.words rows at most
    return dict(zip(kept.word, kept.n.astype(int), strict=True)), floor


def vocabulary_of(sections: DataFrame, p: ScanParams = ScanParams()) -> tuple[dict[str, int], int]:
    """:func:`frequent_words` of ``sections(text)``."""
    return frequent_words(word_counts(sections), p)


def rare_words(counted: DataFrame, floor: int) -> DataFrame:
    """``(key, n, word)`` of the words of ``counted(word, n)`` with ``floor`` occurrences at most, materialized: under "n" and a
    word its count, under "l" and a look the most frequent of them that has it, and its count."""

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = pa.array([vague_look(w) for w in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, like], names=["word", "n", "like"])

    rare = counted.where(F.col("n") <= floor).select("word", "n")
    best = rare.mapInArrow(looks, "word string, n bigint, like string").groupBy("like").agg(F.max(F.struct("n", "word")).alias("m"))
    own = rare.select(F.concat(F.lit("n"), "word").alias("key"), "n", F.lit(None).cast("string").alias("word"))
    return materialize(own.unionByName(best.select(F.concat(F.lit("l"), "like").alias("key"), "m.n", "m.word")), "rare")


def _blocks(key: str) -> list[str]:
    """Pieces of four characters counted from the start and from the end: keys close to each other share one."""
    return sorted({f"{i}:{key[i : i + 4]}" for i in range(0, len(key) - 3, 4)} | {f"-{i}:{key[len(key) - i - 4 : len(key) - i]}" for i in range(0, len(key) - 3, 4)})


def page_edges(sections: DataFrame, titles: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """``(doc_id, headers, rising)``: keys of the lines that are repeated at page edges of a document, and whether its bare
    page numbers rise from section to section.

    Edges are lines next to a page number or form feed. A line that occurs twice in a document, misread places aside
    (keys that are :func:`close`), is a header; a title needs no second occurrence. Forms of a line are compared with
    the most frequent one that has a piece in common with them, so that no two lists of lines meet.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, order, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, full = _page_lines(text)
                full = sorted({*full, *(i for i, x in enumerate(lines) if x == "\x0c")})
                edge = {i: lines[i] == "\x0c" or _is_number(lines, i) for i in full}
                for at, i in enumerate(full):
                    s = lines[i].strip(_BLANK)
                    if edge[i]:
                        if s.isdigit():
                            out.append((doc, None, (order or 0) * 1_000_000 + i, int(s)))
                    elif 0 < at < len(full) - 1 and (edge[full[at - 1]] or edge[full[at + 1]]) and 6 <= len(s) <= p.header_chars and not s.startswith(("#", "|", "- ", "* ")):
                        out.append((doc, line_key(s), 0, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "key", "at", "number"])

    def title_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "key": pa.array([line_key(t) for t in batch.column(1).to_pylist()], pa.string())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [_blocks(k) for k in batch.column(1).to_pylist()]
            at = pa.array([i for i, x in enumerate(blocks) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array([x for b in blocks for x in b], pa.string())], names=["doc_id", "key", "n", "block"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([close(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_()))

    order = F.col("section_order") if "section_order" in sections.columns else F.lit(0)
    lined = sections.where(F.col("text").contains("\n") & F.col("doc_id").isNotNull()).select("doc_id", "section_id", order.cast("bigint").alias("o"), "text").dropDuplicates(["section_id"])
    seen = materialize(lined.select("doc_id", "o", "text").mapInArrow(edges, "doc_id bigint, key string, at bigint, number bigint"), "edges")
    keys = materialize(seen.where("length(key) >= 6").groupBy("doc_id", "key").agg(F.count("*").alias("n")), "keys")
    blocks = keys.mapInArrow(cut, "doc_id bigint, key string, n bigint, block string")
    most = blocks.groupBy("doc_id", "block").agg(F.max(F.struct("n", "key")).alias("m"), F.count("*").alias("forms")).where("forms > 1").select("doc_id", "block", F.col("m.key").alias("form"))
    near = blocks.join(most, ["doc_id", "block"]).where("key <> form").select("doc_id", "key", "n", "form").distinct().mapInArrow(alike, "doc_id bigint, key string, n bigint, form string")
    misread = near.select("doc_id", F.explode(F.array("key", "form")).alias("key"))
    titled = titles.where("title is not null and doc_id is not null").select("doc_id", "title").distinct().mapInArrow(title_keys, "doc_id bigint, key string")
    headers = keys.where("n > 1").select("doc_id", "key").unionByName(misread).unionByName(titled).where(F.length("key") >= 6)
    headers = headers.groupBy("doc_id").agg(F.collect_set("key").alias("headers"))
    before = F.lag("number").over(Window.partitionBy("doc_id").orderBy("at"))
    rising = seen.where("number is not null").withColumn("up", F.col("number") > before).groupBy("doc_id").agg((F.count_if("up") > F.count("*") / 2).alias("rising"))
    return headers.join(rising, "doc_id", "full")


def scan_noise(sections: DataFrame, titles: DataFrame, p: ScanParams = ScanParams()) -> DataFrame:
    """``(section_id, n_hyphenated, n_misread, n_furniture, repaired)`` of the sections that carry scan noise.

    ``sections(section_id, doc_id, text)`` and ``titles(doc_id, title)``. A section is noisy with ``least_places``
    hyphenated and misread places together or with a line of page furniture between others; line breaks alone are
    none. Null and empty texts and null ids give no row; an empty table gives none; repeated rows of one id count once; a document without a title may
    still have repeated headers. The OCR columns are not looked at, as they may be wrong.
    """
    counted = word_counts(sections)
    vocabulary = frequent_words(counted, p)
    floor, counts = vocabulary[1], sections.sparkSession.sparkContext.broadcast(vocabulary)
    headers = page_edges(sections, titles, p)
    with_lines = F.col("text").contains("\n")
    rows = sections.select("section_id", "doc_id", "text").where("text is not null and section_id is not null")
    nothing = {"headers": "array<string>", "rising": "boolean", "told": "array<struct<key:string,n:bigint,word:string>>"}
    none = {c: F.lit(None).cast(t).alias(c) for c, t in nothing.items()}
    lined = rows.where(with_lines).join(headers, "doc_id", "left").select("section_id", "text", "headers", "rising", none["told"])
    plain = rows.where(~with_lines).select("section_id", "text", *none.values())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(counts.value[0], p, counts.value[1])
        for batch in batches:
            out = []
            for key, text, own, rising, told in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                vocabulary.told = {x["key"]: (x["n"] or 0, x["word"]) for x in told or ()}
                h, m, f, new = repaired(text, frozenset(own or ()), vocabulary, p, bool(rising))
                if vocabulary.asked:
                    out.append((key, None, None, None, None, [*vocabulary.told, *vocabulary.asked], text, own, rising))
                elif h + m >= p.least_places or f:
                    out.append((key, h, m, f, new, None, None, None, None))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[*found, "asked", "text", "headers", "rising"])

    found = ["section_id", "n_hyphenated", "n_misread", "n_furniture", "repaired"]
    ddl = "section_id string, n_hyphenated int, n_misread int, n_furniture int, repaired string, asked array<string>, text string, headers array<string>, rising boolean"
    tried = lined.mapInArrow(each, ddl).unionByName(plain.mapInArrow(each, ddl))
    if not floor:
        return tried.select(found).dropDuplicates(["section_id"])
    done, rare = [], None
    while True:  # a section asks again only where what it was told has joined parts of a word; each time for more of its own words
        tried = materialize(tried, "tried")
        done.append(tried.where("asked is null").select(found))
        asking = tried.where("asked is not null")
        if asking.isEmpty():
            return functools.reduce(DataFrame.unionByName, done).dropDuplicates(["section_id"])
        rare = rare_words(counted, floor) if rare is None else rare
        asked = asking.select("section_id", F.explode("asked").alias("key")).distinct()
        told = asked.join(rare, "key", "left").groupBy("section_id").agg(F.collect_list(F.struct("key", "n", "word")).alias("told"))
        tried = asking.select("section_id", "text", "headers", "rising").join(told, "section_id").mapInArrow(each, ddl)
