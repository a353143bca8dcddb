"""Problem 8: text garbled by decoding with a wrong character encoding.

Words with characters beyond ASCII, or with entities that stand for such, are the states of a best-first search whose edges encode with the encoding that
may have been assumed and decode with the one that may be right, or unescape. Its cost is how implausible the
characters are beside each other, by a model of character pairs counted over the non-ASCII words of all texts.
"""

from __future__ import annotations

import functools
import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.materialize import materialize

#: Encodings that text may have been decoded with by mistake, and those it may have been in. Fixed values.
ASSUMED = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "iso8859-2", "koi8-r", "cp866")
RIGHT = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp1250", "iso8859-2", "mac_roman", "cp866")
LOST = "�"
#: White-space separated words that hold a character beyond ASCII; no-break spaces may be halves of letters.
ODD_WORD = re.compile(r"(?<![^\x00-\x20])[\x21-\x7f]*+[^\x00-\x7f][^\x00-\x20]*+")
ANY_WORD = re.compile(r"[^\x00-\x20]+")
ENTITY = re.compile(rb"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")
_SEPARATORS = bytes.maketrans(bytes(range(0x20)), b" " * 0x20)
DIGITS = str.maketrans("123456789", "000000000")


@dataclass(frozen=True)
class RepairParams:
    """At most ``pairs`` character pairs make up the model, far more than the scripts of a corpus have, and words of a share
    of 1 / ``words`` the lexicon (the bounds of what is broadcast; rarer words would make no word cheaper). ``gain`` bits
    tell a garbled word; ``steps`` is the longest way; ``least_words`` garbled words make a garbled text."""

    pairs: int = 500_000
    words: int = 200_000
    gain: float = 8.0
    steps: int = 3
    least_words: int = 2


def _sloppy(codec: str) -> tuple[dict[str, int], str]:
    """The codec's characters, with bytes that it leaves undefined as control characters of the same number."""
    chars = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
    return {c: b for b, c in enumerate(chars)}, chars


_TABLES = {codec: _sloppy(codec) for codec in {*ASSUMED, *RIGHT} - {"utf-8"}}


def encode(text: str, codec: str) -> bytes | None:
    table = _TABLES[codec][0]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def decode(data: bytes, codec: str) -> str | None:
    if codec != "utf-8":
        chars = _TABLES[codec][1]
        return "".join([chars[b] for b in data])
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        rough = data.decode("utf-8", "replace")  # halves of letters may be lost, but not many
        return rough if 4 * rough.count(LOST) <= len(rough) + 2 and len(rough) < 0.8 * len(data) else None


def plain(word: str) -> str:
    """A word as it is searched: one of ASCII alone with its entities unescaped."""
    return html.unescape(word) if word.isascii() else word


def odd_words(text: str | None) -> list[str]:
    """What ``ODD_WORD`` finds, and words of ASCII whose entities stand for more, unescaped.

    It goes by way of bytes: these split at ASCII blanks alone, and much faster.
    """
    if not text or text.isascii() and "&" not in text:
        return []
    data = text.encode("utf-8", "replace").translate(_SEPARATORS)
    words = data.split(b" ")
    found = [w.decode() for w in words if not w.isascii()]
    if b"&" in data and ENTITY.search(data):
        found += [u for w in words if b"&" in w and w.isascii() and ENTITY.search(w) and not (u := html.unescape(w.decode())).isascii()]
    return found


def _pairs(word: str) -> Iterator[str]:
    w = f"\x02{word.translate(DIGITS)}\x03"
    return (a + b for a, b in zip(w, w[1:], strict=False) if a > "\x7f" or b > "\x7f")


class Model:
    """Bits of a word's character pairs, for words seen in the corpus as a whole."""

    def __init__(self, pairs: dict[str, int], total: int, words: dict[str, int]):
        total, self.of = max(total, 1), max(1, sum(words.values())) / 200_000
        self.bits = {p: math.log2(total / n) for p, n in pairs.items()}
        self.unseen = math.log2(total) + 2
        self.masked: dict[str, list[str]] = {}
        self.known = words
        for w in sorted(words, key=lambda w: (-words[w], w)):
            if LOST not in w:
                self.masked.setdefault(re.sub(r"[^\x00-\x7f]", LOST, w), []).append(w)

    def fill(self, word: str) -> str | None:
        """The most frequent word of the corpus that ``word`` can be with its lost characters put in."""
        if 2 * word.count(LOST) > len(word):
            return None
        fits = self.masked.get(re.sub(r"[^\x00-\x7f]", LOST, word), ())
        return next((w for w in fits if all(a in (LOST, b) for a, b in zip(word, w, strict=True))), None)

    def cost(self, word: str) -> float:
        bits, unseen = self.bits, self.unseen
        cost = 0.0
        for p in _pairs(word):
            cost += bits.get(p, unseen)
            if "\x7f" < p[0] < "\xa0" or "\x7f" < p[1] < "\xa0":
                cost += 6  # control characters
        # up to ten bits less for a word by how common it is as a whole
        return cost - min(10.0, math.log2(max(1.0, self.known.get(word.translate(DIGITS), 0) / self.of)))


def repair(word: str, model: Model, p: RepairParams = RepairParams()) -> tuple[str, tuple]:
    """The cheapest text that ``word`` may have been, and the way to it; the word itself and () if none is cheap enough.

    The search goes on until nothing cheaper is left to expand. States dearer than the word itself are not followed: what
    lies behind them is no repair of garbled text but chance.
    """
    start = model.cost(word)
    best, best_cost, best_way = word, start, ()
    heap, seen = [(start, 0.0, word, ())], {word}
    letters = len(word.translate(DIGITS).strip(".,;:!?()\"'0-"))
    while heap:
        now, paid, text, way = heapq.heappop(heap)
        if best_way and now > best_cost:
            break  # what is left is dearer than what was reached
        if len(way) == p.steps:
            continue
        reached, tried = [], set()
        if "&" in text:
            reached.append((("unescape", ""), html.unescape(text)))
        for assumed in ASSUMED:
            data = encode(text, assumed)
            if data is not None and data not in tried:
                tried.add(data)
                reached += [((assumed, right), decode(data, right)) for right in RIGHT if right != assumed]
        for edge, to in reached:
            if to is None or to in seen:
                continue
            seen.add(to)
            # any byte decodes in a one-byte encoding, so such a step proves less; of one letter it proves nothing
            toll = paid + (4.0 if edge[0] != "unescape" and edge[1] != "utf-8" else 1.0)
            cost = model.cost(to) + toll
            if cost < best_cost and (letters > 1 or toll < 4):
                best, best_cost, best_way = to, cost, (*way, edge)
            if cost < start:
                heapq.heappush(heap, (cost, toll, to, (*way, edge)))
    if start - best_cost < p.gain or best_cost > 0.75 * start:
        return word, ()
    return best, best_way


WAY_LOST = (("lost", ""),)


def way_of(shape: str, model: Model, p: RepairParams = RepairParams()) -> tuple:
    """The way of a word whose digits are all 0: () for a clean one."""
    if LOST in shape:
        return WAY_LOST
    return repair(shape, model, p)[1] if model.cost(shape) >= p.gain else ()


def along(text: str, way: tuple) -> str | None:
    """``text`` taken along a way that :func:`repair` gave."""
    for assumed, right in way:
        if assumed == "unescape":
            text = html.unescape(text)
            continue
        data = encode(text, assumed)
        text = None if data is None else decode(data, right)
        if text is None:
            return None
    return text


class Repairer:
    """Repairs whole texts. ``ways`` has the ways of all garbled words of the corpus, or is None to search when needed."""

    def __init__(self, model: Model, ways: dict[str, tuple] | None = None, p: RepairParams = RepairParams()):
        self.model, self.p = model, p
        self.way = functools.lru_cache(200_000)(lambda shape: way_of(shape, model, p)) if ways is None else lambda shape: ways.get(shape, ())
        self.fill = functools.lru_cache(50_000)(model.fill)

    def _restored(self, word: str, way: tuple) -> str:
        new = word if way == WAY_LOST else along(word, way) or word
        if LOST not in new:
            return new
        shape = new.translate(DIGITS)
        core = re.search(r"[^\W\d_]*�(?:[^\W\d_]|�)*", shape)
        for start, end in ((0, len(shape)), core.span()):
            known = self.fill(shape[start:end])
            if known:  # digits stand for any digit in the lexicon
                return new[:start] + "".join(k if c == LOST else c for c, k in zip(new[start:end], known, strict=True)) + new[end:]
        return new

    def text(self, text: str | None) -> tuple[int, str | None]:
        """The number of garbled words in ``text``, and the text with what can be restored."""
        if not any(self.way(w.translate(DIGITS)) for w in odd_words(text)):
            return 0, text
        found = [m for m in ANY_WORD.finditer(text) if not (w := m.group()).isascii() or "&" in w and odd_words(w)]
        ways = [self.way(plain(m.group()).translate(DIGITS)) for m in found]
        n = sum(map(bool, ways))
        out, at = [], 0
        for i, (m, way) in enumerate(zip(found, ways, strict=True)):
            word = m.group()
            new = self._restored(plain(word), way) if way else self._as_neighbours(word, ways, i)
            if new != word:
                out += [text[at : m.start()], new]
                at = m.end()
        return n, "".join(out) + text[at:]

    def _as_neighbours(self, word: str, ways: list, i: int) -> str:
        """A short word that tells nothing by itself goes the way that both its neighbours went, if that is as plausible."""
        before = next((ways[j] for j in range(i - 1, max(-1, i - 4), -1) if ways[j]), None)
        after = next((ways[j] for j in range(i + 1, min(len(ways), i + 4)) if ways[j]), before)
        if not before or before != after or before == WAY_LOST:
            return word
        new = along(word, before)
        return new if new is not None and self.model.cost(new) <= self.model.cost(word) + 6 else word


def odd_word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: the distinct non-ASCII words of all of ``docs(text)``, every digit a 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})
            words.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(w.translate(DIGITS) for w in odd_words(text))
            if len(words) > 500_000:
                yield flush()
        yield flush()

    return materialize(docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")


def corpus_model(counted: DataFrame, p: RepairParams = RepairParams()) -> Model:
    """The model of all words that :func:`odd_word_counts` counted: both character pairs and lexicon."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for pair in _pairs(word):
                    sums[pair] += n
        yield pa.RecordBatch.from_pydict({"pair": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())})

    paired = counted.mapInArrow(pairs, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    paired = materialize(paired, "pairs")
    total = paired.agg(F.sum("n")).head()[0] or 0
    top = {r.pair: r.n for r in paired.orderBy(F.desc("n"), "pair").limit(p.pairs).collect()}
    # words of a share of 1 / words or more: no more than that many can be
    all_words = counted.agg(F.sum("n")).head()[0] or 0
    lexicon = {r.word: r.n for r in counted.where(F.col("n") * p.words >= all_words).collect()}
    return Model(top, total, lexicon)


def garbled_ways(counted: DataFrame, model, p: RepairParams = RepairParams(), most: int = 1_000_000) -> dict[str, tuple] | None:
    """The ways of all garbled words, each distinct word searched once; None if more than ``most`` of them are garbled."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            ways = [way_of(w, model.value, p) for w in words]
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, x in zip(words, ways, strict=True) if x], pa.string()), "way": pa.array(["/".join(f"{a}>{b}" for a, b in x) for x in ways if x], pa.string())})

    spread = counted.select("word").repartition(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = materialize(spread.mapInArrow(search, "word string, way string"), "ways")
    if found.limit(most + 1).count() > most:
        return None
    return {r.word: tuple(tuple(e.split(">")) for e in r.way.split("/")) for r in found.collect()}


def restored(docs: DataFrame, p: RepairParams = RepairParams()) -> DataFrame:
    """``(id, n_garbled, restored)`` of every text of ``docs(id, text)`` with ``least_words`` garbled words or more.

    ``restored`` is the text with each garbled word taken back as far as possible: words that lost characters to
    U+FFFD are looked up in the corpus. Garbled words may be written in entities. Null, empty and plain ASCII texts and rows of null id give no row; repeated rows
    stay rows; an empty table gives none.
    The ways of garbled words are broadcast if there are at most a million of them; else each task searches anew.
    """
    docs, context = docs.where("id is not null").select("id", "text"), docs.sparkSession.sparkContext
    counted = odd_word_counts(docs)
    model = context.broadcast(corpus_model(counted, p))
    ways = context.broadcast(garbled_ways(counted, model, p))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(model.value, ways.value, p)
        for batch in batches:
            got = [repairer.text(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, (n, _) in enumerate(got) if n >= p.least_words]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([got[i][0] for i in keep], pa.int32()), pa.array([got[i][1] for i in keep], pa.string())], names=["id", "n_garbled", "restored"])

    return docs.select("id", "text").mapInArrow(each, "id bigint, n_garbled int, restored string")
