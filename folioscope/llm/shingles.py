"""Word shingles of whole texts as 64-bit numbers, many texts at a time.

A text's words are its maximal runs of Unicode letters, digits and underscores after NULs are taken out and
it is lower-cased; its shingles are the set of sequences of ``k`` successive words. Null counts as empty; a
text of fewer than ``k`` words has no shingle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Words whose hashes a worker remembers, and characters handled in one numpy pass.
KEEP_WORDS, PASS_CHARS, PASS_TEXTS = 1_000_000, 4_000_000, 30_000


class _Words(dict):
    """word -> place of its hash in ``hashes``."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        if i >= len(self.hashes):
            self.hashes = np.resize(self.hashes, 2 * len(self.hashes))
        self.hashes[i] = xxhash.xxh3_64_intdigest(word)
        return i


_words = _Words()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.replace("\0", "").lower()) if text else []


def passes(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of a bounded number of characters, one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < PASS_TEXTS and (end == at or size < PASS_CHARS):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def shingles(texts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most 30,000 texts: (text's place, shingle) without repeats, ordered by both; number per text."""
    global _words
    if len(_words) > KEEP_WORDS:
        _words = _Words()
    words, parts, sizes = _words, [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = words_of(t)
            parts.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
            sizes[i] = len(found)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(ids) < k:
        return np.zeros(0, np.uint16), np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h, of = words.hashes[ids], np.repeat(np.arange(len(texts), dtype=np.uint16), sizes)
    end = len(h) - k + 1
    s = h[:end].copy()
    for j in range(1, k):
        s = (s ^ (s >> np.uint64(29))) * _ODD + h[j : j + end]
    s = (s ^ (s >> np.uint64(31))) * _MIX
    s ^= s >> np.uint64(29)
    whole = of[:end] == of[k - 1 :]
    s, of = s[whole], of[:end][whole]
    order = np.argsort(s)
    order = order[np.argsort(of[order], kind="stable")]
    s, of = s[order], of[order]
    if len(s):
        new = np.r_[True, (s[1:] != s[:-1]) | (of[1:] != of[:-1])]
        s, of = s[new], of[new]
    return of, s, np.bincount(of, minlength=len(texts))


def minhash(texts: list, k: int, n_hashes: int, seed: int = 7) -> np.ndarray:
    """One row of ``n_hashes`` bytes for each text, 0 everywhere where it has no shingle.

    Each byte is the low byte of one MinHash value, so two texts agree in a byte with probability
    J + (1 - J) / 256.
    """
    rng = np.random.default_rng(seed)
    salt = rng.integers(1, 2**63, n_hashes, dtype=np.uint64)
    out = np.zeros((len(texts), n_hashes), np.uint8)
    for a, b in passes(texts):
        of, s, n = shingles(texts[a:b], k)
        if not len(s):
            continue
        has = np.flatnonzero(n)
        starts = np.r_[0, np.cumsum(n[has])[:-1]]
        for j in range(n_hashes):
            x = (s ^ salt[j]) * _ODD
            x ^= x >> np.uint64(32)
            out[a + has, j] = np.minimum.reduceat(x * _MIX, starts) >> np.uint64(17) & np.uint64(255)
    return out
