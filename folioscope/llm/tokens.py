"""Token counts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: A tiktoken rank file; another path may be given wherever texts are counted.
VOCABULARY = os.environ.get("FOLIOSCOPE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The splitting pattern that belongs to the file (a fixed value of that vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are counted piece by piece, cut before a blank that follows a letter.
PIECE = 100_000


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of the whole text; null and empty have none. Very long texts are cut only where no token can span."""
    if not text:
        return 0
    encoding, n = _encoding(path), 0
    while len(text) > PIECE:
        m = re.compile(r"(?<=\w) (?=\w)").search(text, PIECE)
        if not m:
            break
        n += len(encoding.encode_ordinary(text[: m.start()]))
        text = text[m.start() :]
    return n + len(encoding.encode_ordinary(text))


_shipped: set[tuple[str, str]] = set()


def with_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``docs`` with its column ``text`` replaced by ``n_tokens``; the vocabulary file is sent to the executors."""
    context = docs.sparkSession.sparkContext
    if (context.applicationId, path) not in _shipped:
        _shipped.add((context.applicationId, path))
        context.addFile(path)
    name = os.path.basename(path)
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text") + ", n_tokens int"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = SparkFiles.get(name)
        for batch in batches:
            n = [count_tokens(t, at) for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(n, pa.int32())], names=[*others, "n_tokens"])

    return docs.select(*others, "text").mapInArrow(count, schema)
