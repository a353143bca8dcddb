"""JSON out of what a tool printed, as far as it can be made whole."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\],]', re.DOTALL)


def _as_object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def closed(fragment: str) -> str:
    """``fragment`` with its open string ended and its open brackets closed."""
    open_, tail = [], ""
    for m in _TOKEN.finditer(fragment):
        x = m.group()
        if x[0] == '"':
            whole = len(x) > 1 and x[-1] == '"' and (len(x) - len(x[:-1].rstrip("\\"))) % 2 == 1
            tail = "" if whole else '"'
        elif x in "{[":
            open_.append("}" if x == "{" else "]")
        elif x in "}]" and open_:
            open_.pop()
    return fragment + tail + "".join(reversed(open_))


def repaired(text: str) -> dict | None:
    """The object that ``text`` begins, cut off somewhere: closed as it stands, else after one of the last five commas taken away."""
    start = text.find("{")
    if start < 0:
        return None
    body = text[start:]
    commas = [m.start() for m in _TOKEN.finditer(body) if m.group() == ","]
    for end in [len(body), *reversed(commas[-5:])]:
        found = _as_object(closed(body[:end].rstrip().rstrip(",").rstrip()))
        if found is not None:
            return found
    return None


def extract(text: str) -> dict | None:
    """The first of: the text itself, a fenced part, what lies between the outermost braces, a repaired beginning."""
    tries = [text.strip(), *(m.group(1).strip() for m in _FENCE.finditer(text))]
    if "{" in text and "}" in text:
        tries.append(text[text.index("{") : text.rindex("}") + 1])
    return next((x for x in map(_as_object, tries) if x is not None), None) or repaired(text)


def extracted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, json, broken)``: the object in ``text`` as JSON with sorted keys, null if there is none; ``broken`` if a brace opens one.

    What is JSON as it stands is parsed by Spark; only the rest goes through :func:`extract`. Null texts give no row.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(x) for x in batch[text]]
            yield pd.DataFrame({key: batch[key], "json": [None if f is None else json.dumps(f, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for f in found], "broken": [f is None and "{" in x for f, x in zip(found, batch[text], strict=True)]})

    kind = dict(rows.dtypes)[key]
    rows = rows.where(F.col(text).isNotNull()).select(key, text, F.try_parse_json(text).alias("_v"))
    whole = F.ltrim(text).startswith("{") & F.col("_v").isNotNull()
    good = rows.where(whole).select(key, F.to_json("_v").alias("json"), F.lit(False).alias("broken"))
    # without a brace there is nothing to find
    none = rows.where(~whole & ~F.contains(text, F.lit("{"))).select(key, F.lit(None).cast("string").alias("json"), F.lit(False).alias("broken"))
    rest = rows.where(~whole & F.contains(text, F.lit("{"))).select(key, text).mapInPandas(each, f"{key} {kind}, json string, broken boolean")
    return good.unionByName(none).unionByName(rest)


def complete(objects: list, required: set[str]) -> list:
    """The objects of a list that have every required key."""
    return [x for x in objects if isinstance(x, dict) and required <= x.keys()]
