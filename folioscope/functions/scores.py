"""Column functions over scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
#: Weights of record types by kind of query. Fixed values.
LAYER_WEIGHTS = {
    "broad": {"document_summary": 1.5, "section_summary": 1.3, "chunk": 1.0},
    "specific": {"document_summary": 0.7, "section_summary": 0.9, "chunk": 1.0},
    "navigational": {"document_summary": 1.0, "section_summary": 1.4, "chunk": 1.0},
}
HALF_LIFE_DAYS, MOST_BOOST = 90, 0.15


def rrf_share(rank: Column) -> Column:
    """What a place in one ranked list adds, ranks from 1."""
    return F.lit(1.0) / (F.lit(RRF_K) + rank)


def layer_weight(classification: Column, record_type: Column) -> Column:
    """The weight of a record type; an unknown kind of query counts as specific, an unknown type as 1."""
    known = F.when(classification.isin(*LAYER_WEIGHTS), classification).otherwise("specific")
    out = F.lit(1.0)
    for kind, weights in LAYER_WEIGHTS.items():
        for record, w in weights.items():
            out = F.when((known == kind) & (record_type == record), F.lit(w)).otherwise(out)
    return out


def recency_factor(modified: Column, now: Column) -> Column:
    """1 and at most 0.15 more, halved every 90 days of age; 1 for a null time; no age below 0."""
    days = F.greatest((F.unix_micros(now) - F.unix_micros(modified)) / 86400e6, F.lit(0.0))
    # greatest() passes over nulls, so a missing time is told apart first
    return F.when(modified.isNull() | now.isNull(), F.lit(1.0)).otherwise(1.0 + MOST_BOOST * F.pow(F.lit(2.0), -days / HALF_LIFE_DAYS))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision; null if either is."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector as doubles of length 1."""
    d = v.cast("array<double>")
    return F.transform(d, lambda x: x / F.sqrt(dot(d, d)))


def growth_pressure(size: Column, most: Column) -> Column:
    """How much a chunk of ``size`` sentences presses for a boundary."""
    return 1.0 / (1.0 + F.exp(-(size - most) / 2))


def boundary_threshold(base: Column, size: Column, most: Column) -> Column:
    """The similarity below which a new chunk starts, rising with the size of the current one."""
    return base + (1.0 - base) * growth_pressure(size, most)
