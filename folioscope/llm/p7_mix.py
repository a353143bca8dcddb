"""Problem 7: sources mixed to target weights, by temperature and budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.tokens import VOCABULARY, with_tokens
from folioscope.plans.materialize import materialize


def source_name(column: str):
    """A source as the targets write it: lower case, words joined by single hyphens."""
    return F.regexp_replace(F.trim(F.lower(F.col(column))), "[\\s_-]+", "-")


def _bisect(ok: Callable[[float], bool], lo: float, hi: float) -> float:
    """The largest value in [lo, hi] that is ``ok``, where ``lo`` is and it stops being so once."""
    if ok(hi):
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def _norm(w: dict[str, float]) -> dict[str, float]:
    total = sum(w.values())
    return {s: x / total for s, x in w.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to ``exponent`` and normalised: 1 keeps them, 0 makes them equal."""
    return _norm({s: x**exponent for s, x in shares.items()})


def entropy_exponent(shares: dict[str, float], target_entropy: float) -> float:
    """The exponent in [0, 8] at which the tempered shares have ``target_entropy``, or the nearest to it."""
    return _bisect(lambda e: entropy(tempered(shares, e)) >= target_entropy, 0.0, 8.0)


@dataclass(frozen=True)
class Mix:
    """A mix of ``total`` tokens: each source's weight and the exponent at which it was settled; 1 met its target."""

    total: float
    weights: dict[str, float]
    exponents: dict[str, float]


def exact_total(tokens: dict[str, int], targets: dict[str, float], max_repeats: dict[str, int]) -> float:
    """The largest total at which every source that has tokens meets its target within its repeats."""
    goal = _norm({s: targets[s] for s, n in tokens.items() if n > 0 and targets.get(s, 0) > 0})
    return min((max_repeats[s] * tokens[s] / goal[s] for s in goal), default=0.0)


def mix_weights(tokens: dict[str, int], targets: dict[str, float], max_repeats: dict[str, int], total: float | None = None, target_entropy: float | None = None) -> Mix:
    """The mix of ``total`` tokens, by default as many as there are, whose shares are as near to the targets as the repeats allow.

    Weights are natural share x (target / natural share) ** exponent, normalised: 0 mixes in proportion to size, 1 meets
    the targets. The exponent is bisected to the largest at which no source exceeds its repeats; the sources that bind
    there are held at their limit, and the bisection goes on for the others, which share the rest, until they meet
    their targets. With ``target_entropy`` the targets are instead the natural shares raised to the exponent that gives
    them this entropy. Sources without tokens get no weight and the others' targets grow in proportion.
    """
    have = {s: float(n) for s, n in tokens.items() if n > 0 and targets.get(s, 0) > 0}
    if not have:
        return Mix(0.0, {}, {})
    natural = _norm(have)
    goal = _norm({s: targets[s] for s in have}) if target_entropy is None else tempered(natural, entropy_exponent(natural, target_entropy))
    total = min(sum(have.values()) if total is None else total, sum(max_repeats[s] * have[s] for s in have))
    cap = {s: max_repeats[s] * have[s] / total for s in have}
    held, exponents = {}, {}
    while free := [s for s in have if s not in held]:
        rest = max(0.0, 1 - sum(held.values()))

        def at(e: float, free: list = free, rest: float = rest) -> dict[str, float]:
            return {s: rest * w for s, w in _norm({s: natural[s] * (goal[s] / natural[s]) ** e for s in free}).items()}

        def over(e: float, at: Callable = at) -> list[str]:
            return [s for s, w in at(e).items() if w > cap[s] * (1 + 1e-12)]

        if not over(1.0):
            return Mix(total, held | at(1.0), exponents | dict.fromkeys(free, 1.0))
        exponent = 0.0 if over(0.0) else _bisect(lambda e, over=over: not over(e), 0.0, 1.0)
        now = at(exponent)
        binding = over(0.0) or [s for s in free if now[s] >= cap[s] * (1 - 1e-9)] or [max(free, key=lambda s, now=now: now[s] / cap[s])]
        held |= {s: cap[s] for s in binding}
        exponents |= dict.fromkeys(binding, exponent)
    return Mix(total, held, exponents)


def plan_mix(docs: DataFrame, targets: DataFrame, total: float | None = None, target_entropy: float | None = None) -> Mix:
    """:func:`mix_weights` of the tokens in ``docs(id, source, n_tokens)`` and the table of targets."""
    goals = {r.source: r for r in targets.collect()}  # the fixed table of targets
    held = docs.where("n_tokens > 0 and id is not null").where(F.col("source").isin(*goals)).groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    return mix_weights({r.source: r.tokens for r in held.collect()}, {s: r.target_share for s, r in goals.items()}, {s: r.max_repeats for s, r in goals.items()}, total, target_entropy)


def select_mix(docs: DataFrame, mix: Mix, seed: int = 0) -> DataFrame:
    """``(source, id, n_tokens, repeats)``: the documents of the mix and how often each is taken.

    ``docs(id, source, n_tokens)`` with sources as :func:`source_name` writes them. Each source is gone through whole as
    often as its budget allows; of the last pass the documents are taken in the order of a seeded permutation until the
    budget is full. The permutation is realised in blocks: sums per block say which blocks are taken whole, and only
    the block in which the budget ends is ordered inside, so that no task holds a source. A source misses its budget by
    less than one document. Documents of no token, of null id and of no source of the mix are left out; repeated rows
    of one id are separate documents.
    """
    docs = docs.select("source", "id", "n_tokens").where("n_tokens > 0 and id is not null").where(F.col("source").isin(*mix.weights))
    docs = materialize(docs, "sources")
    sums = {r.source: (r.tokens, r.docs) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    total, weights = mix.total, {s: w for s, w in mix.weights.items() if s in sums}
    spark = docs.sparkSession
    plan = [(s, int(w * total // sums[s][0]), float(w * total % sums[s][0]), max(1, math.isqrt(sums[s][1]))) for s, w in weights.items()]
    # a budget of whole passes, up to rounding
    plan = [(s, k + 1, 0.0, b) if sums[s][0] - r < 0.5 else (s, k, r, b) for s, k, r, b in plan]
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, passes int, budget double, blocks int"))
    rows = docs.join(plan_df, "source").withColumn("at", F.xxhash64("id", F.lit(seed)))
    rows = rows.withColumn("block", F.pmod(F.shiftright("at", 20), F.col("blocks")))
    blocks = rows.groupBy("source", "block", "budget").agg(F.sum("n_tokens").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("block"))
    blocks = blocks.withColumn("end", upto).select("source", "block", (F.col("end") - F.col("size")).alias("begin"), "end")
    rows = rows.join(blocks, ["source", "block"])
    whole, part = rows.where("end <= budget or begin >= budget"), rows.where("end > budget and begin < budget")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("taken", F.col("begin") + inside - F.col("n_tokens") / 2 <= F.col("budget"))
    whole = whole.withColumn("taken", F.col("end") <= F.col("budget"))
    columns = ["source", "id", "n_tokens", (F.col("passes") + F.col("taken").cast("int")).alias("repeats")]
    return whole.select(*columns).unionByName(part.select(*columns)).where("repeats > 0")


def shares(mix: DataFrame, docs: DataFrame, targets: DataFrame, plan: Mix) -> DataFrame:
    """Per source of ``targets``: its target and actual share, tokens available and taken, the most repeats of a document,
    the exponent that settled it (null if it has no tokens), whether its limit on repeats binds, and the entropy of the mix."""
    taken = mix.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("taken_tokens"), F.max("repeats").alias("most_repeats"))
    there = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    all_ = targets.join(taken, "source", "left").join(there, "source", "left")
    all_ = all_.fillna(0, ["taken_tokens", "most_repeats", "available_tokens"])
    total = mix.agg(F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("total"))
    share = F.round(F.coalesce(F.col("taken_tokens") / F.col("total"), F.lit(0.0)), 6)
    settled = F.broadcast(mix.sparkSession.createDataFrame([(s, e, e < 1) for s, e in plan.exponents.items()], "source string, exponent double, binding boolean"))
    all_ = all_.join(F.broadcast(total)).join(settled, "source", "left").withColumn("actual_share", share)
    bits = F.round(-F.sum(F.when(F.col("actual_share") > 0, F.col("actual_share") * F.log("actual_share")).otherwise(0.0)).over(Window.partitionBy(F.lit(0))), 4)  # the fixed table's rows
    return all_.select("source", "target_share", "actual_share", "available_tokens", "taken_tokens", "max_repeats", "most_repeats", F.round("exponent", 6).alias("exponent"), F.coalesce("binding", F.lit(False)).alias("binding"), bits.alias("entropy"))


def documents_by_source(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, source, n_tokens)`` of the table of documents."""
    return with_tokens(documents.select(F.col("doc_id").alias("id"), source_name("source").alias("source"), "text"), vocabulary)
