import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import p6_pack, p7_mix
from folioscope.llm.tokens import PIECE, _encoding, VOCABULARY, count_tokens, with_tokens


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 4), st.integers(0, 12)), max_size=60), st.integers(8, 40), st.integers(1, 4))
def test_containers_hold_what_they_may(items, capacity, most):
    sizes, sources, clusters = (np.array([x[i] for x in items], int) for i in range(3))
    out = p6_pack.pack_lot(list(range(len(items))), sizes, sources, clusters, capacity, most)
    held, kinds, ids = Counter(), defaultdict(set), defaultdict(list)
    for i, piece, b, size, left in out:
        held[b] += size
        kinds[b].add(sources[i])
        ids[b].append(i)
    assert all(n <= capacity for n in held.values()) and all(len(k) <= most for k in kinds.values())
    assert all(left == capacity - held[b] for _, _, b, _, left in out)
    total = Counter()
    for i, _, _, size, _ in out:
        total[i] += size
    assert all(total[i] == s for i, s in enumerate(sizes))
    pieces = Counter(i for i, *_ in out)
    assert all(pieces[i] == max(1, math.ceil(s / capacity)) for i, s in enumerate(sizes))
    for b, own in ids.items():
        whole = [clusters[i] for i in own if sizes[i] <= capacity]
        assert len(whole) == len(set(whole))


def test_best_fit_takes_the_tightest_compatible_container():
    out = {i: b for i, _, b, _, _ in p6_pack.pack_lot(["a", "b", "c", "d"], np.array([7, 6, 4, 3]), np.zeros(4, int), np.arange(4), 10)}
    assert out["a"] == out["d"] and out["b"] == out["c"]
    out = {i: b for i, _, b, _, _ in p6_pack.pack_lot(["a", "b", "c", "d"], np.array([7, 6, 4, 3]), np.zeros(4, int), np.array([1, 2, 3, 1]), 10)}
    assert out["a"] != out["d"]


def test_packing_of_a_table(spark):
    rows = [(i, "s" if i % 3 else "t", "the same text" if i % 30 == 0 else f"text number {i} " * (i % 9)) for i in range(300)] + [(300, None, None), (301, "s", ""), (302, "s", "very long " * 4000), (5, "s", f"text number 5 " * 5), (None, "s", "x")]
    df = spark.createDataFrame(rows, "id bigint, source string, text string").withColumns({"lot": F.lit(1), "piece": F.lit("x")})
    out = p6_pack.pack(p6_pack.sized(df), {"small": 64, "large": 512}, lot=100)
    got = out.collect()
    assert {(r.pack_name, r.id) for r in got} == {(p, i) for p in ("small", "large") for i in range(303)}
    used = defaultdict(int)
    for r in got:
        used[r.pack_name, r.container] += r.n_tokens
    assert all(used[r.pack_name, r.container] + r.unused_tokens == {"small": 64, "large": 512}[r.pack_name] for r in got)
    sizes = spark.createDataFrame([("small", 64), ("large", 512)], "pack_name string, capacity_tokens int")
    report = {r.pack_name: r for r in p6_pack.unused(out, sizes).collect()}
    assert report["large"].unused_share < 0.5 and report["small"].held_tokens == report["large"].held_tokens
    assert p6_pack.pack(p6_pack.sized(df.limit(0)), {"small": 64}).count() == 0
    assert {tuple(r) for r in p6_pack.invariants(out, sizes).collect()} == {("small", 303, 0, 0), ("large", 303, 0, 0)}


def test_ill_filled_containers_are_packed_again(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "s", i, int(rng.integers(20, 400))) for i in range(3000)] + [(5000, "s", -1, 5000)]
    items = spark.createDataFrame(rows, "id bigint, source string, cluster bigint, n_tokens int")
    sizes = spark.createDataFrame([("a", 1000)], "pack_name string, capacity_tokens int")
    out = p6_pack.pack(items, {"a": 1000}, lot=40)
    (r,) = p6_pack.unused(out, sizes).collect()
    assert r.unused_share < 0.01 and r.containers <= 1.01 * r.least_containers
    assert [tuple(x) for x in p6_pack.invariants(out, sizes).collect()] == [("a", 3001, 0, 0)]


def test_tokens_of_whole_texts(spark):
    e = _encoding(VOCABULARY)
    long = "some words and ünïcode, " * 20000
    assert len(long) > PIECE and count_tokens(long) == len(e.encode_ordinary(long))
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id bigint, text string")
    assert [r.n_tokens for r in with_tokens(df).orderBy("id").collect()] == [2, 0, 0]


TARGETS = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}


def test_targets_are_met_where_repeats_allow():
    tokens, most = {"a": 1000, "b": 1000, "c": 100, "d": 0}, {"a": 1, "b": 2, "c": 3, "d": 2}
    total = p7_mix.exact_total(tokens, TARGETS, most)
    mix = p7_mix.mix_weights(tokens, TARGETS, most, total)
    assert total == pytest.approx(1900) and set(mix.exponents.values()) == {1.0}
    assert mix.weights == pytest.approx({"a": 0.5 / 0.95, "b": 0.3 / 0.95, "c": 0.15 / 0.95})


def test_the_exponent_gives_way_to_the_limit_on_repeats():
    tokens, most = {"a": 1000, "b": 1000, "c": 100}, {"a": 1, "b": 1, "c": 2}
    mix = p7_mix.mix_weights(tokens, TARGETS, most, total=1500)
    assert mix.total == 1500 and all(w * 1500 <= most[s] * tokens[s] * (1 + 1e-9) for s, w in mix.weights.items()) and sum(mix.weights.values()) == pytest.approx(1)
    # c is held at its limit, the others share the rest as their targets do
    assert 0 < mix.exponents["c"] < 1 and mix.exponents["a"] == mix.exponents["b"] == 1 and mix.weights["a"] / mix.weights["b"] == pytest.approx(5 / 3)
    natural, goal = 100 / 2100, 0.15 / 0.95
    tempered = {s: tokens[s] / 2100 * (TARGETS[s] / 0.95 / (tokens[s] / 2100)) ** mix.exponents["c"] for s in tokens}
    assert tempered["c"] / sum(tempered.values()) == pytest.approx(200 / 1500) and natural < 200 / 1500 < goal
    assert p7_mix.mix_weights(tokens, TARGETS, most).total == 2100  # all there is
    mix = p7_mix.mix_weights(tokens, TARGETS, most, total=10_000)
    assert mix.total == 2200 and mix.weights == pytest.approx({"a": 1000 / 2200, "b": 1000 / 2200, "c": 200 / 2200})
    assert p7_mix.mix_weights({}, TARGETS, most) == p7_mix.Mix(0.0, {}, {})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**7), st.floats(0.001, 1), st.integers(1, 8)), min_size=1, max_size=9), st.one_of(st.none(), st.floats(0.01, 5)))
def test_no_source_exceeds_its_repeats_and_unbound_ones_keep_their_proportions(rows, size):
    tokens, targets, most = ({str(i): r[k] for i, r in enumerate(rows)} for k in range(3))
    mix = p7_mix.mix_weights(tokens, targets, most, size and max(1.0, size * sum(tokens.values())))
    if not mix.weights:
        assert not any(tokens.values())
        return
    assert sum(mix.weights.values()) == pytest.approx(1, abs=1e-6)
    assert all(w * mix.total <= most[s] * tokens[s] * (1 + 1e-6) for s, w in mix.weights.items())
    free = [s for s, e in mix.exponents.items() if e == 1]
    for s in free:
        assert mix.weights[s] / targets[s] == pytest.approx(mix.weights[free[0]] / targets[free[0]], rel=1e-6)


def test_a_stated_entropy_takes_the_place_of_targets():
    tokens, even = {"a": 7000, "b": 2000, "c": 1000}, dict.fromkeys("abc", 1.0)
    mix = p7_mix.mix_weights(tokens, even, dict.fromkeys("abc", 50), target_entropy=0.95)
    assert p7_mix.entropy(mix.weights) == pytest.approx(0.95)


def test_temperature_meets_an_entropy():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    e = p7_mix.entropy_exponent(shares, 0.95)
    assert p7_mix.entropy(p7_mix.tempered(shares, e)) == pytest.approx(0.95)
    assert p7_mix.tempered(shares, 1.0) == pytest.approx(shares) and p7_mix.tempered(shares, 0.0) == pytest.approx(dict.fromkeys(shares, 1 / 3))


def test_selection_keeps_budgets_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ["a", "a", "a", "b", "b", "c"][i % 6], int(rng.integers(1, 50))) for i in range(6000)] + [(None, "a", 5), (7000, "x", 5), (7001, "b", 0), (7002, None, 4)]
    docs = spark.createDataFrame(rows, "id bigint, source string, n_tokens int").withColumns({"block": F.lit(1), "budget": F.lit("x")})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("d", 0.05, 2)], "source string, target_share double, max_repeats int")
    tokens = {r.source: r.n for r in docs.where("id is not null").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    exact = p7_mix.plan_mix(docs, targets, p7_mix.exact_total({s: tokens[s] for s in "abc"}, TARGETS, {"a": 1, "b": 2, "c": 4, "d": 2}))
    report = {r.source: r for r in p7_mix.shares(p7_mix.select_mix(docs, exact), docs, targets, exact).collect()}
    for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert report[s].actual_share == pytest.approx(t / 0.95, abs=0.002) and report[s].most_repeats <= report[s].max_repeats
    plan = p7_mix.plan_mix(docs, targets)
    mix = p7_mix.select_mix(docs, plan).cache()
    report = {r.source: r for r in p7_mix.shares(mix, docs, targets, plan).collect()}
    for s in "abc":
        assert report[s].actual_share == pytest.approx(plan.weights[s], abs=0.002) and report[s].most_repeats <= report[s].max_repeats
        assert report[s].binding == (plan.exponents[s] < 1)
    assert report["d"].actual_share == 0 and mix.count() == mix.select("id").distinct().count()
    assert {r.source for r in mix.select("source").distinct().collect()} == {"a", "b", "c"}
    none = p7_mix.plan_mix(docs.limit(0), targets)
    assert p7_mix.select_mix(docs.limit(0), none).count() == 0 and len(p7_mix.shares(p7_mix.select_mix(docs.limit(0), none), docs.limit(0), targets, none).collect()) == 4


def test_sources_are_named_alike(spark):
    df = spark.createDataFrame([(" Shared_Drive ",), ("SHARED-DRIVE",), ("shared drive",)], "source string")
    assert {r[0] for r in df.select(p7_mix.source_name("source")).collect()} == {"shared-drive"}
