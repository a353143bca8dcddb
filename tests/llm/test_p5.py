import datetime
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import p5_neighbours
from folioscope.llm.p5_neighbours import IndexParams, brute_force, named, nearest, neighbour_pairs, recall, valid_points

T = datetime.datetime(2020, 1, 1)
SCHEMA = "point_id string, embedded_at timestamp, vector array<float>, other string, id int"


def clusters(rng, n, size):
    centres = rng.normal(size=(n, 64))
    return [c + rng.normal(scale=0.4, size=64) for c in centres for _ in range(size)]


def exact(rows, k=5, least=0.8):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, name in enumerate(ids):
        cos = np.round(x @ x[i], 6)
        order = [j for j in sorted(range(len(ids)), key=lambda j: (-cos[j], ids[j])) if j != i][:k]
        out[name] = [(ids[j], cos[j]) for j in order if cos[j] >= least]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    found = {f"p{i:04d}": [float(v) for v in np.float32(x)] for i, x in enumerate(clusters(rng, 60, 8))}
    for i in range(40):  # copies: more than can be anyone's neighbours
        found[f"c{i:02d}"] = found["p0003"]
    return found


def table(spark, rows):
    return spark.createDataFrame([(i, T, v, "x", 1) for i, v in rows], SCHEMA)


def test_nearly_all_true_neighbours(spark, vectors):
    points = valid_points(table(spark, vectors.items()))
    found = nearest(points)
    got = named(found, points, {"id": "point_id", "other": "neighbour_id"}).collect()
    want = {(i, j) for i, js in exact(vectors).items() for j, _ in js}
    hit = {(r.point_id, r.neighbour_id) for r in got}
    assert len(hit & want) / len(want) > 0.95
    for i in ("c00", "c39", "p0003"):  # ties between copies go by id, and are exact
        assert [r.neighbour_id for r in sorted(got, key=lambda r: r.place) if r.point_id == i] == [j for j, _ in exact(vectors)[i]]
    missed = recall(found, brute_force(points, every=1)).head()
    assert missed.true_neighbours == len(want) and missed.missed == len(want - hit)


SHELVED = IndexParams(shelf_rows=300)  # several shelves on small tables


def test_several_shelves_find_nearly_all(spark, vectors):
    points = valid_points(table(spark, vectors.items()), SHELVED)
    assert points.points.select(F.explode("shelves").alias("s")).distinct().count() > 3
    assert points.points.where(F.size("shelves") != 3).count() == 0
    missed = recall(nearest(points), brute_force(points, every=1)).head()
    assert missed.missed_share < 0.05


def test_a_pair_comes_from_one_shelf_only(spark, vectors):
    points = valid_points(table(spark, vectors.items()), SHELVED)
    rows = nearest(points).select("id", "other")
    assert rows.count() == rows.distinct().count()


@pytest.mark.parametrize("p", [IndexParams(), SHELVED])
def test_split_shelves_find_the_same(spark, vectors, p):
    rows = list(vectors.items())[:200]
    want = {(i, j) for i, js in exact(dict(rows)).items() for j, _ in js}
    for split in (10, 10_000):
        points = valid_points(table(spark, rows), replace(p, split_rows=split))
        got = {tuple(r) for r in named(nearest(points), points, {"id": "a", "other": "b"}).select("a", "b").collect()}
        assert len(got & want) > 0.95 * len(want)


def test_every_pair_once(spark, vectors):
    points = valid_points(table(spark, list(vectors.items())[:80]))
    pairs = [tuple(r) for r in neighbour_pairs(nearest(points), points).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)


def test_only_the_last_valid_vector_counts(spark):
    v, later = [1.0] * 64, T + datetime.timedelta(days=1)
    rows = [
        ("new", T, [0.5] * 64), ("new", later, v), ("undone", T, v), ("undone", later, None), ("timeless", None, v), ("null", T, [None] + v[1:]), ("nan", T, [float("nan")] + v[1:]),
        ("inf", T, [float("inf")] + v[1:]), ("short", T, v[:5]), ("zero", T, [0.0] * 64), (None, T, v), ("tiny", T, [1e-30] * 64), ("huge", T, [1e30] * 64), ("huge", T, [1e30] * 64),
    ]
    points = valid_points(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert [r.point_id for r in points.points.orderBy("id").collect()] == ["huge", "new", "timeless", "tiny"]
    assert neighbour_pairs(nearest(points), points).count() == 6
    empty = valid_points(spark.createDataFrame([], SCHEMA))
    assert nearest(empty).count() == 0 and recall(nearest(empty), brute_force(empty)).head().missed_share == 0


def test_one_point_has_no_neighbour(spark):
    points = valid_points(spark.createDataFrame([("a", T, [1.0] * 64, "x", 1)], SCHEMA))
    assert nearest(points).count() == 0
    assert nearest(points).columns == ["id", "other", "cosine", "place"]


def test_brute_force_sends_k_a_query_and_part(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    rows = {f"n{i:03d}": [float(v) for v in np.float32(centre + rng.normal(scale=0.1, size=64))] for i in range(150)}
    rows |= {f"c{i:03d}": rows["n007"] for i in range(50)}
    points = valid_points(table(spark, rows.items()))
    sent = []
    real = p5_neighbours._with_copies
    monkeypatch.setattr(p5_neighbours, "_with_copies", lambda found, *a: sent.append(found) or real(found, *a))
    truth = named(brute_force(points, every=1), points, {"id": "point_id", "other": "neighbour_id"}).collect()
    assert {(r.point_id, r.neighbour_id, r.cosine) for r in truth} == {(i, j, c) for i, js in exact(rows).items() for j, c in js}
    assert len(sent) == 1 and sent[0].select("id").distinct().count() == 150  # copies are no queries


def test_ties_on_a_shelf_go_by_id():
    rng = np.random.default_rng(2)
    raw = np.float32(np.ones(64) + rng.normal(scale=1e-7, size=(900, 64)))
    ids, one = np.arange(900) * 3, np.zeros((900, 1), np.int32)
    got = p5_neighbours._search(ids, raw, one, one[:, 0], 0, False, IndexParams())
    for i in (0, 3, 897, 2697):
        assert got[1][got[0] == i].tolist() == [j for j in (0, 3, 6, 9, 12, 15) if j != i][:5]


def test_long_files_are_ranked_by_footrule(vectors):
    raw = np.array(list(vectors.values())[:480], np.float32)
    ids, one = np.arange(480), np.zeros((480, 1), np.int32)
    want = {(i, int(j)) for i, (_, js) in enumerate(sorted(exact({f"{i:03d}": list(x) for i, x in enumerate(raw)}).items())) for j, _ in js}
    for rerank in (40, 512):  # files have up to 480 rows
        x, y, _ = p5_neighbours._search(ids, raw, one, one[:, 0], 0, False, IndexParams(rerank=rerank, pivot_rows=60))
        assert len(want & set(zip(x.tolist(), y.tolist(), strict=True))) > 0.9 * len(want)


def test_first_columns_are_the_greatest():
    near = np.random.default_rng(4).normal(size=(50, 1000))
    for m, width in ((1000, 6), (1000, 40), (7, 7), (991, 3)):
        assert np.array_equal(p5_neighbours._first(near[:, :m], width), np.argsort(-near[:, :m], axis=1)[:, :width])


def test_one_direction_is_one_vector(spark, vectors):
    rows = {i: [x * 2.0 ** (n % 5) for x in v] for n, (i, v) in enumerate(vectors.items())}
    points = valid_points(table(spark, rows.items()))
    assert points.points.select("h").distinct().count() == 480
    one, other = ({tuple(r)[:2] for r in nearest(valid_points(table(spark, x.items()))).collect()} for x in (rows, vectors))
    assert one == other


def test_a_hot_direction_and_replayed_rows(spark):
    rng = np.random.default_rng(6)
    hot = [float(x) for x in np.float32(rng.normal(size=64))]
    rows = [(f"h{i:03d}", hot) for i in range(300)] + [(f"o{i:03d}", [float(x) for x in np.float32(rng.normal(size=64))]) for i in range(300)]
    points = valid_points(table(spark, rows * 3), SHELVED)
    got = named(nearest(points), points, {"id": "a", "other": "b"}).collect()
    assert {(r.a, r.b) for r in got} == {(f"h{i:03d}", f"h{j:03d}") for i in range(300) for j in ([x for x in range(6) if x != i][:5])}
