import math
import random

import numpy as np
import pytest

from tilewright.operators import proximity as module
from tilewright.operators.proximity import EARTH_RADIUS_M, PackedRTree, within_distance

SCHEMA = "id bigint, lon double, lat double, task string, role string"


def brute(points, limit):
    unit = {}
    for i, lon, lat in points:
        a, b = math.radians(lon), math.radians(lat)
        unit[i] = (math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b))
    ids = sorted(unit)
    chord = 2 * math.sin(limit / EARTH_RADIUS_M / 2)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if math.dist(unit[a], unit[b]) <= chord}


def found(spark, points, limit, **more):
    rows = within_distance(spark.createDataFrame([(*p, "x", None) for p in points], SCHEMA), limit, **more).collect()
    pairs = [(r.id_a, r.id_b) for r in rows]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


@pytest.fixture(scope="module")
def points():
    rng = random.Random(7)
    out = [(k, rng.uniform(10, 10.002), rng.uniform(50, 50.002)) for k in range(300)]
    out += [(1000 + k, 10.001, 50.001) for k in range(40)]  # one spot
    out += [(2000 + k, rng.choice([180.0, -180.0, 179.99999, -179.99999]), rng.uniform(-0.0001, 0.0001)) for k in range(40)]
    out += [(3000 + k, rng.uniform(-180, 180), 90 - rng.uniform(0, 0.0002)) for k in range(40)]
    out += [(4000 + k, rng.uniform(-180, 180), rng.uniform(-80, 80)) for k in range(60)]
    return out


@pytest.mark.parametrize("more", [{}, {"capacity": 8}, {"capacity": 3, "sample_size": 100}])
def test_pairs_equal_brute_force_however_the_leaves_lie(spark, points, more):
    assert found(spark, points, 12.0, **more) == brute(points, 12.0)


def test_nulls_repeats_and_impossible_places(spark):
    rows = [(1, 5.0, 5.0), (1, 5.0, 5.0), (2, 5.0, 5.0), (None, 5.0, 5.0), (3, None, 5.0), (4, 5.0, None), (5, 200.0, 5.0), (6, 5.0, 91.0), (7, float("nan"), 5.0)]
    assert found(spark, rows, 1.0) == {(1, 2)}


def test_empty_table(spark):
    assert found(spark, [], 5.0) == set()


@pytest.mark.parametrize("frontier", [131_072, 7])
def test_tree_finds_what_a_scan_finds(monkeypatch, frontier):
    monkeypatch.setattr(module, "FRONTIER", frontier)
    rng = np.random.default_rng(3)
    points, queries = rng.random((500, 3)), rng.random((50, 3))
    parts = list(PackedRTree(points).hits(queries, 0.1))
    q, n = (np.concatenate(x) for x in zip(*parts))
    assert len(set(zip(q.tolist(), n.tolist()))) == len(q)
    gap = ((queries[:, None] - points[None]) ** 2).sum(-1)
    assert set(zip(q.tolist(), n.tolist())) == set(map(tuple, np.argwhere(gap <= 0.01).tolist()))
