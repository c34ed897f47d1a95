import random

import pytest

from tilewright.operators import hierarchy as module
from tilewright.operators.hierarchy import hierarchy


def run(spark, links, **more):
    out = hierarchy(spark.createDataFrame([(a, b, "x", 1) for a, b in links], "parent bigint, child bigint, path string, pre int"), **more)
    return {r.id: r for r in out.collect()}


def check(spark, links):
    got = run(spark, links)
    parent = {}
    for a, b in links:
        if a is not None and b is not None:
            parent[b] = min(parent.get(b, a), a)
    nodes = set(parent) | set(parent.values())
    assert set(got) == nodes
    up = {}
    for n in nodes:
        path, seen = [n], {n}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        up[n] = None if path[-1] in parent else path[::-1]
    for n in nodes:
        r = got[n]
        if up[n] is None:
            assert (r.root_id, r.depth, r.path, r.pre) == (-1, -1, "cycle", None)
        else:
            assert (r.root_id, r.depth, r.path) == (up[n][0], len(up[n]) - 1, "/".join(map(str, up[n])))
            below = {m for m in nodes if up[m] and n in up[m]}
            assert r.size == len(below)
            assert {m for m in nodes if got[m].pre is not None and r.pre <= got[m].pre < r.pre + r.size} == below


@pytest.mark.parametrize("width", [50_000, 5])
def test_forest_with_circles(spark, monkeypatch, width):
    monkeypatch.setattr(module, "RANGE", width)
    rng = random.Random(2)
    links = [(rng.randrange(max(1, n - 9), n) if n % 13 else None, n) for n in range(2, 90)]
    links += [(200, 201), (201, 202), (202, 200), (202, 203), (203, 204), (300, 300), (300, 301)]
    links += [(5, 6), (None, None), (7, None)] + links[:5]
    check(spark, links)


def test_deep_chain_and_wide_star(spark):
    check(spark, [(n, n + 1) for n in range(1, 70)] + [(1000, 1001 + n) for n in range(60)])


def test_only_circles_and_empty(spark):
    check(spark, [(1, 2), (2, 1)])
    assert run(spark, []) == {}
