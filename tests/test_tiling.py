import random

from pyspark.sql import functions as F

from tilewright.element_queries import group_tiles, qt_fold_small
from tilewright.operators import tiling
from tilewright.operators.extract import area_ids, filter_members, in_range, outside
from tilewright.operators.keys import relation_keys
from tilewright.operators.tiling import TileTree


def key(rng, deepest):
    n = rng.randrange(deepest + 1)
    return sum(rng.choice([0, 0, 1, 3]) << (61 - 2 * i) for i in range(n)) + n


def test_assigned_tiles_equal_a_walk_upwards(spark):
    rng = random.Random(1)
    tiles = {key(rng, 5) for _ in range(40)}
    rows = [(k, rng.choice([None, -1, key(rng, 8), key(rng, 8)]), "x") for k in range(300)]
    got = tiling.assign_tiles(spark.createDataFrame(rows, "id int, quadtree bigint, tile_qt string"), spark.createDataFrame([(t,) for t in [*tiles, *tiles, None, -1] if t is None or True], "tile_qt bigint")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.quadtree is None or r.quadtree < 0:
            assert r.tile_qt is None
        else:
            assert r.tile_qt == next((u for n in range(r.quadtree & 31, -1, -1) if (u := TileTree.up(r.quadtree, n)) in tiles), 0)


def histogram(spark, weights):
    return spark.createDataFrame(list(weights.items()), "quadtree bigint, n bigint")


def test_totals_and_folding(spark):
    rng = random.Random(2)
    weights = {key(rng, 6): rng.randrange(1, 50) for _ in range(80)}
    tree = TileTree(weights)
    got = {r.quadtree: (r.own, r.total) for r in tiling.subtree_totals(histogram(spark, weights)).collect()}
    assert got == {q: (tree.own.get(q, 0), t) for q, t in tree.total.items()}
    now = dict(weights)
    for level in range(6, 0, -1):
        sums, nxt = {}, {}
        for q, n in now.items():
            if q & 31 >= level:
                sums[TileTree.up(q, level)] = sums.get(TileTree.up(q, level), 0) + n
        for q, n in now.items():
            small = q & 31 >= level and sums[TileTree.up(q, level)] < 60
            at = TileTree.up(q, level - 1) if small else q
            nxt[at] = nxt.get(at, 0) + n
        now = nxt
    assert {r.quadtree: r.n for r in tiling.rolled_up(histogram(spark, weights), 60, 6).collect()} == now


def test_groups_hold_everything_once(spark):
    rng = random.Random(3)
    weights = {key(rng, 7): rng.randrange(1, 60) for _ in range(300)}
    groups = TileTree(weights).groups(500, 100)
    assert sum(groups.values()) == sum(weights.values()) and len(groups) > 5
    assert all(n >= 100 for q, n in groups.items() if q)
    rows = tiling.grouped_tiles(histogram(spark, weights), 500, 100).orderBy("nth").collect()
    assert [r.tile_qt for r in rows] == sorted(groups) and [r.nth for r in rows] == list(range(1, len(groups) + 1))
    assert TileTree({}).groups(500, 100) == {} and TileTree({5: 3}).groups(500, 1) in ({0: 3}, {TileTree.up(5, 5): 3})


def test_blocks_and_parts(spark):
    ids = [(t, i) for t in (0, 1) for i in random.Random(4).sample(range(-500, 400_000), 900)]
    got = {(r.type, r.id): r.block for r in tiling.numbered_blocks(spark.createDataFrame(ids, "type int, id bigint"), 100, 1000).collect()}
    for t in (0, 1):
        assert [got[t, i] for i in sorted(i for u, i in ids if u == t)] == [k // 100 for k in range(900)]
    rows = spark.createDataFrame([(0, 2500), (0, 99_999), (1, 2500), (2, 2500), (3, 1)], "t int, i bigint").select(tiling.split_key(F.col("t"), F.col("i"), 1000, 200, 12).alias("k")).collect()
    assert [r.k for r in rows] == [2, 11, 23, 35, -1]


def test_circles_and_empty_relations_come_to_rest(spark):
    members = "id bigint, members array<struct<type:int,ref:bigint,role:string>>"
    deep = 1998382305151811602
    relations = spark.createDataFrame([(1, [(2, 2, ""), (0, 7, "")]), (2, [(2, 1, "")]), (3, []), (4, None), (5, [(0, 99, "")]), *[(n, [(2, n - 1, "")]) for n in range(11, 19)], (10, [(0, 7, "")])], members)
    keyed = spark.createDataFrame([(7, deep)], "id bigint, quadtree bigint")
    got = {r.id: r.quadtree for r in relation_keys(relations, keyed, keyed.limit(0)).collect()}
    assert got == {1: deep, 2: deep, 3: 0, 4: 0, 5: 0, **{n: deep for n in range(10, 19)}}


def test_areas_sets_and_members(spark):
    nodes = spark.createDataFrame([(1, 5, 5), (2, 50, 50), (3, 60, 60), (4, None, 5)], "id bigint, lon bigint, lat bigint")
    ways = spark.createDataFrame([(1, [1, 2, None, 9]), (2, [3]), (3, None), (4, [])], "id bigint, refs array<bigint>")
    relations = spark.createDataFrame([(1, [(1, 1, "a"), (1, 2, "b")]), (2, [(2, 1, "")]), (3, [(2, 3, "")]), (4, []), (5, None)], "id bigint, members array<struct<type:int,ref:bigint,role:string>>")
    ids = area_ids(nodes, ways, relations, (0, 0, 10, 10))
    assert {tuple(r) for r in ids.collect()} == {(0, 1), (0, 2), (0, 9), (1, 1), (2, 1), (2, 2)}
    assert {r.id: [m.role for m in r.members] for r in filter_members(relations, ids).collect()} == {1: ["a"], 2: [""]}
    assert area_ids(nodes, ways, relations, (10, 10, 0, 0)).count() == 0
    assert area_ids(nodes, ways, relations, (0, 0, 10, 10), [(0, 0), (1, 0), (1, 1)]).count() == 0
    assert outside(nodes.select(F.lit(0).alias("type"), "id"), ids).count() == 2
    assert [r.id for r in nodes.where(in_range(F.col("id"), 2, 4)).collect()] == [2, 3] and nodes.where(in_range(F.col("id"), 2, 0)).count() == 3


def test_dense_areas_are_divided(spark, tmp_path):
    rng = random.Random(5)
    top = TileTree.up(1998382305151811602, 9)
    weights = {}
    for _ in range(600):  # all in one tile of level 8
        deep = (top - 9) + sum(rng.randrange(4) << (61 - 2 * i) for i in range(9, 15)) + 15
        weights[deep] = rng.randrange(1, 100)
    spark.createDataFrame(list(weights.items()), "qt bigint, weight bigint").write.parquet(f"{tmp_path}/qt_items.parquet")
    got = {r.tile_qt: r.weight for r in group_tiles(spark, str(tmp_path)).collect()}
    assert got == TileTree(weights).groups(2000, 500) and len(got) > 5 and max(got.values()) < 10_000
    folded = {r.quadtree: r.n for r in qt_fold_small(spark, str(tmp_path)).collect()}
    assert sum(folded.values()) == sum(weights.values()) and len(folded) > 50
    light = {r.quadtree: r.n for r in tiling.without_light(histogram(spark, weights), 500).collect()}
    assert len(light) < len(weights) and TileTree(light).groups(2000, 500) == got


def plain_groups(weights, target, least, step=50):
    """The greedy choice over a nested tree, walked by recursion."""
    total, own, below = {}, dict(weights), {}
    for q, n in weights.items():
        for level in range((q & 31) + 1):
            total[TileTree.up(q, level)] = total.get(TileTree.up(q, level), 0) + n
    for q in total:
        if q & 31:
            below.setdefault(TileTree.up(q, (q & 31) - 1), []).append(q)
    chosen = {}
    inside = lambda q: sum(n for c, n in chosen.items() if TileTree.up(c, q & 31) == q and c & 31 >= q & 31)
    rest = lambda q: total[q] - inside(q)

    def walk(q, low, high):
        n = rest(q)
        if n < low or n <= 0:
            return 0
        if (own.get(q, 0) or n == total[q]) and (n == own.get(q, 0) or n <= high or all(rest(c) <= least for c in below.get(q, []))):
            chosen[q] = chosen.get(q, 0) + n
            return 1
        return sum(walk(c, low, high) for c in sorted(below.get(q, [])))

    low, high = target - step, target + step
    while total and rest(0) > 0:
        while rest(0) >= high and rest(0) != own.get(0, 0) and walk(0, low, high):
            pass
        if rest(0) < high or rest(0) == own.get(0, 0):
            break
        low, high = max(least, low - step), high + step
        if high > step * target:
            break
    if total and rest(0) > 0:
        chosen[0] = chosen.get(0, 0) + rest(0)
    return chosen


def test_groups_equal_a_plain_walk(spark):
    for seed in range(4):
        rng = random.Random(seed)
        weights = {key(rng, 6): rng.randrange(1, 90) for _ in range(150)}
        want = plain_groups(weights, 400, 60)
        assert TileTree(weights).groups(400, 60) == want
    assert {r.tile_qt: r.weight for r in tiling.grouped_tiles(histogram(spark, weights), 400, 60).collect()} == want
