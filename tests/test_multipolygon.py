from pyspark.sql import functions as F

from tilewright.functions.style import Style
from tilewright.operators.geometry import process_geometry, ways_with_nodes
from tilewright.operators.multipolygon import assemble, build_multipolygons, error_counts, join_chains

PLACES = {1: (0, 0), 2: (4, 0), 3: (4, 4), 4: (2, 6), 5: (0, 4), 6: (1, 1), 7: (2, 1), 8: (2, 2), 9: (1, 2), 11: (50, 50), 12: (51, 50), 13: (51, 51)}
METRES = {p: (float(p[0]), float(p[1])) for p in PLACES.values()}


def way(i, *refs):
    return i, list(refs), [PLACES[r] for r in refs]


def test_ways_join_end_to_end():
    chains = join_chains([way(1, 1, 2, 3), way(2, 5, 4, 3), way(3, 5, 1)])
    assert [c.refs() for c in chains] == [[1, 2, 3, 4, 5, 1]] and chains[0].closed
    assert [[p[0] for p in c.parts] for c in chains] == [[1, 2, 3]]
    later = join_chains([way(1, 1, 2), way(2, 3, 4), way(3, 4, 5, 1), way(4, 2, 3)])
    assert len(later) == 1 and later[0].closed


def test_rings_holes_and_errors():
    outer = [way(1, 1, 2, 3), way(2, 5, 4, 3), way(3, 5, 1)]
    hole, far = [way(4, 6, 7, 8, 9, 6)], [way(5, 11, 12, 13, 11)]
    polygons, area, error = assemble(outer, hole, METRES, None)
    assert error is None and len(polygons) == 1 and len(polygons[0]) == 2 and area == 20 - 1
    clockwise = lambda ring: sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:])) < 0
    assert clockwise(polygons[0][0]) and not clockwise(polygons[0][1])
    assert assemble(outer[:2], [], METRES, None) == (None, 0.0, "no outers!!!")
    assert assemble(outer, far, METRES, None)[2] == "orphan inner" and len(assemble(outer, far, METRES, None)[0][0]) == 1
    assert assemble(outer + [way(6, 6, 7)], [], METRES, None)[2] == "incomplete rings"
    assert assemble(far, [], METRES, (0, 0, 9, 9)) == (None, 0.0, None)


def frames(spark):
    tags = "tags array<struct<key:string,val:string>>"
    nodes = spark.createDataFrame([(i, x * 1000, y * 1000, [("highway", "crossing")] if i == 2 else []) for i, (x, y) in PLACES.items()], f"id bigint, lon bigint, lat bigint, {tags}")
    ways = spark.createDataFrame([(1, [1, 2, 3], [("highway", "footway")]), (2, [5, 4, 3], []), (3, [5, 1], None), (4, [6, 7, 8, 9, 6], [("building", "yes")]), (5, [2, 3], [("highway", "primary")]), (6, [1, 99], [("highway", "track")]), (7, [], []), (8, None, None)], f"id bigint, refs array<bigint>, {tags}")
    members = [(1, 1, "outer"), (1, 2, ""), (1, 3, None), (1, 4, "inner"), (1, 5, "via"), (0, 1, "outer"), (1, 77, "outer")]
    relations = spark.createDataFrame([(1, members, [("type", "multipolygon"), ("natural", "wood")]), (2, members[:1], [("type", "boundary"), ("boundary", "administrative"), ("admin_level", "8;9")]), (3, [], [("type", "multipolygon")]), (4, None, None), (5, members, [("type", "route")])], f"id bigint, members array<struct<type:int,ref:bigint,role:string>>, {tags}")
    return nodes, ways, relations


def test_relations_to_polygons(spark):
    nodes, ways, relations = frames(spark)
    got = {r.id: r for r in build_multipolygons(relations, ways_with_nodes(ways, nodes), Style()).collect()}
    assert set(got) == {1, 2}
    assert len(got[1].rings[0]) == 2 and got[1].error is None and [t.key for t in got[1].tags] == ["natural"]
    assert got[2].rings is None and got[2].error == "no outers!!!"
    made = build_multipolygons(relations, ways_with_nodes(ways, nodes), Style())
    assert [tuple(r) for r in error_counts(made).collect()] == [("no outers!!!", 1, 2, 2)]
    assert build_multipolygons(relations, ways_with_nodes(ways, nodes), Style(boundaries=False)).select("id").collect() == [(1,)]


def test_all_geometries(spark):
    rows = {(r.type, r.id): r for r in process_geometry(*frames(spark)).collect()}
    assert set(rows) == {(3, 2), (4, 1), (5, 4), (4, 5), (6, 1)}
    assert {t.key: t.val for t in rows[3, 2].tags} == {"highway": "crossing", "parent_highway": "primary"}
    assert {t.key: t.val for t in rows[4, 1].tags} == {"highway": "footway", "min_admin_level": "8", "max_admin_level": "8"}
    assert rows[5, 4].area > 0 and rows[4, 5].length > 0 and rows[4, 5].zorder == 360
    assert process_geometry(*frames(spark), box=(90_000, 90_000, 99_000, 99_000)).count() == 0
    every = {(r.type, r.id): r.minzoom for r in process_geometry(*frames(spark), zoom=F.when(F.col("type") == 4, 3).otherwise(9).cast("bigint")).collect()}
    assert every[4, 1] == every[4, 5] == 3 and every[3, 2] == 9 and set(every) == set(rows)
    assert {(r.type, r.id) for r in process_geometry(*frames(spark), max_zoom=5, zoom=F.when(F.col("type") == 4, 3).cast("bigint")).collect()} == {(4, 1), (4, 5)}
    # nodes that don't show by themselves still place the ways through them
    plain = Style(parent_tags=(), relation_tags=(), multipolygons=False, boundaries=False)
    assert {(r.type, r.id) for r in process_geometry(*frames(spark), style=plain, max_zoom=13).where("type <> 5").collect()} == {(4, 1), (4, 5)}
