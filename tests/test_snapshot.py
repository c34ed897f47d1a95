import pytest
from pyspark.sql import functions as F

from tilewright.functions.quadtree import common, key_of_point
from tilewright.operators.overlay import apply_changes, overlay
from tilewright.schema import COLUMNS, ELEMENT
from tilewright.sources.snapshot import compact, drop_last, file_list, ids_of_area, init_snapshot, read_snapshot, tile_count, update_snapshot
from tilewright.streaming.updates import follow, keep_newest

AT = {1: (100_000_000, 500_000_000), 2: (100_010_000, 500_010_000), 3: (100_020_000, 500_000_000), 4: (-900_000_000, 100_000_000), 5: (-900_010_000, 100_010_000)}


def node(i, change=0, version=1, at=None, tags=()):
    lon, lat = at or AT[i]
    return (0, i, change, -1, (version, 100, 1, 1, "u", True), list(tags), lon, lat, None, None)


def way(i, refs, change=0, version=1):
    return (1, i, change, -1, (version, 100, 1, 1, "u", True), [("highway", "path")], None, None, refs, None)


def relation(i, members, change=0, version=1):
    return (2, i, change, -1, (version, 100, 1, 1, "u", True), [], None, None, None, members)


@pytest.fixture
def root(spark, tmp_path):
    from tilewright.operators.keys import node_keys, relation_keys, way_keys

    rows = spark.createDataFrame([node(i) for i in AT] + [way(10, [1, 2]), way(11, [4, 5])] + [relation(20, [(1, 10, ""), (1, 99, "")]), relation(21, [(2, 20, "")])], ELEMENT)
    nodes, ways, relations = (rows.where(f"type = {k}") for k in range(3))
    wq = way_keys(ways, nodes)
    nq = node_keys(nodes, ways, wq)
    keys = nq.select(F.lit(0).alias("type"), "id", "quadtree").union(wq.select(F.lit(1), "id", "quadtree")).union(relation_keys(relations, nq, wq).select(F.lit(2), "id", "quadtree"))
    keyed = rows.drop("quadtree").join(keys, ["type", "id"]).select(*COLUMNS)
    tiles = keyed.select(F.col("quadtree").alias("tile_qt")).distinct().union(spark.createDataFrame([(0,)], "tile_qt bigint"))
    init_snapshot(keyed, tiles, str(tmp_path), 1000)
    return str(tmp_path)


def state(df):
    return {(r.type, r.id): r for r in df.collect()}


def test_updates_as_of_and_dropping(spark, root):
    assert set(state(read_snapshot(spark, root))) == {(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 10), (1, 11), (2, 20), (2, 21)}
    changes = spark.createDataFrame([node(3, 4, 2, AT[5]), node(4, 1, 2), way(10, [1, 2, 4], 4, 2), node(1, 4, 1, (7, 7))], ELEMENT).withColumn("file_idx", F.lit(1))
    entry = update_snapshot(changes, root, 2000)
    assert entry["NumTiles"] > 0 and len(file_list(root)) == 2
    now = state(read_snapshot(spark, root))
    assert (0, 4) not in now and now[0, 3].lon == AT[5][0] and now[1, 10].refs == [1, 2, 4]
    assert all(r.changetype == 0 for r in now.values())
    before = state(read_snapshot(spark, root, as_of=1500))
    assert (0, 4) in before and before[1, 10].refs == [1, 2]
    with pytest.raises(ValueError):
        read_snapshot(spark, root, as_of=1)
    assert drop_last(root)["EndDate"] == 2000 and set(state(read_snapshot(spark, root))) == set(before)
    with pytest.raises(ValueError):
        drop_last(root)


def test_only_coarser_keys_for_what_hangs_on_a_change(spark, root):
    old = state(read_snapshot(spark, root))
    changes = spark.createDataFrame([way(10, [1, 4], 4, 2)], ELEMENT).withColumn("file_idx", F.lit(1))
    update_snapshot(changes, root, 2000)
    new = state(read_snapshot(spark, root))
    pairs = spark.createDataFrame([(old[k].quadtree, new[k].quadtree) for k in [(0, 1), (0, 4), (2, 20)]], "a bigint, b bigint")
    assert all(r.c == r.b for r in pairs.select("b", common("a", "b").alias("c")).collect())
    assert new[0, 1].quadtree == new[1, 10].quadtree == 0 and new[0, 3].quadtree == old[0, 3].quadtree
    assert new[2, 21].quadtree == old[2, 21].quadtree  # one step up only


def test_areas_and_compaction(spark, root):
    box = (99_000_000, 499_000_000, 100_015_000, 501_000_000)
    rows = state(compact(spark, root, box=box))
    assert {k for k in rows} == {(0, 1), (0, 2), (1, 10), (2, 20), (2, 21)}
    assert [tuple(m) for m in rows[2, 20].members] == [(1, 10, "")]
    assert [(r.type, r.id) for r in compact(spark, root).collect()] == sorted((r.type, r.id) for r in read_snapshot(spark, root).collect())
    assert {(r.type, r.id) for r in ids_of_area(spark, root, box).collect()} == {(0, 1), (0, 2), (1, 10), (2, 20), (2, 21)}
    assert 0 < tile_count(spark, root, box=box) < tile_count(spark, root)
    ring = [(99_000_000, 499_000_000), (100_015_000, 499_000_000), (100_015_000, 501_000_000), (99_000_000, 501_000_000)]
    assert set(state(compact(spark, root, ring=ring))) == set(rows)
    with pytest.raises(ValueError):
        read_snapshot(spark, root, box=(5, 5, 4, 4))


def test_stream_of_change_files(spark, root, tmp_path_factory):
    folder = tmp_path_factory.mktemp("changes")
    schema = ELEMENT + ", file_idx int"
    for n, rows in enumerate([[node(3, 1, 2)], [node(3, 4, 3), node(4, 1, 2)]]):
        spark.createDataFrame([(*r, n) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))
    follow(spark, str(folder), schema, root, lambda n: 2000 + n)
    follow(spark, str(folder), schema, root, lambda n: 2000 + n)  # nothing new
    assert len(file_list(root)) == 3
    now = state(read_snapshot(spark, root))
    assert (0, 4) not in now and now[0, 3].info.version == 3


def test_newest_of_a_stream_and_of_no_files(spark, tmp_path):
    schema = ELEMENT + ", file_idx int"
    empty = tmp_path / "empty"
    empty.mkdir()
    assert keep_newest(spark, str(empty), schema, ["type", "id"]).collect() == []
    for n, rows in enumerate([[node(3, 4, 2)], [node(3, 4, 1), node(4, 1, 2)], [node(3, 1, 2)]]):
        spark.createDataFrame([(*r, n) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "full"))
    got = {r.id: (r.changetype, r.file_idx) for r in keep_newest(spark, str(tmp_path / "full"), schema, ["id", "changetype", "file_idx"]).collect()}
    assert got == {3: (4, 0), 4: (1, 1)}


BASE = "tile_qt bigint, type int, id bigint, changetype int, v int"


def test_overlay_rules(spark):
    base = spark.createDataFrame([(7, 0, 1, 0, 0), (7, 0, 2, 0, 0), (7, 0, 3, 0, 0), (8, 0, 9, 1, 0)], BASE)
    deltas = spark.createDataFrame([(7, 0, 2, 4, 1, 1), (7, 0, 4, 5, 1, 1), (7, 0, 3, 1, 2, 2), (7, 0, 4, 4, 2, 2), (7, 0, 1, 2, 2, 2), (99, 0, 5, 5, 2, 2)], BASE + ", file_idx int")
    assert sorted(tuple(r) for r in overlay(base, deltas).collect()) == [(7, 0, 2, 0, 1), (7, 0, 4, 0, 2), (8, 0, 9, 1, 0)]
    assert len(overlay(base, deltas, apply=False).collect()) == 5
    assert sorted(tuple(r) for r in overlay(base, deltas.limit(0)).collect()) == sorted(tuple(r) for r in base.collect())


def test_apply_changes(spark):
    base = spark.createDataFrame([node(1), node(2), node(3)], ELEMENT)
    changes = spark.createDataFrame([node(1, 4, 2), node(1, 4, 3), node(2, 1, 2), node(3, 3, 1), node(4, 5, 1)], ELEMENT).withColumn("file_idx", F.lit(1))
    got = {r.id: (r.changetype, r.info.version) for r in apply_changes(base, changes).collect()}
    assert got == {1: (0, 3), 4: (0, 1)}
    assert spark.createDataFrame([AT[1]], "x bigint, y bigint").select(key_of_point("x", "y").alias("q")).first().q > 0
