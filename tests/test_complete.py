"""Nothing is lost or decided by row order: ties of changes, keys of elements, doubled elements, tiles that an update reads."""

import pytest
from pyspark.sql import functions as F

from tests.test_snapshot import AT, node, relation, way
from tests.test_snapshot import root as root  # noqa: F401
from tests.test_snapshot import state
from tilewright.operators.overlay import changed_keys, newest_changes
from tilewright.operators.tiling import joined_keys, numbered_blocks, with_keys
from tilewright.schema import ELEMENT
from tilewright.sources.osc import read_osc
from tilewright.sources.snapshot import read_snapshot, tiles_to_read, update_snapshot

KEYS = "type int, id bigint, quadtree bigint"


def test_ties_do_not_depend_on_row_order(spark):
    rows = [node(1, 4, 2, (k, 7)) for k in range(12)] + [node(1, 5, 2, (99, 7)), node(1, 4, 1, (500, 7))]
    for some in (rows, rows[::-1]):
        got = newest_changes(spark.createDataFrame([(*r, 1) for r in some], ELEMENT + ", file_idx int").repartition(4)).collect()
        assert [(r.changetype, r.lon) for r in got] == [(5, 99)]
    placed = spark.createDataFrame([(*r, 1, 100 - k) for k, r in enumerate(rows[:12])], ELEMENT + ", file_idx int, pos int")
    assert newest_changes(placed).first().lon == 11


def test_first_of_a_change_file(spark, tmp_path):
    nodes = "".join(f'<node id="{i}" version="2" lat="{k}" lon="1"/>' for k in range(3) for i in (1, 2))
    (tmp_path / "a.osc").write_text(f'<osmChange version="0.6"><modify>{nodes}</modify><modify><node id="1" version="2" lat="9" lon="1"/><way id="1" version="2"/></modify></osmChange>')
    got = newest_changes(read_osc(spark, str(tmp_path / "a.osc"), 1))
    assert {(r.type, r.id): r.lat for r in got.collect()} == {(0, 1): 0, (0, 2): 0, (1, 1): None}


def test_elements_need_a_key(spark):
    rows = spark.createDataFrame([node(1), node(2)], ELEMENT)
    keys = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (0, 3, 7)], KEYS)
    assert {r.id: r.quadtree for r in with_keys(rows, keys).collect()} == {1: 5, 2: 6}
    for bad in (keys.where("id <> 2"), keys.union(keys.where("id = 1"))):
        with pytest.raises(Exception, match="key"):
            with_keys(rows, bad).collect()


def test_stores_must_not_overlap(spark):
    one, two = (spark.createDataFrame(r, KEYS) for r in ([(0, 1, 5)], [(1, 1, 6)]))
    assert joined_keys([one, two]).count() == 2
    with pytest.raises(Exception, match="share"):
        joined_keys([one, two, one]).collect()


def test_blocks_refuse_doubled_elements(spark):
    rows = spark.createDataFrame([(0, k) for k in [*range(50), 7]], "type int, id bigint")
    assert numbered_blocks(rows, 10).count() == 51
    with pytest.raises(Exception, match="twice"):
        numbered_blocks(rows, 10, strict=True).collect()


def test_an_update_reads_only_what_it_touches(spark, root):  # noqa: F811
    every = {r.tile_qt for r in read_snapshot(spark, root).select("tile_qt").distinct().collect()}
    at = {k: r.tile_qt for k, r in state(read_snapshot(spark, root)).items()}
    newest = spark.createDataFrame([(*node(3, 4, 2), 1)], ELEMENT + ", file_idx int")
    assert {r.tile_qt for r in tiles_to_read(root, newest).collect()} == {at[0, 3]} != every
    moved = spark.createDataFrame([(*way(10, [1, 4], 4, 2), 1)], ELEMENT + ", file_idx int")
    assert {r.tile_qt for r in tiles_to_read(root, moved).collect()} == {at[k] for k in [(1, 10), (0, 1), (0, 4), (2, 20)]}
    # what a delta moved is found where it is now
    update_snapshot(spark.createDataFrame([node(3, 4, 2, AT[5])], ELEMENT).withColumn("file_idx", F.lit(1)), root, 2000)
    now = state(read_snapshot(spark, root))[0, 3].tile_qt
    assert now in {r.tile_qt for r in tiles_to_read(root, newest).collect()}
    update_snapshot(spark.createDataFrame([node(3, 1, 3)], ELEMENT).withColumn("file_idx", F.lit(1)), root, 3000)
    assert (0, 3) not in state(read_snapshot(spark, root))


def test_missing_nodes_and_users(spark, root):  # noqa: F811
    changes = spark.createDataFrame([way(12, [1, 77, 78], 5, 1)], ELEMENT).withColumn("file_idx", F.lit(1))
    with pytest.raises(ValueError, match="missing"):
        update_snapshot(changes, root, 2000, most_missing=1)
    update_snapshot(changes, root, 2000, most_missing=2)
    from tilewright.sources import snapshot

    snapshot._write(root, "settings.json", {**snapshot.settings(root), "AllowMissingUsers": False})
    nameless = changes.withColumn("info", F.col("info").withField("user", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="user"):
        update_snapshot(nameless, root, 3000)


def test_relations_follow_members(spark):
    nodes, ways = spark.createDataFrame([(1, 5, *AT[1])], "id bigint, quadtree bigint, lon bigint, lat bigint"), spark.createDataFrame([], "id bigint, quadtree bigint, refs array<bigint>")
    rows = spark.createDataFrame([relation(20, [(0, 1, "")])], ELEMENT)
    changes = spark.createDataFrame([(*node(1, 4, 2, AT[4]), 1)], ELEMENT + ", file_idx int")
    got = {(r.type, r.id) for r in changed_keys(nodes, ways, rows, changes).collect()}
    assert got == {(0, 1), (2, 20)}
