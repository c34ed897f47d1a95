"""Block files: index, what is decoded, geometries, and what must be refused."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_sources import elements
from tilewright.functions.quadtree import from_xyz, from_xyz_int, tile_bbox, tile_box
from tilewright.schema import COLUMNS, ELEMENT
from tilewright.sources import wire
from tilewright.sources.geometry_blocks import GEOMETRY, pack_bounds, pack_polygon_part, pack_ring, read_geometry_blocks, ring_points, unpack_bounds, unpack_polygon_part, unpack_ring, write_geometry_blocks
from tilewright.sources.pbf import block_frames, decode_block, encode_block, read_header, read_pbf, uncompressed_size, write_pbf

ADB = 1997346434738814982  # a tile of depth 6
TILES = [from_xyz_int(x, y, 3) for x in range(4) for y in range(2)]


def frame_of(spark):
    rows = [(*r[:-1], TILES[r[-1] % len(TILES)]) for r in elements()]
    return spark.createDataFrame(rows, ELEMENT + ", tile_qt bigint").repartition(2, "tile_qt").sortWithinPartitions("tile_qt", "type", "id")


@pytest.mark.parametrize("index", ["header", "beside", None])
def test_only_blocks_of_tiles_that_touch_are_read(spark, tmp_path, index):
    df = frame_of(spark)
    paths = write_pbf(df, str(tmp_path / "out"), index=index)
    west = tile_box(TILES[0], 0.0)
    box = (west[0] + 10, west[1] + 10, west[2] - 10**8, west[3] - 10)
    got = read_pbf(spark, paths, box=box)
    assert {r.tile_qt for r in got.select("tile_qt").distinct().collect()} == {t for t in TILES if tile_box(t)[0] <= box[2] and tile_box(t)[2] >= box[0] and tile_box(t)[1] <= box[3] and tile_box(t)[3] >= box[1]}
    frames, indexed = block_frames(paths, box=box)
    every, _ = block_frames(paths)
    assert indexed == (index is not None) and (len(frames) < len(every)) == indexed
    some = read_pbf(spark, paths, tiles=[TILES[1]])
    assert some.select("tile_qt").distinct().collect() == [(TILES[1],)] and some.count() == df.where(F.col("tile_qt") == TILES[1]).count()
    if index:
        assert len(read_header(paths[0])["index"]) > 1
        with pytest.raises(ValueError):
            read_pbf(spark, paths, box=(1_700_000_000, -800_000_000, 1_700_000_001, -700_000_000))


def test_columns_ids_and_dates(spark, tmp_path):
    df = frame_of(spark)
    paths = write_pbf(df, str(tmp_path / "out"), dates=(5, 77))
    few = read_pbf(spark, paths, columns=["type", "id", "quadtree", "end_date"], kinds=(0, 2))
    assert few.columns == ["type", "id", "quadtree", "end_date"] and few.select("end_date").distinct().collect() == [(77,)]
    assert sorted(tuple(r) for r in few.select("type", "id", "quadtree").collect()) == sorted(tuple(r) for r in df.where("type <> 1").select("type", "id", "quadtree").collect())
    wanted = [(r.type, r.id) for r in df.select("type", "id").orderBy("id").limit(9).collect()] + [(0, -5)]
    got = read_pbf(spark, paths, ids=wanted)
    assert sorted((r.type, r.id) for r in got.select("type", "id").collect()) == sorted(wanted[:-1])
    assert sorted(map(str, got.select(*COLUMNS).collect())) == sorted(map(str, df.join(spark.createDataFrame(wanted, "type int, id bigint"), ["type", "id"], "left_semi").select(*COLUMNS).collect()))


def test_null_stays_null(spark, tmp_path):
    rows = [(0, 1, 1, None, None, None, None, None, None, None), (0, 2, 4, 5, (3, None, None, None, None, False), [("", "")], 7, None, None, None), (1, 3, 0, -1, None, [("a", None)], None, None, [1, None, 2], None), (2, 4, 0, 0, None, [], None, None, None, [(1, 5, None), (None, 6, "x")]), (0, None, 0, 0, None, [], 1, 1, None, None)]
    paths = write_pbf(spark.createDataFrame(rows, ELEMENT).coalesce(1), str(tmp_path / "out"))
    got = {r.id: r for r in read_pbf(spark, paths).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1].lon, got[1].lat, got[1].info, got[1].quadtree, got[1].tags) == (None, None, None, -1, [])
    assert (got[2].lon, got[2].lat, got[2].info.version, got[2].info.user, got[2].info.visible, [tuple(t) for t in got[2].tags]) == (7, None, 3, None, False, [("", "")])
    assert got[3].refs == [1, 2] and [tuple(m) for m in got[4].members] == [(1, 5, "")]


def test_unknown_compression_and_wrong_sizes_are_refused(spark, tmp_path):
    data = encode_block([], 3)
    for blob in (wire.field(2, 9) + wire.field(7, b"zstd"), b"", wire.field(2, 99) + wire.field(3, __import__("zlib").compress(data))):
        with pytest.raises(ValueError):
            wire.open_blob(blob)
    head = wire.field(1, b"OSMData") + wire.field(3, 6)
    path = tmp_path / "z.pbf"
    path.write_bytes(len(head).to_bytes(4, "big") + head + wire.field(7, b"zstd"))
    for read in (lambda: read_pbf(spark, str(path)).collect(), lambda: uncompressed_size(spark, str(path)).collect()):
        with pytest.raises(Exception, match="without plain or zlib"):
            read()


def test_blocks_of_other_writers(spark):
    """Old forms of tiles, single nodes, dense nodes without info, and empty values of number 0."""
    strings = wire.field(1, b"".join(wire.field(1, s) for s in (b"", b"k", b"v")))
    tile = wire.field(31, wire.field(1, 5) + wire.field(2, 2) + wire.field(3, 3))
    dense = wire.field(2, wire.field(1, wire.deltas([4, 9])) + wire.field(8, wire.deltas([1, 2])) + wire.field(9, wire.deltas([3, 4])) + wire.field(10, wire.many([1, 0, 0, 1, 2, 0])))
    single = wire.field(1, wire.field(1, wire.zigzag(-7)) + wire.field(8, wire.zigzag(5)) + wire.field(9, wire.zigzag(6)))
    rows = decode_block(strings + wire.field(2, dense + single + wire.field(10, 4)) + tile, {0}).to_pylist()
    assert [(r["id"], r["lon"], r["lat"], r["changetype"], r["info"], [tuple(t.values()) for t in r["tags"]]) for r in rows] == [(4, 3, 1, 4, None, [("k", "")]), (9, 4, 2, 4, None, [("k", "v")]), (-7, 6, 5, 4, None, [])]
    assert {r["tile_qt"] for r in rows} == {from_xyz_int(5, 2, 3)} == {spark.range(1).select(from_xyz(F.lit(5), F.lit(2), F.lit(3))).first()[0]}
    with pytest.raises(ValueError):
        decode_block(wire.field(2, wire.field(2, wire.field(1, wire.deltas([1])) + wire.field(10, wire.many([9, 9, 0])))), {0})


def test_plain_tile_box(spark):
    keys = [ADB, 0, TILES[3], 1998382305151811602]
    rows = spark.createDataFrame([(k,) for k in keys], "q bigint").select("q", tile_bbox("q", 0.05).alias("b")).collect()
    assert all(max(abs(a - b) for a, b in zip(r.b, tile_box(r.q))) <= 1 for r in rows)


def shapes(spark):
    rng = random.Random(9)
    spot = lambda: (rng.randrange(-(10**9), 10**9), rng.randrange(-(10**8), 10**8))
    ring = lambda: (lambda p: [*p, p[0]])([spot() for _ in range(4)])
    rows = []
    for k in range(200):
        kind = 3 + k % 4
        line = [spot()] if kind == 3 else ring()
        rows.append((kind, k, rng.choice([-1, 5]), [("name", "ü")], rng.choice([None, -2, 3]), None if kind == 3 else rng.choice([None, 40]), rng.choice([None, 0, 14]), None if kind == 6 else line, [[ring(), ring()], [ring()]] if kind == 6 else None, 12.34 if kind == 4 else None, 56.78 if kind > 4 else None, k % 8 == 2 if kind == 5 else None, TILES[k % 3]))
    return spark.createDataFrame(rows, GEOMETRY)


def test_geometries_round_trip(spark, tmp_path):
    df = shapes(spark).repartition(2, "tile_qt").sortWithinPartitions("tile_qt", "type", "id")
    paths = write_geometry_blocks(df, str(tmp_path / "out"))
    back = read_geometry_blocks(spark, paths)
    plain = lambda d: sorted(str(r) for r in d.select(*[F.round(c, 2).alias(c) if c in ("length", "area") else F.col(c) for c in df.columns]).collect())
    assert plain(back) == plain(df)
    assert read_geometry_blocks(spark, paths, kinds=(4,)).select("type").distinct().collect() == [(4,)]
    assert read_pbf(spark, paths).count() == 0
    assert write_geometry_blocks(df.limit(0), str(tmp_path / "none")) == []


def test_packed_forms():
    for box in ((0, 0, 0, 0), (-1396598, 514858926, -734935, 515353624)):
        assert unpack_bounds(pack_bounds(box)) == box
    part = lambda refs, back: {"id": 7, "refs": refs, "lonlats": [{"lon": r, "lat": -r} for r in refs], "reversed": back}
    ring = [part([1, 2, 3], False), part([5, 4, 3], True), part([5, 1], False)]
    assert unpack_ring(pack_ring(ring)) == ring and ring_points(ring, "refs") == [1, 2, 3, 4, 5, 1] and unpack_ring(b"") == [] and ring_points([]) == []
    assert unpack_polygon_part(pack_polygon_part(3, ring, [ring], -1.25)) == {"index": 3, "outer": ring, "inners": [ring], "area": -1.25}
