import gzip
import random
import struct

import pytest

from tilewright.schema import COLUMNS, ELEMENT
from tilewright.sources.osc import parse_box, read_osc, read_ring
from tilewright.sources.pbf import frame, frame_index, packed_deltas, read_header, read_pbf, uncompressed_size, unzigzag, write_pbf, zigzag

OSC = """<?xml version="1.0"?>
<osmChange version="0.6">
 <create><node id="1" version="1" timestamp="2019-11-14T00:00:01Z" changeset="5" uid="7" user="A &amp; ü" lat="51.4858926" lon="-0.1396598"><tag k="a" v="b"/><tag k="a" v=""/></node><node id="-2" version="1" lat="1" lon="2"/></create>
 <modify><way id="3" version="2" timestamp="2019-11-14"><nd ref="1"/><nd ref="2"/></way><relation id="4" version="9"><member type="way" ref="3" role="outer"/><member type="node" ref="1" role=""/></relation></modify>
 <modify><way id="5" version="2"/></modify>
 <delete><node id="6" version="3"/></delete>
</osmChange>
"""


@pytest.mark.parametrize("packed", [False, True])
def test_change_files(spark, tmp_path, packed):
    path = tmp_path / ("x.osc.gz" if packed else "x.osc")
    path.write_bytes(gzip.compress(OSC.encode()) if packed else OSC.encode())
    rows = {(r.type, r.id): r for r in read_osc(spark, str(path), 4).collect()}
    assert set(rows) == {(0, 1), (0, -2), (1, 3), (2, 4), (1, 5), (0, 6)}
    one = rows[0, 1]
    assert (one.changetype, one.lon, one.lat, one.quadtree, one.file_idx) == (5, -1396598, 514858926, -1, 4)
    assert (one.info.timestamp, one.info.user, one.info.user_id, one.info.visible) == (1573689601, "A & ü", 7, True)
    assert [tuple(t) for t in one.tags] == [("a", "b"), ("a", "")]
    assert rows[1, 3].refs == [1, 2] and rows[1, 3].info.timestamp == 1573689600 and rows[1, 5].refs == [] and rows[0, -2].info.timestamp is None
    assert [tuple(m) for m in rows[2, 4].members] == [(1, 3, "outer"), (0, 1, "")]
    assert rows[0, 6].changetype == 1 and rows[0, 6].lon is None and rows[0, 6].info.visible is False


def test_areas(tmp_path):
    (tmp_path / "a.poly").write_text("name\n1\n  1.5 2.5\n -1.00000005 0\nEND\nEND\n")
    assert read_ring(str(tmp_path / "a.poly")) == [(15_000_000, 25_000_000), (-10_000_001, 0)]
    assert parse_box("[-1, 2,3,-4]") == (-1, 2, 3, -4) and parse_box("planet")[2] == 1_800_000_000
    with pytest.raises(ValueError):
        parse_box("1,2,3")


def elements():
    rng = random.Random(2)
    out = []
    for k in range(700):
        kind = rng.choice([0, 0, 1, 2])
        info = (rng.randrange(1, 9), rng.randrange(10**9), rng.randrange(10**8), rng.randrange(9), rng.choice(["ü", "bob"]), rng.random() < 0.9)
        tags = [(rng.choice("abc"), rng.choice(["", "x", "日本"])) for _ in range(rng.randrange(3))]
        lon, lat = (rng.randrange(-(10**9), 10**9), rng.randrange(-(10**8), 10**8)) if kind == 0 else (None, None)
        refs = [rng.randrange(-5, 10**10) for _ in range(rng.randrange(4))] if kind == 1 else None
        members = [(rng.randrange(3), rng.randrange(10**10), rng.choice(["", "outer"])) for _ in range(rng.randrange(4))] if kind == 2 else None
        out.append((kind, k * 3, rng.choice([0, 0, 4]), rng.choice([-1, 0, 1998375577622413322]), info, tags, lon, lat, refs, members, k // 100))
    return out


def test_block_files_round_trip(spark, tmp_path):
    rows = elements()
    df = spark.createDataFrame(rows, ELEMENT + ", tile_qt bigint").repartitionByRange(3, "tile_qt").sortWithinPartitions("tile_qt", "type", "id")
    paths = write_pbf(df, str(tmp_path / "out"), box=(-10, -20, 30, 40))
    assert len(paths) == 3
    back = read_pbf(spark, paths)
    plain = lambda d: sorted(str(r) for r in d.select(*COLUMNS, "tile_qt").collect())
    assert plain(back) == plain(df)
    assert read_pbf(spark, paths, kinds=(1,)).select("type").distinct().collect() == [(1,)]
    header = read_header(paths[0])
    assert header["bbox"] == (-10, -20, 30, 40) and header["features"] == ["OsmSchema-V0.6", "DenseNodes"]
    assert all(r.size > 100 and r.blocks > 1 for r in uncompressed_size(spark, paths).collect())


def test_broken_files_are_refused(tmp_path):
    path = tmp_path / "x.pbf"
    path.write_bytes(frame("OSMData", b"abc")[:-2] + b"\0\0")
    assert len(frame_index(str(path))) == 1
    path.write_bytes(b"\0\0")
    with pytest.raises(ValueError):
        frame_index(str(path))
    path.write_bytes(frame("OSMData", b""))
    with pytest.raises(ValueError):
        read_header(str(path))


def test_numbers():
    for v in (0, 1, -1, 2**40, -(2**40), 2**62, -(2**62)):
        assert unzigzag(zigzag(v)) == v
    assert packed_deltas(b"").tolist() == [] and packed_deltas(bytes([2, 1, 0x90, 3])).tolist() == [1, 0, 200]
    assert struct.calcsize(">I") == 4
