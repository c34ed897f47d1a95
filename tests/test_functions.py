import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geo
from tilewright.functions import tags as T
from tilewright.functions.style import FEATURE_KEYS, MIN_ZOOM, POLYGON_TAGS, ParentTag, Style, read_style

TAGS = "tags array<struct<key:string,val:string>>"


def of(spark, tags, *columns):
    return tuple(spark.createDataFrame([(tags,)], TAGS).select(*columns).first())


def pairs(tags):
    return [tuple(t) for t in tags]


def test_filter_layer_and_first_or_last(spark):
    tags = F.col("tags")
    some = [("building", "yes"), ("note", "x"), ("tiger:county", "y"), ("name", "z"), ("layer", "-1"), ("name", "w"), (None, "q")]
    kept, layer, first, last, none = of(spark, some, T.filter_tags(tags, FEATURE_KEYS, None, ["note", "tiger:"]), T.layer(tags), T.find_tag(tags, "name"), T.last_tag(tags, "name"), T.find_tag(tags, "no"))
    assert pairs(kept) == [("building", "yes"), ("name", "z"), ("layer", "-1"), ("name", "w")]
    assert (layer, first, last, none) == (-1, "z", "w", None)
    assert pairs(of(spark, some, T.filter_tags(tags, FEATURE_KEYS, ["name"], []))[0]) == [("building", "yes"), ("name", "z"), ("name", "w")]


@pytest.mark.parametrize("empty", [None, []])
def test_no_tags(spark, empty):
    tags = F.col("tags")
    got = of(spark, empty, F.size(T.filter_tags(tags, FEATURE_KEYS, None, [])), T.is_polygon(tags, POLYGON_TAGS), T.z_order(tags), T.tag_zoom(tags, [1, 2], tuple(MIN_ZOOM)), T.is_feature(tags, FEATURE_KEYS), T.layer(tags), T.find_tag(tags, "a"), T.last_tag(tags, "a"))
    assert got == (0, False, None, None, False, None, None, None)


def test_polygon_order_zoom(spark):
    tags = F.col("tags")
    columns = (T.is_polygon(tags, POLYGON_TAGS), T.z_order(tags))
    assert of(spark, [("natural", "coastline")], *columns) == (False, None)
    assert of(spark, [("natural", "wood"), ("highway", "motorway"), ("railway", "rail")], *columns) == (True, 440)
    assert of(spark, [("highway", "construction")], *columns) == (False, None)
    assert of(spark, [("highway", "services")], *columns) == (True, None)
    table = ((0, "shop", "*", 17), (0, "shop", "bakery", 18), (2, "shop", "mall", 10), (2, "shop", "mall", 17))
    assert of(spark, [("shop", "bakery")], T.tag_zoom(tags, [0], table)) == (18,)
    assert of(spark, [("shop", "mall")], T.tag_zoom(tags, [1, 2], table)) == (10,)


def test_texts(spark):
    tags = F.col("tags")
    some = [("b", 'say "x"\\\n'), ("a", "1"), ("a", "2"), ("c", None), (None, "z")]
    hstore, json, fixed = of(spark, some, T.as_hstore(tags), T.as_json(tags), T.fix_tags(F.array(F.struct(F.lit("k\x7f").alias("key"), F.lit("v\x7f").alias("val")))))
    assert hstore == '"b"=>"say \\"x\\"\\\\","a"=>"1","a"=>"2","c"=>NULL'
    assert json == '{"a":"1","b":"say \\"x\\"\\\\\\n","c":null}'
    assert pairs(fixed) == [("k", "v")]
    assert [r[0] for r in spark.createDataFrame([("4",), (" 2;3",), ("x",), ("-7a",), ("9" * 30,), (None,)], "v string").select(T.leading_number(F.col("v"))).collect()] == [4, 2, None, -7, None, None]


def test_set_and_remove(spark):
    tags = F.col("tags")
    set_, kept, removed = of(spark, [("a", "1"), ("b", "2")], T.set_tag(tags, "a", F.lit("9")), T.set_tag(tags, "a", F.lit(None).cast("string")), T.remove_tag(tags, "b"))
    assert pairs(set_) == [("b", "2"), ("a", "9")] and pairs(kept) == [("a", "1"), ("b", "2")] and pairs(removed) == [("a", "1")]


SQUARE = [(0, 0), (10_000_000, 0), (10_000_000, 10_000_000), (0, 10_000_000), (0, 0)]


def test_lengths_areas_zooms(spark):
    df = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in SQUARE],), ([{"lon": x, "lat": y} for x, y in SQUARE[::-1]],), ([],), ([{"lon": 1, "lat": 1}],)], "p array<struct<lon:bigint,lat:bigint>>")
    rows = df.select(geo.line_length(F.col("p")).alias("l"), geo.ring_area(F.col("p")).alias("a"), geo.ring_centroid(F.col("p")).alias("c")).collect()
    assert rows[0].l == pytest.approx(445289.2673, abs=1e-3) and rows[0].a == pytest.approx(-12392658216.37, abs=0.1) and rows[1].a == pytest.approx(12392658216.37, abs=0.1)
    assert rows[0].c.lon == 5_000_000 and abs(rows[0].c.lat - 5_000_000) < 1000
    assert (rows[2].l, rows[2].a, rows[3].l, rows[3].a) == (0, 0, 0, 0)
    assert rows[2].c is None and (rows[3].c.lon, rows[3].c.lat) == (1, 1)
    two = spark.createDataFrame([([{"lon": 0, "lat": 0}, {"lon": 10_000_000, "lat": 0}],)], "p array<struct<lon:bigint,lat:bigint>>").select(geo.ring_centroid(F.col("p")).alias("c")).first().c
    assert (two.lon, two.lat) == (5_000_000, 0)
    m = spark.range(1).select(geo.mercator(F.lit(-1396598), F.lit(514858926)).alias("m"), geo.res_zoom(F.lit(1.0)).alias("z"), geo.res_zoom(F.lit(100.0)).alias("y"), geo.area_zoom(F.lit(1e6), 5).alias("a"), geo.res_zoom(F.lit(0.0005)).alias("s")).first()
    assert m.m.x == pytest.approx(-15546.857820, abs=1e-5) and m.m.y == pytest.approx(6707696.756031, abs=1e-4)
    assert m.z == pytest.approx(17.2562, abs=1e-4) and m.y == pytest.approx(10.6123, abs=1e-4) and (m.a, m.s) == (8, 20)


def test_polygons_and_boxes(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)]
    points = [(x, y) for x in range(-1, 12) for y in range(-1, 12)]
    got = spark.createDataFrame(points, "x bigint, y bigint").select("x", "y", geo.in_polygon(F.col("x"), F.col("y"), ring).alias("i")).collect()
    assert {(r.x, r.y): r.i for r in got} == {p: geo.point_in_ring(ring, p) for p in points}
    assert not spark.range(1).select(geo.in_polygon(F.lit(1), F.lit(1), ring[:2]).alias("i")).first().i
    assert [geo.box_in_polygon(ring, b) for b in ((20, 20, 30, 30), (-5, -5, 20, 20), (1, 1, 2, 2), (4, 8, 6, 12), (9, 9, 12, 12))] == [0, 1, 2, 4, 3]
    assert geo.lines_cross([(0, 0), (2, 2)], [(0, 2), (2, 0)]) and not geo.lines_cross([(0, 0), (1, 1)], [(2, 2), (3, 4)]) and geo.lines_cross([(0, 0), (2, 2)], [(1, 1), (5, 0)])


def test_wkb(spark):
    line = [{"lon": 10_000_000, "lat": 20_000_000}, {"lon": 30_000_000, "lat": 40_000_000}]
    df = spark.createDataFrame([("point", line, None), ("line", line, None), ("polygon", line, None), ("multipolygon", None, [[line, line]]), ("multipolygon", None, []), (None, line, None), ("multipolygon", None, [[line, line], [line]])], "k string, p array<struct<lon:bigint,lat:bigint>>, r array<array<array<struct<lon:bigint,lat:bigint>>>>")
    plain = [r.w for r in df.select(geo.wkb(F.col("k"), F.col("p"), F.col("r")).alias("w")).collect()]
    assert bytes(plain[0]) == struct.pack(">BIdd", 0, 1, 1.0, 2.0)
    assert bytes(plain[1]) == struct.pack(">BIIdddd", 0, 2, 2, 1.0, 2.0, 3.0, 4.0)
    assert [struct.unpack(">BI", bytes(w)[:5])[1] for w in plain[2:5]] == [3, 3, 7] and plain[5] is None  # one part is a polygon
    path = struct.pack(">Idddd", 2, 1.0, 2.0, 3.0, 4.0)
    assert bytes(plain[3]) == struct.pack(">BII", 0, 3, 2) + path * 2
    assert bytes(plain[6]) == struct.pack(">BII", 0, 6, 2) + struct.pack(">BII", 0, 3, 2) + path * 2 + struct.pack(">BII", 0, 3, 1) + path
    metres, turned = df.where("k = 'polygon'").select(geo.wkb(F.col("k"), F.col("p"), F.col("r"), 3857, transform=True).alias("w"), geo.wkb(F.col("k"), F.col("p"), F.col("r"), backwards=F.lit(True)).alias("b")).first()
    assert struct.unpack(">BIIII", bytes(metres)[:17]) == (0, 0x20000003, 3857, 1, 2) and struct.unpack(">d", bytes(metres)[17:25])[0] == pytest.approx(111319.4908)
    assert bytes(turned)[13:] == struct.pack(">dddd", 3.0, 4.0, 1.0, 2.0)
    with_srid = df.select(geo.wkb(F.col("k"), F.col("p"), F.col("r"), 4326).alias("w")).first().w
    assert struct.unpack(">BII", bytes(with_srid)[:9]) == (0, 0x20000001, 4326) and math.isclose(struct.unpack(">d", bytes(with_srid)[9:17])[0], 1.0)


def test_style_as_json(tmp_path):
    style = Style(parent_tags=(ParentTag("a", "x", "w", ("p", "q")), ParentTag("a", "y", "w", ("p", "q")), ParentTag("b", "x", "v")), other_keys=("name",), drop_keys=("note",), boundaries=False, all_objects=True)
    assert Style.from_json(json.loads(json.dumps(style.to_json()))) == style
    (tmp_path / "s.json").write_text(json.dumps({"feature_keys": ["shop"], "polygon_tags": {"area": "all", "barrier": {"include": ["wall"]}}}))
    read = read_style(str(tmp_path / "s.json"), min_area=9.0)
    assert (read.feature_keys, read.polygon_tags, read.min_area, read.parent_tags) == (("shop",), {"area": ("all", []), "barrier": ("include", ["wall"])}, 9.0, Style().parent_tags)


def test_members_and_zooms_before_geometry(spark):
    df = spark.createDataFrame([([(1, 5, "ou\x7fter"), (0, 6, None)],), (None,), ([],)], "m array<struct<type:int,ref:bigint,role:string>>")
    rows = df.select(T.fix_members(F.col("m")).alias("f"), T.roles_have_delete_character(F.col("m")).alias("odd")).collect()
    assert [tuple(m) for m in rows[0].f] == [(1, 5, "outer"), (0, 6, None)] and [r.odd for r in rows] == [True, False, False] and rows[1].f is None
    table = ((0, "shop", "*", 17), (0, "shop", "mall", 12))
    assert [of(spark, [("shop", v)], T.shows_by(F.col("tags"), [0], table, 14))[0] for v in ("mall", "x")] == [True, False]
    assert of(spark, None, T.shows_by(F.col("tags"), [0], table, 14)) == (False,)
