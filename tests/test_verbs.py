import json

import pytest
from pyspark.sql import functions as F

from tilewright.__main__ import main
from tilewright.functions.text import change_file_path, date_text, file_name, long_key, number_text, packed_hstore, packed_tags, read_date, read_state, short_key, unpacked_tags
from tilewright.plans.geometry_tables import feature_collections, feature_differences, read_geometries
from tilewright.schema import ELEMENT
from tilewright.sources.geometry_blocks import read_geometry_blocks
from tilewright.sources.pbf import read_pbf, write_pbf
from tilewright.sources.snapshot import file_list, new_changes, read_snapshot


def test_dates_names_and_states(spark):
    assert [read_date(t) for t in ("20191114", "2019-11-14", "2019-11-14T00:00:01Z", "2019-11-14 00:00:01", "2019-11-14T00-00-01", "2019-13-14", "x", "", None)] == [1573689600, 1573689600, 1573689601, 1573689601, 1573689601, 0, 0, 0, 0]
    assert file_name("a-", 1573689600) == "a-20191114.pbfc" and file_name("", 1573689601, "") == "2019-11-14T00-00-01"
    assert read_state("#x\nsequenceNumber=2619\ntimestamp=2019-11-14T00\\:00\\:00Z\n") == {"sequence": 2619, "timestamp": 1573689600}
    assert change_file_path(2619) == "000/002/619.osc.gz" and number_text(1234567) == " 1 234 567"
    assert spark.range(1).select(date_text(F.lit(1573689601))).first()[0] == "2019-11-14T00:00:01"


def test_packed_forms(spark):
    keys = spark.createDataFrame([(1998382305151811602,), (0,), (-1,), (6917529027641081873,)], "q bigint")
    assert all(r.q == r.b for r in keys.select("q", long_key(short_key(F.col("q"))).alias("b")).collect())
    row = spark.createDataFrame([([("a", "ü"), ("b", None)],)], "t array<struct<key:string,val:string>>").select(packed_tags(F.col("t")).alias("p"), packed_hstore(F.col("t")).alias("h")).first()
    assert bytes(row.p) == b"\0\1a\0\2\xc3\xbc\0\1b\0\0"
    back = spark.createDataFrame([(bytes(row.p),), (None,), (b"",)], "p binary").select(unpacked_tags(F.col("p")).alias("t")).collect()
    assert [r.t and [tuple(t) for t in r.t] for r in back] == [[("a", "ü"), ("b", "")], None, []]
    with pytest.raises(Exception, match="end inside"):
        spark.createDataFrame([(b"\0\5a",)], "p binary").select(unpacked_tags(F.col("p"))).collect()
    assert bytes(row.h) == b"\0\0\0\2\0\0\0\1a\0\0\0\2\xc3\xbc\0\0\0\1b\xff\xff\xff\xff"


@pytest.fixture(scope="module")
def planet(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("planet")
    info = (1, 5, 1, 1, "u", True)
    rows = [(0, k, 0, -1, info, [("shop", "x")] if k == 1 else [], 10_000_000 + k * 1000, 20_000_000 + (k % 3) * 1000, None, None) for k in range(1, 9)]
    rows += [(1, 1, 0, -1, info, [("building", "yes")], None, None, [1, 2, 3, 1], None), (1, 2, 0, -1, info, [("highway", "path")], None, None, [4, 5], None), (2, 1, 0, -1, info, [], None, None, None, [(1, 1, "")])]
    return write_pbf(spark.createDataFrame(rows, ELEMENT).coalesce(1), str(folder))[0], folder


def test_verbs_from_file_to_geometry(spark, planet, capsys):
    path, folder = planet
    at = lambda n: str(folder / n)
    assert main([]) == 1
    assert main(["count", path]) == main(["readfile", path]) == 0
    assert main(["calcqts", path, at("qts")]) == 0 and spark.read.parquet(at("qts")).where("quadtree > 0").count() == 11
    assert main(["sortblocks", path, at("qts"), at("sorted"), "target=4", "min=1"]) == 0
    assert spark.read.parquet(at("sorted")).count() == 11
    assert main(["initial", at("sorted"), at("root"), "20240101"]) == 0
    (folder / "c.osc").write_text('<osmChange><delete><node id="8" version="2"/></delete><modify><node id="7" version="2" lat="2" lon="1"/></modify></osmChange>')
    assert main(["update", at("root"), "20240102", at("c.osc")]) == 0
    assert main(["mergechanges", at("root"), at("merged"), "filter=0,0,90000000,90000000"]) == 0
    assert spark.read.parquet(at("merged")).count() == 10
    assert main(["applychange", path, at("c.osc"), at("applied")]) == 0 and spark.read.parquet(at("applied")).count() == 10
    assert main(["geometry", at("merged"), at("shapes")]) == 0
    shapes = read_geometries(spark, at("shapes"))
    assert {(r.type, r.id) for r in shapes.collect()} == {(3, 1), (5, 1), (4, 2)}
    assert read_geometries(spark, at("shapes"), box=(0, 0, 1, 1)).count() == 0 and read_geometries(spark, at("shapes"), max_zoom=17).count() == 3
    features = [f for r in feature_collections(shapes).collect() for f in json.loads(r.collection)["features"]]
    assert {f["geometry"]["type"] for f in features} == {"Point", "Polygon", "LineString"}
    layers = {(r.layer, r.part): json.loads(r.collection) for r in feature_collections(shapes, 0, features=1).collect()}
    assert {k for k, _ in layers} == {"point", "line", "polygon"} and all(v["table"] == k and len(v["bbox"]) == 4 for (k, _), v in layers.items())
    polygon = next(f for f in features if f["geometry"]["type"] == "Polygon")
    assert polygon["way_area"] > 0 and polygon["bbox"][0] == 1.0001 and len(polygon["quadtree"]) == 3 and "way_length" not in polygon
    assert feature_differences(shapes, shapes).count() == 0 and feature_differences(shapes, shapes.where("type = 3")).count() == 2
    assert main(["geometry", at("merged"), at("shapes.pbf"), "lastdate=20300101"]) == 0
    blocks = read_geometry_blocks(spark, [str(p) for p in sorted((folder / "shapes.pbf").glob("*.pbf"))])
    assert {(r.type, r.id) for r in blocks.collect()} == {(3, 1), (5, 1), (4, 2)}
    assert main(["droplast", at("root")]) == 0


def test_downloaded_change_files(spark, planet, tmp_path):
    path, folder = planet
    at = lambda n: str(tmp_path / n)
    assert main(["calcqts", path, at("qts")]) == 0 and main(["sortblocks", path, at("qts"), at("sorted.pbf"), "target=4", "min=1", "rollup=1", f"groups={at('groups')}", "timestamp=20240101", "fixstrs=1"]) == 0
    made = [str(p) for p in sorted((tmp_path / "sorted.pbf").glob("*.pbf"))]
    assert main(["count", made[0], "filter=0,0,90000000,90000000"]) == 0
    read_pbf(spark, made).write.parquet(at("sorted"))
    assert main(["initial", at("sorted"), at("root"), "20240101"]) == 0
    (tmp_path / "diffs").mkdir()
    for n, id_ in ((1, 8), (2, 7), (3, 6)):
        (tmp_path / f"diffs/{n}.osc").write_text(f'<osmChange><delete><node id="{id_}" version="2"/></delete></osmChange>')
        (tmp_path / f"diffs/{n}.state.txt").write_text(f"sequenceNumber={n}\ntimestamp=2024-01-0{n + 1}T00\\:00\\:00Z\n")
    assert [len(g) for g in new_changes(at("root"), at("diffs"), merge=True, most_bytes=150)] == [2, 1]
    assert main(["update_downloaded", at("root"), at("diffs"), "merge=1"]) == 0
    assert [(f["State"], f["EndDate"]) for f in file_list(at("root"))][1:] == [(3, read_date("20240104"))]
    assert new_changes(at("root"), at("diffs")) == []
    assert {r.id for r in read_snapshot(spark, at("root")).where("type = 0").collect()} == {1, 2, 3, 4, 5}
