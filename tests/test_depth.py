"""Relations nested deeper than any fixed number of rounds, and circles."""

from pyspark.sql import functions as F

from tilewright.functions.quadtree import common_of
from tilewright.operators.extract import area_ids
from tilewright.operators.keys import relation_keys
from tilewright.plans.reach import Links

DEEP = 300
NODES = "id bigint, lon bigint, lat bigint"
RELATIONS = "id bigint, members array<struct<type:int,ref:bigint,role:string>>"


def nested(spark):
    """A chain of relations over node 1, another over node 2 that joins it at the top, a circle over node 3, and one over nothing."""
    chain = [(1000, [(0, 1, "")])] + [(1000 + k, [(2, 999 + k, "")]) for k in range(1, DEEP)]
    top = [(5000, [(2, 999 + DEEP, ""), (0, 2, "")])]
    circle = [(7000, [(2, 7001, ""), (0, 3, "")]), (7001, [(2, 7002, "")]), (7002, [(2, 7000, "")]), (7003, [(2, 7003, "")]), (7004, [(2, 99_999, "")]), (7005, None)]
    return spark.createDataFrame(chain + top + circle, RELATIONS)


def test_keys_of_deep_nesting(spark):
    keys = spark.createDataFrame([(1, 1998382305151811602), (2, 1998375577622413322), (3, 1998382305151811601)], "id bigint, quadtree bigint")
    got = {r.id: r.quadtree for r in relation_keys(nested(spark), keys, keys.limit(0)).collect()}
    both = keys.where("id < 3").agg(common_of("quadtree").alias("q")).first().q
    assert all(got[1000 + k] == 1998382305151811602 for k in range(DEEP)) and got[5000] == both
    assert got[7000] == got[7001] == got[7002] == 1998382305151811601 and got[7003] == got[7004] == got[7005] == 0
    assert len(got) == DEEP + 7


def test_extract_of_deep_nesting(spark):
    nodes = spark.createDataFrame([(1, 5, 5), (2, 500, 500), (3, 900, 900)], NODES)
    ways = spark.createDataFrame([], "id bigint, refs array<bigint>")
    got = {(r.type, r.id) for r in area_ids(nodes, ways, nested(spark), (0, 0, 10, 10)).collect()}
    assert got == {(0, 1)} | {(2, 1000 + k) for k in range(DEEP)} | {(2, 5000)}
    circle = {r.id for r in area_ids(nodes, ways, nested(spark), (890, 890, 910, 910)).where("type = 2").collect()}
    assert circle == {7000, 7001, 7002}


def test_links_stay_when_they_would_grow_too_much(spark):
    links = Links(spark.createDataFrame([(k, k + 1) for k in range(40)], "id bigint, ref bigint"), most=1, free=60)
    sizes = []
    for _ in range(4):
        links.widen()
        sizes.append(links.links.count())
    assert sizes[0] == 79 and sizes[-1] == sizes[0] and not links.growing
    assert links.links.where(F.col("ref") - F.col("id") > 2).count() == 0
