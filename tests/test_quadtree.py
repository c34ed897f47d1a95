import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import quadtree as Q

BOXES = [
    ((0, 0, 0, 0), 18, 0.05, 3843071681933344786, "BCCCCCCCCCCCCCCCCC", (131072, 131071, 18)),
    ((0, 0, 0, 0), 17, 0.05, 3843071681664909329, "BCCCCCCCCCCCCCCCC", (65536, 65535, 17)),
    ((-1396598, 514858926, -1396598, 514858926), 18, 0.05, 1998382305151811602, "ADBDBDBDBBDAADDADA", (130970, 87194, 18)),
    ((-1396598, 514858926, -734935, 515353624), 18, 0.05, 1998375577622413322, "ADBDBDBDBB", (511, 340, 10)),
    ((-1000, -1000, 1000, 1000), 18, 0.05, 6917529027641081873, "DAAAAAAAAAAAAAAAA", (65536, 65536, 17)),
    ((23000000, 488000000, 24000000, 489000000), 18, 0.05, 3549012428228395018, "BCACCAABBA", (518, 352, 10)),
    ((1514000000, -338000000, 1514000000, -338000000), 18, 0.05, 7738278315089199122, "DBBCDABDDABCBAABDA", (241318, 157250, 18)),
    ((1, 1, 0, 0), 18, 0.05, -1, "NULL", None),
    ((0, 0, 0, 0), 18, 0.0, 0, "", (0, 0, 0)),
    ((-1000, -1000, 1000, 1000), 18, 0.0, 0, "", (0, 0, 0)),
    ((1750000000, 0, 1950000000, 10), 18, 0.05, 0, "", (0, 0, 0)),
]


@pytest.mark.parametrize("box,depth,buffer,key,letters,xyz", BOXES)
def test_known_boxes(spark, box, depth, buffer, key, letters, xyz):
    df = spark.createDataFrame([box], "a bigint, b bigint, c bigint, d bigint").select(Q.key_of_box("a", "b", "c", "d", buffer, depth).alias("q"))
    at = Q.tile_xyz("q")
    row = df.select("q", Q.as_text("q").alias("t"), Q.from_text(Q.as_text("q")).alias("back"), at.alias("at"), Q.from_xyz(at["x"], at["y"], at["z"]).alias("again")).first()
    assert (row.q, row.t, row.back) == (key, letters, key)
    assert (tuple(row.at) if row.at else None) == xyz
    assert row.again == (key if xyz else None)


def test_null_sides_and_letters(spark):
    df = spark.createDataFrame([(None, 1)], "a bigint, b bigint")
    row = df.select(Q.key_of_box("a", "b", "b", "b").alias("q"), Q.from_text(F.lit("AX")).alias("bad"), Q.common("a", "b").alias("c"), Q.tile_round("a", 3).alias("r"), Q.tile_bbox("a").alias("box")).first()
    assert (row.q, row.bad, row.c, row.r, row.box) == (-1, 0, None, None, None)


def test_round_common_and_box(spark):
    q, p = 1998382305151811602, 1998375577622413322
    df = spark.createDataFrame([(q, p, -1, 0)], "q bigint, p bigint, n bigint, z bigint")
    row = df.select(Q.tile_round("q", 6), Q.tile_round("q", 0), Q.common("q", "p"), Q.common("n", "q"), Q.common("z", "q"), Q.tile_round("p", 12)).first()
    assert tuple(row) == (1997346434738814982, 0, p, q, 0, p)
    boxes = spark.createDataFrame([("",), ("ADB",)], "t string").select(Q.tile_bbox(Q.from_text("t")).alias("b"), Q.tile_bbox(Q.from_text("t"), 0.05).alias("w")).collect()
    assert max(abs(a - b) for a, b in zip(boxes[0].b, (-1800000000, -850511288, 1800000000, 850511288))) <= 1
    assert max(abs(a - b) for a, b in zip(boxes[1].b, (-450000000, 409798981, 0, 665132604))) <= 1
    assert max(abs(a - b) for a, b in zip(boxes[1].w, (-472500000, 397032300, 22500000, 677899286))) <= 1


def _fold(a, b):
    if a < 0 or b < 0:
        return max(a, b)
    n = 0
    while n < min(a & 31, b & 31) and (a >> (61 - 2 * n)) & 3 == (b >> (61 - 2 * n)) & 3:
        n += 1
    return 0 if n == 0 else ((a >> (63 - 2 * n)) << (63 - 2 * n)) + n


def test_common_of_sets_and_ranges(spark):
    rng = random.Random(6)

    def key():
        n = rng.randrange(0, 19)
        path = [rng.choice([0, 0, 1, 3]) for _ in range(n)]
        return sum(v << (61 - 2 * i) for i, v in enumerate(path)) + n

    rows = [(g, rng.choice([-1, None, key(), key(), key()])) for g in range(200) for _ in range(rng.randrange(1, 5))]
    got = {r.g: r.c for r in spark.createDataFrame(rows, "g int, q bigint").groupBy("g").agg(Q.common_of("q").alias("c")).collect()}
    for g in got:
        want = -1
        for h, q in rows:
            if h == g and q is not None:
                want = _fold(want, q)
        assert got[g] == want
    pairs = [(key(), key()) for _ in range(300)] + [(0, key()) for _ in range(5)]
    for r in spark.createDataFrame(pairs, "t bigint, q bigint").select("t", "q", F.col("q").between(F.col("t"), Q.last_below("t")).alias("inside"), F.array_contains(Q.ancestors("q"), F.col("t")).alias("above")).collect():
        assert r.inside == (_fold(r.t, r.q) == r.t) == r.above
