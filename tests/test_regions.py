import math
import random

from pyspark.sql import functions as F

from tilewright.functions.geo import in_polygon
from tilewright.operators.regions import points_in_regions

POINTS = "id bigint, lon bigint, lat bigint, ring string, task int"
REGIONS = "region_id bigint, ring array<struct<lon:bigint,lat:bigint>>, id int"


def data(spark, n=3000):
    rng = random.Random(5)
    points = [(k, rng.choice([rng.randrange(-10**6, 10**6), rng.randrange(-18 * 10**8, 18 * 10**8)]), rng.randrange(-10**6, 10**6), "x", 1) for k in range(n)]
    points += [(n, None, 5, "x", 1), (None, 1, 1, "x", 1), (n + 1, 2 * 10**9, 1, "x", 1), (0, -(10**9), 0, "x", 1)]

    def star(x, y, size, corners):
        return [(int(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / corners)), int(y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / corners))) for k in range(corners)]

    rings = [star(rng.randrange(-10**6, 10**6), rng.randrange(-10**6, 10**6), rng.choice([10**4, 10**5, 10**6]), rng.choice([3, 5, 40])) for _ in range(40)]
    rings += [[(-18 * 10**8, -9 * 10**8), (18 * 10**8, -9 * 10**8), (18 * 10**8, 9 * 10**8), (-18 * 10**8, 9 * 10**8)], [(0, 0), (5, 5)], [], [(0, 0), (10**6, 0), (0, 10**6), (10**6, 10**6), (0, 0)]]
    regions = [(k, r, 0) for k, r in enumerate(rings)] + [(3, rings[3], 0), (None, rings[1], 0), (99, None, 0)]
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(regions, REGIONS), rings


def test_equals_every_ring_by_itself(spark):
    points, regions, rings = data(spark)
    one = points.where("id is not null and abs(lon) <= 1800000000 and lat is not null").groupBy("id").agg(F.max(F.struct("lon", "lat")).alias("p")).select("id", "p.*").cache()
    tests = one.select("id", *[in_polygon(F.col("lon"), F.col("lat"), r).alias(f"r{k}") for k, r in enumerate(rings)]).collect()
    want = {(k, r.id) for r in tests for k in range(len(rings)) if r[f"r{k}"]}
    for capacity in (16_384, 50):
        got = [tuple(r) for r in points_in_regions(points, regions, capacity=capacity).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len({k for k, _ in want}) > 20


def test_many_points_at_one_spot_and_empty_tables(spark):
    spot = spark.range(400).select("id", F.lit(7).cast("bigint").alias("lon"), F.lit(7).cast("bigint").alias("lat"))
    square = spark.createDataFrame([(1, [(0, 0), (10, 0), (10, 10), (0, 10)], 0), (2, [(8, 8), (10, 8), (10, 10)], 0)], REGIONS)
    assert points_in_regions(spot, square, capacity=20).groupBy("region_id").count().collect() == [(1, 400)]
    assert points_in_regions(spot.limit(0), square).collect() == [] == points_in_regions(spot, square.limit(0)).collect()
