"""Points inside regions, over any number of both.

The leaves are those of ``proximity``: a bounded sample of the points gives a quadtree. A point goes to its own leaf. A region
goes to each leaf that its box touches: whole, or only as a mark where the leaf lies entirely inside it, or not at all where
it lies entirely outside. So each (region, point) comes out once, in the point's leaf. There a packed R-tree over the points gives those in a region's box, and the ring decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.proximity import GRID_BITS, LeafIndex, PackedRTree, sampled_leaves
from tilewright.plans.lineage import cut, task_count

UNIT = 1e7
#: Tasks that the regions that reach into one leaf are divided into, for each this many bytes of them.
RING_BYTES = 64 << 20


def inside_ring(ring: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Even-odd test of points against a ring of corners (n x 2), in the same arithmetic as ``functions.geo.in_polygon``."""
    out = np.zeros(len(lon), bool)
    if len(ring) < 3:
        return out
    a, b = ring, np.roll(ring, 1, axis=0)
    for lo in range(0, len(lon), max(1, 4_000_000 // len(ring))):
        x, y = (v[lo : lo + max(1, 4_000_000 // len(ring)), None] for v in (lon, lat))
        spans = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        out[lo : lo + len(x)] = (spans & (x < at)).sum(axis=1) % 2 == 1
    return out


def _edges_cross(ring: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """For each box (minx, miny, maxx, maxy) whether an edge of the ring may pass through it: the edge meets the box's extents and
    doesn't leave it wholly on one side."""
    a, b = ring, np.roll(ring, 1, axis=0)
    out = np.zeros(len(boxes), bool)
    for k, (x0, y0, x1, y1) in enumerate(boxes):
        near = (np.minimum(a[:, 0], b[:, 0]) <= x1) & (np.maximum(a[:, 0], b[:, 0]) >= x0) & (np.minimum(a[:, 1], b[:, 1]) <= y1) & (np.maximum(a[:, 1], b[:, 1]) >= y0)
        p, q = a[near], b[near]
        side = np.stack([(q[:, 0] - p[:, 0]) * (y - p[:, 1]) - (q[:, 1] - p[:, 1]) * (x - p[:, 0]) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
        out[k] = bool((~((side > 0).all(axis=0) | (side < 0).all(axis=0))).any())
    return out


class Reach:
    """Which leaves a region touches, and how."""

    def __init__(self, leaves: LeafIndex):
        scale = 1 << GRID_BITS
        lon = lambda v: v / scale * 360.0 - 180.0
        lat = lambda v: v / scale * 180.0 - 90.0
        # a little wider than the leaf, so that rounding of cells can't lose a point
        self.boxes = np.stack([lon(leaves.x0 - 1), lat(leaves.y0 - 1), lon(leaves.x1 + 1), lat(leaves.y1 + 1)], axis=1) * UNIT
        self.last_row = np.argsort(self.boxes[:, 1], kind="stable")
        self.low = self.boxes[self.last_row, 1]

    def of(self, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, whole): the leaves that hold points of the ring's area, and whether they lie in it entirely."""
        x0, y0 = ring.min(axis=0)
        x1, y1 = ring.max(axis=0)
        some = self.last_row[: np.searchsorted(self.low, y1, side="right")]
        b = self.boxes[some]
        some = np.sort(some[(b[:, 0] <= x1) & (b[:, 2] >= x0) & (b[:, 3] >= y0)])
        cross = _edges_cross(ring, self.boxes[some])
        clear = np.flatnonzero(~cross)
        middle = (self.boxes[some[clear], :2] + self.boxes[some[clear], 2:]) / 2
        within = inside_ring(ring, middle[:, 0], middle[:, 1])
        keep = cross.copy()
        keep[clear[within]] = True
        return some[keep], ~cross[keep]


def points_in_regions(points: DataFrame, regions: DataFrame, *, sample_size: int = 2_000_000, capacity: int = 16_384) -> DataFrame:
    """(region_id, id) of each point and each region that contains it.

    ``points``: ``id`` bigint, ``lon`` and ``lat`` in degrees x 1e7 (bigint). ``regions``: ``region_id`` bigint, ``ring``
    array<struct<lon, lat: bigint>>, closed or not; the even-odd rule decides, in plain degrees, so a ring doesn't reach across
    the antimeridian. A ring of fewer than three corners holds nothing; corners that are null are left out. Rows with a
    null id or a position that is null or outside the globe are left out; an id with several positions has its
    greatest; copied regions count once. Further columns are ignored; an empty table gives an empty result.

    Leaves are laid out by a sample as in ``proximity.within_distance``. A leaf that stays too full, or that many regions
    reach into, is divided: its points by id into blocks, each a task that gets the leaf's regions, which are sent as whole rings only where
    an edge passes through.
    """
    spark = points.sparkSession
    good = points.select(F.col("id").cast("bigint").alias("id"), F.col("lon").cast("bigint").alias("lon"), F.col("lat").cast("bigint").alias("lat")).where("id is not null and abs(lon) <= 1800000000 and abs(lat) <= 900000000")
    good = cut(good.groupBy("id").agg(F.max(F.struct("lon", "lat")).alias("at")).select("id", "at.lon", "at.lat"), "points")
    total = good.count()
    degrees = good.select("id", (F.col("lon") / UNIT).alias("lon"), (F.col("lat") / UNIT).alias("lat"))
    leaves = sampled_leaves(degrees, total, sample_size, capacity, 1e-6)
    corner = F.transform(F.filter("ring", lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()), lambda p: F.struct(p["lon"].cast("double").alias("x"), p["lat"].cast("double").alias("y")))
    shapes = regions.select(F.col("region_id").cast("bigint").alias("region_id"), corner.alias("ring")).where("region_id is not null and size(ring) >= 3").distinct()

    def rings_of(column: pa.Array) -> list[np.ndarray]:
        flat = column.flatten()
        xy = np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], axis=1)
        sizes = np.diff(column.offsets.to_numpy())
        return np.split(xy, np.cumsum(sizes)[:-1])

    layout = pa.schema([("task", pa.int64()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("ring", pa.binary())])

    def send(task: np.ndarray, id_: np.ndarray, lon: np.ndarray, lat: np.ndarray, rings: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(id_, pa.int64()), pa.array(lon, pa.float64()), pa.array(lat, pa.float64()), pa.array(rings, pa.binary())], schema=layout)

    def place_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lon, lat = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "lon", "lat"))
            own = leaves.leaf_of(lon / UNIT, lat / UNIT)
            k = leaves.blocks[own]
            part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % k
            yield send(leaves.first_task[own] + part, ids, lon.astype(np.float64), lat.astype(np.float64), [None] * len(ids))

    def place_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = Reach(leaves)
        for batch in batches:
            if not batch.num_rows:
                continue
            for region, ring in zip(batch.column("region_id").to_pylist(), rings_of(batch.column("ring"))):
                at, whole = reach.of(ring)
                k = leaves.blocks[at]
                tasks = np.repeat(leaves.first_task[at], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                data, empty = ring.tobytes(), b""
                kinds = [empty if w else data for w in np.repeat(whole, k)]
                step = max(1, RING_BYTES // max(1, len(data)))
                for lo in range(0, len(tasks), step):
                    some = tasks[lo : lo + step]
                    yield send(some, np.full(len(some), region), np.full(len(some), np.nan), np.full(len(some), np.nan), kinds[lo : lo + step])

    def found(region: int, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), region)), pa.array(ids)], names=["region_id", "id"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in each task the points come first, then the regions, which needn't be held
        now, held, tree = None, [], None
        for batch in batches:
            tasks = batch.column("task").to_numpy()
            rings = batch.column("ring")
            is_point = rings.is_null().to_numpy(zero_copy_only=False)
            ids, lon, lat = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "lon", "lat"))
            edges = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(is_point.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(tasks)]):
                if lo == hi:
                    continue
                if tasks[lo] != now:
                    now, held, tree = tasks[lo], [], None
                if is_point[lo]:
                    held.append((ids[lo:hi], lon[lo:hi], lat[lo:hi]))
                    continue
                if not held:
                    continue
                if tree is None:
                    pid, x, y = (np.concatenate(v) for v in zip(*held))
                    order = np.lexsort((x, y))
                    pid, at = pid[order], np.stack([x, y], axis=1)[order]
                    tree = PackedRTree(at)
                for k in range(lo, hi):
                    data = rings[k].as_py()
                    if not data:
                        yield found(ids[k], pid)
                        continue
                    ring = np.frombuffer(data, np.float64).reshape(-1, 2)
                    near = tree.in_box(ring.min(axis=0), ring.max(axis=0))
                    hit = near[inside_ring(ring, at[near, 0], at[near, 1])]
                    if len(hit):
                        yield found(ids[k], pid[hit])

    schema = "task bigint, id bigint, lon double, lat double, ring binary"
    spread = shapes.repartition(max(1, spark.sparkContext.defaultParallelism), "region_id")
    placed = good.mapInArrow(place_points, schema).unionByName(spread.mapInArrow(place_regions, schema))
    grouped = placed.repartition(task_count(spark, total, 150_000), "task").sortWithinPartitions("task", F.col("ring").isNotNull())
    return grouped.mapInArrow(join, "region_id bigint, id bigint")
