"""Pairs of points within a distance, over any number of points.

A bounded sample of the points gives a quadtree whose leaves hold about equally many points. Every point goes to
its own leaf, and as a replica to the other leaves that its search box touches. Each leaf is one unit of work: its points
are bulk-loaded into a packed R-tree in Z-order, the leaf's own points probe it, the exact distance refines the
hits, and a pair is reported only in the own leaf of its point with the smaller id, so it comes out once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.lineage import cut, task_count

EARTH_RADIUS_M = 6_371_008.8
GRID_BITS = 30
FANOUT = 16
FRONTIER = 131_072
PROBE, BUILD = 1, 2


def _spread(v: np.ndarray) -> np.ndarray:
    """Put a zero bit between the bits of 31-bit numbers."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def _zcode(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (_spread(x) | (_spread(y) << np.uint64(1))).astype(np.int64)


def _cells(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells; longitude wraps around, latitude ends at the poles."""
    top = (1 << GRID_BITS) - 1
    x = np.floor((lon + 180.0) / 360.0 * (1 << GRID_BITS)).astype(np.int64) & top
    y = np.clip(np.floor((lat + 90.0) / 180.0 * (1 << GRID_BITS)).astype(np.int64), 0, top)
    return x, y


class LeafIndex:
    """Leaves of a quadtree over lon/lat, as sorted ranges of Z-order codes.

    A leaf that is expected to hold more than ``capacity`` points but may not be divided further (its side is near
    the search distance) gets ``blocks`` above 1: its points are divided by id, and every pair of blocks is a task
    of its own, so that no task gets an unbounded group.
    """

    def __init__(self, lon: np.ndarray, lat: np.ndarray, total: int, capacity: int, reach_deg: float):
        codes = np.sort(_zcode(*_cells(lon, lat)))
        weight = total / max(1, len(codes))
        deepest = max(0, min(GRID_BITS - 2, int(math.floor(math.log2(180.0 / (4.0 * reach_deg))))))
        starts, depths, counts = [], [], []
        stack = [(0, 0, 0, len(codes))]
        while stack:
            start, depth, lo, hi = stack.pop()
            if (hi - lo) * weight > capacity and depth < deepest and hi - lo > 1:
                step = 1 << (2 * (GRID_BITS - depth - 1))
                edges = [lo, *(lo + np.searchsorted(codes[lo:hi], [start + k * step for k in (1, 2, 3)])), hi]
                stack.extend((start + k * step, depth + 1, edges[k], edges[k + 1]) for k in (3, 2, 1, 0))
            else:
                starts.append(start)
                depths.append(depth)
                counts.append((hi - lo) * weight)
        self.starts = np.array(starts, np.int64)
        self.depths = np.array(depths, np.int64)
        self.blocks = np.maximum(1, np.ceil(np.array(counts) / (2 * capacity))).astype(np.int64)
        self.first_task = np.concatenate([[0], np.cumsum(self.blocks**2)]).astype(np.int64)
        self.least_side = 1 << (GRID_BITS - int(self.depths.max()))
        side = np.left_shift(1, GRID_BITS - self.depths)
        self.x0, self.y0 = self._corner(self.starts)
        self.x1, self.y1 = self.x0 + side, self.y0 + side

    @staticmethod
    def _corner(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros_like(codes), np.zeros_like(codes)
        for b in range(GRID_BITS):
            x |= ((codes >> (2 * b)) & 1) << b
            y |= ((codes >> (2 * b + 1)) & 1) << b
        return x, y

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, _zcode(x, y), side="right") - 1

    def leaf_of(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        return self.leaf(*_cells(lon, lat))

    def touched(self, lon: np.ndarray, lat: np.ndarray, reach_rad: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own leaf of each point; then (row, leaf) of every further leaf that the box around a point touches."""
        x, y = _cells(lon, lat)
        own = self.leaf(x, y)
        scale = 1 << GRID_BITS
        phi = np.radians(np.abs(lat))
        polar = phi + reach_rad >= math.pi / 2 * (1 - 1e-12)
        ratio = np.where(polar, 1.0, math.sin(reach_rad) / np.maximum(np.cos(phi), 1e-300))
        dx = np.where(polar, scale, np.ceil(np.degrees(np.arcsin(np.minimum(1.0, ratio))) / 360.0 * scale * (1 + 1e-9)) + 1).astype(np.int64)
        dy = int(math.ceil(math.degrees(reach_rad) / 180.0 * scale * (1 + 1e-9))) + 1
        y0, y1 = np.clip(y - dy, 0, scale - 1), np.clip(y + dy, 0, scale - 1)
        wide = 2 * dx + 1 >= self.least_side
        rows, leaves = [], []
        near = np.flatnonzero(~wide)
        if len(near):
            xs = [(x[near] + s * dx[near]) & (scale - 1) for s in (-1, 1)]
            four = np.stack([self.leaf(a, b[near]) for a in xs for b in (y0, y1)])
            four.sort(axis=0)
            fresh = four != own[near]
            fresh[1:] &= four[1:] != four[:-1]
            k, r = np.nonzero(fresh)
            rows.append(near[r])
            leaves.append(four[k, r])
        for r in np.flatnonzero(wide):
            tall = (self.y0 <= y1[r]) & (self.y1 > y0[r])
            if 2 * dx[r] + 1 < scale:
                a, b = x[r] - dx[r], x[r] + dx[r]
                tall &= np.logical_or.reduce([(self.x0 <= b + s) & (self.x1 > a + s) for s in (-scale, 0, scale)])
            hit = np.flatnonzero(tall)
            hit = hit[hit != own[r]]
            rows.append(np.full(len(hit), r))
            leaves.append(hit)
        none = np.empty(0, np.int64)
        return own, np.concatenate(rows or [none]), np.concatenate(leaves or [none])


class PackedRTree:
    """R-tree over points, packed in the given order with FANOUT entries a node."""

    def __init__(self, points: np.ndarray):
        self.points = points
        low = high = points
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while len(low) > 1 or not self.levels:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((low, high))

    def hits(self, queries: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) index pairs with a distance of at most ``reach``, in parts.

        All queries go down the tree together, depth first in parts of FRONTIER nodes, so memory stays bounded
        however many points a query hits.
        """
        top = len(self.levels) - 1
        width = len(self.levels[top][0])
        stack = [(top, np.repeat(np.arange(len(queries)), width), np.tile(np.arange(width), len(queries)))]
        while stack:
            level, q, n = stack.pop()
            if len(q) > FRONTIER:
                stack.append((level, q[FRONTIER:], n[FRONTIER:]))
                q, n = q[:FRONTIER], n[:FRONTIER]
            low, high = self.levels[level]
            keep = np.ones(len(q), bool)
            for axis in range(queries.shape[1]):
                at = queries[q, axis]
                keep &= (low[n, axis] <= at + reach) & (high[n, axis] >= at - reach)
            q, n = q[keep], n[keep]
            below = len(self.points) if level == 0 else len(self.levels[level - 1][0])
            n = (n[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            q = np.repeat(q, FANOUT)
            keep = n < below
            q, n = q[keep], n[keep]
            if not len(q):
                continue
            if level:
                stack.append((level - 1, q, n))
                continue
            gap = queries[q] - self.points[n]
            keep = np.einsum("ij,ij->i", gap, gap) <= reach * reach
            yield q[keep], n[keep]


    def in_box(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Indexes of the points in a closed box."""
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[level]
            nodes = nodes[((low[nodes] <= most) & (high[nodes] >= least)).all(axis=1)]
            below = len(self.points) if level == 0 else len(self.levels[level - 1][0])
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < below]
        return nodes[((self.points[nodes] >= least) & (self.points[nodes] <= most)).all(axis=1)]


def sampled_leaves(good: DataFrame, total: int, sample_size: int, capacity: int, reach_deg: float) -> LeafIndex:
    """Leaves laid out by a sample of distinct points (id, lon, lat in degrees): about 8 points for ``capacity`` points, 65 536 at
    least and ``sample_size`` at most. Rows whose hash lies below a threshold are a uniform sample of the expected size."""
    wanted = min(sample_size, max(65_536, 8 * total // capacity))
    sample = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(min(1.0, wanted / max(1, total)) * (1 << 40))).select("lon", "lat").toArrow()
    return LeafIndex(sample["lon"].to_numpy(), sample["lat"].to_numpy(), total, capacity, reach_deg)


def _unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=1)


def within_distance(
    points: DataFrame,
    distance_m: float,
    *,
    radius_m: float = EARTH_RADIUS_M,
    sample_size: int = 2_000_000,
    capacity: int = 16_384,
) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all pairs of points at most ``distance_m`` apart on the sphere.

    ``points``: ``id`` bigint, ``lon`` and ``lat`` in degrees (double). Points at one spot count, also across the
    antimeridian and the poles. Rows with a null or non-finite id, lon or lat, or a position outside the globe, are
    left out. An id must have one position; if it has several, the greatest (lon, lat) counts. Further columns are
    ignored; an empty table gives an empty result.

    The driver lays out the leaves by a sample of about 8 points for ``capacity`` points, 65 536 at least and ``sample_size``
    at most (expected numbers); the layout only decides where
    work is done. Leaves that stay too full are divided by id into blocks, each pair of blocks being one task.
    """
    spark = points.sparkSession
    reach_rad = distance_m / radius_m
    good = points.select(F.col("id").cast("bigint").alias("id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).where("id is not null and lon between -180 and 180 and lat between -90 and 90")
    good = good.groupBy("id").agg(F.max(F.struct("lon", "lat")).alias("at")).select("id", "at.lon", "at.lat")
    good = cut(good, "points")
    total = good.count()
    index = sampled_leaves(good, total, sample_size, capacity, math.degrees(reach_rad))
    chord = 2.0 * math.sin(min(reach_rad, math.pi) / 2.0)
    layout = pa.schema([("task", pa.int64()), ("role", pa.int8()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = index  # at most about 4 leaves for each sampled point
        for batch in batches:
            ids, lon, lat = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "lon", "lat"))
            own, row, leaf = leaves.touched(lon, lat, reach_rad)
            rows = np.concatenate([np.arange(len(ids)), row])
            cells = np.concatenate([own, leaf])
            home = np.arange(len(rows)) < len(ids)
            k = leaves.blocks[cells]
            part = (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % k
            # block b of k: builds for tasks (i, b), and, in the own leaf, probes in tasks (b, j)
            at = np.repeat(np.arange(len(rows)), k)
            i = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
            parts = [(at, i, part[at], np.where((i == part[at]) & home[at], PROBE | BUILD, BUILD))]
            if (k > 1).any():
                more = home[at] & (i != part[at])
                parts.append((at[more], part[at[more]], i[more], np.full(more.sum(), PROBE)))
            at, i, j, role = (np.concatenate(x) for x in zip(*parts))
            task = leaves.first_task[cells[at]] + i * k[at] + j
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(role.astype(np.int8)), pa.array(ids[rows[at]]), pa.array(lon[rows[at]]), pa.array(lat[rows[at]])], schema=layout)

    def pairs_of(role: np.ndarray, ids: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(_zcode(*_cells(lon, lat)), kind="stable")
        role, ids, at = role[order], ids[order], _unit_vectors(lon[order], lat[order])
        build, probe = np.flatnonzero(role & BUILD), np.flatnonzero(role & PROBE)
        if not len(build) or not len(probe):
            return
        tree = PackedRTree(at[build])
        for lo in range(0, len(probe), 4096):
            some = probe[lo : lo + 4096]
            for q, n in tree.hits(at[some], chord):
                a, b = ids[some[q]], ids[build[n]]
                first = a < b
                if first.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], names=["id_a", "id_b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = None
        for batch in batches:
            task, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "role", "id", "lon", "lat"))
            if not len(task):
                continue
            edges = np.flatnonzero(np.diff(task)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(task)]):
                if task[lo] != now and held:
                    yield from pairs_of(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                now = task[lo]
                held.append([x[lo:hi] for x in rest])
        if held:
            yield from pairs_of(*(np.concatenate(x) for x in zip(*held)))

    # a table of few files is spread over the cores; a large one has splits enough
    spread = 100_000 < total < 5_000_000 * spark.sparkContext.defaultParallelism
    placed = good.repartition(task_count(spark, total, 250_000), "id") if spread else good
    placed = placed.mapInArrow(place, "task bigint, role tinyint, id bigint, lon double, lat double")
    grouped = placed.repartition(task_count(spark, total, 150_000), "task").sortWithinPartitions("task")
    return grouped.mapInArrow(join, "id_a bigint, id_b bigint")
