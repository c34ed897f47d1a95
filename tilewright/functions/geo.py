"""Functions of coordinates (degrees x 1e7), boxes, lines and rings."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: half the width of the web-mercator square in metres.
EARTH_WIDTH = 20037508.342789244


def from_degrees(v: Column) -> Column:
    """Degrees as whole degrees x 1e7, halves away from zero."""
    return (v * 1e7 + F.signum(v) * 0.5).cast("bigint")


def mercator(lon: Column, lat: Column) -> Column:
    """struct x, y: web-mercator metres of a position in degrees x 1e7; y is null at the south pole."""
    y = F.log(F.tan((lat * 1e-7 / 90.0 + 1.0) * F.lit(math.pi / 4))) / F.lit(math.pi)
    return F.struct((lon * 1e-7 / 180.0 * EARTH_WIDTH).alias("x"), (y * EARTH_WIDTH).alias("y"))


def inverse_mercator(x: Column, y: Column) -> Column:
    """struct lon, lat (degrees x 1e7) of web-mercator metres."""
    lat = (F.atan(F.exp(y / EARTH_WIDTH * F.lit(math.pi))) * F.lit(4 / math.pi) - 1.0) * 90.0
    return F.struct(from_degrees(x / EARTH_WIDTH * 180.0).alias("lon"), from_degrees(lat).alias("lat"))


def mercator_box(b: Column) -> Column:
    """struct minx, miny, maxx, maxy in metres of a box (struct of the same names, degrees x 1e7)."""
    low, high = mercator(b["minx"], b["miny"]), mercator(b["maxx"], b["maxy"])
    return F.struct(low["x"].alias("minx"), low["y"].alias("miny"), high["x"].alias("maxx"), high["y"].alias("maxy"))


def epsg_code(transform: bool) -> int:
    """Number of the reference system: web mercator, or degrees."""
    return 3857 if transform else 4326


def in_box(lon: Column, lat: Column, box: tuple[int, int, int, int]) -> Column:
    """Closed on all sides."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def boxes_touch(b: Column, box: tuple[int, int, int, int]) -> Column:
    return (b["minx"] <= box[2]) & (b["maxx"] >= box[0]) & (b["miny"] <= box[3]) & (b["maxy"] >= box[1])


def box_contains(box: tuple[int, int, int, int], b: Column) -> Column:
    return (b["minx"] >= box[0]) & (b["maxx"] <= box[2]) & (b["miny"] >= box[1]) & (b["maxy"] <= box[3])


def in_polygon(lon: Column, lat: Column, ring: list[tuple[int, int]]) -> Column:
    """Even-odd test; false for fewer than three corners."""
    if len(ring) < 3:
        return F.lit(False)
    edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*ring[i], *ring[i - 1]))]) for i in range(len(ring))])
    x, y = lon.cast("double"), lat.cast("double")

    def crossed(inside: Column, e: Column) -> Column:
        return inside != (((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.when(e["by"] == e["ay"], None).otherwise(e["by"] - e["ay"]) + e["ax"]))

    return F.coalesce(F.aggregate(edges, F.lit(False), lambda inside, e: F.coalesce(crossed(inside, e), inside)), F.lit(False))


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    """Whether the closed segments ab and cd have a point in common."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    within = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    s = [side(c, d, a), side(c, d, b), side(a, b, c), side(a, b, d)]
    if (s[0] > 0) != (s[1] > 0) and (s[2] > 0) != (s[3] > 0) and all(s):
        return True
    return any(v == 0 and within(p, q, r) for v, p, q, r in zip(s, (c, c, a, a), (d, d, b, b), (a, b, c, d)))


def lines_cross(one: list[tuple], two: list[tuple]) -> bool:
    return any(segments_cross(a, b, c, d) for a, b in zip(one, one[1:]) for c, d in zip(two, two[1:]))


def point_in_ring(ring: list[tuple], at: tuple) -> bool:
    inside = False
    for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]] if ring else []):
        if (ay > at[1]) != (by > at[1]) and at[0] < (bx - ax) * (at[1] - ay) / (by - ay) + ax:
            inside = not inside
    return inside and len(ring) > 2


def box_in_polygon(ring: list[tuple], box: tuple[int, int, int, int]) -> int:
    """How a box and a polygon meet: 0 not by their extents, 1 box around polygon, 2 the box's centre inside, 3 edges cross, 4 not at all."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    if not ring or min(xs) > box[2] or max(xs) < box[0] or min(ys) > box[3] or max(ys) < box[1]:
        return 0
    if box[0] <= min(xs) and box[2] >= max(xs) and box[1] <= min(ys) and box[3] >= max(ys):
        return 1
    if point_in_ring(ring, ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)):
        return 2
    corners = [(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3]), (box[0], box[1])]
    return 3 if lines_cross(corners, [*ring, ring[0]]) else 4


def meets_ring(box: Column, ring: list[tuple[int, int]]) -> Column:
    """``box_in_polygon`` of boxes (struct minx, miny, maxx, maxy) and one ring, as a column; null for a null box."""

    @F.arrow_udf("int")
    def codes(boxes: pa.Array) -> pa.Array:
        sides = (boxes.field(n).to_pylist() for n in ("minx", "miny", "maxx", "maxy"))
        return pa.array([None if b[0] is None else box_in_polygon(ring, b) for b in zip(*sides)], pa.int32())

    return codes(F.struct(*[box[n].alias(n) for n in ("minx", "miny", "maxx", "maxy")]))


def tile_meets_ring(qt: str, ring: list[tuple[int, int]]) -> Column:
    """Whether a tile, widened by 5 %, and the area of a ring have a point in common."""
    from tilewright.functions.quadtree import tile_bbox

    return F.coalesce(meets_ring(tile_bbox(qt, 0.05), ring).isin(1, 2, 3), F.lit(False))


def _metres(lonlats: Column) -> Column:
    return F.transform(lonlats, lambda p: mercator(p["lon"], p["lat"]))


def _pairs(points: Column) -> Column:
    """Consecutive points as structs a, b."""
    return F.when(F.size(points) < 2, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def line_length(lonlats: Column) -> Column:
    """Length in mercator metres; 0 for fewer than two points."""
    return F.aggregate(_pairs(_metres(lonlats)), F.lit(0.0), lambda n, p: n + F.sqrt(F.pow(p["a"]["x"] - p["b"]["x"], 2) + F.pow(p["a"]["y"] - p["b"]["y"], 2)))


def ring_area(lonlats: Column) -> Column:
    """Signed area in mercator square metres, positive for clockwise rings; 0 for fewer than three points."""
    total = F.aggregate(_pairs(_metres(lonlats)), F.lit(0.0), lambda n, p: n + p["a"]["x"] * p["b"]["y"] - p["a"]["y"] * p["b"]["x"])
    return F.when(F.size(lonlats) < 3, F.lit(0.0)).otherwise(total * -0.5)


def ring_centroid(lonlats: Column) -> Column:
    """struct lon, lat of the area's centroid, in mercator metres and back; the middle of two points, the first of a ring without
    area; null without points."""
    points = _metres(lonlats)
    cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["a"]["y"] * p["b"]["x"]
    sums = F.aggregate(
        _pairs(points),
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, p: F.struct((s["w"] + cross(p)).alias("w"), (s["x"] + (p["a"]["x"] + p["b"]["x"]) * cross(p)).alias("x"), (s["y"] + (p["a"]["y"] + p["b"]["y"]) * cross(p)).alias("y")),
    )
    at = lambda k: F.get(points, F.lit(k))
    first = F.struct(F.get(lonlats, F.lit(0))["lon"].alias("lon"), F.get(lonlats, F.lit(0))["lat"].alias("lat"))
    middle = inverse_mercator((at(0)["x"] + at(1)["x"]) / 2, (at(0)["y"] + at(1)["y"]) / 2)
    whole = inverse_mercator(sums["x"] / (sums["w"] * 3), sums["y"] / (sums["w"] * 3))
    return F.when(F.size(lonlats) == 2, middle).when((F.size(lonlats) > 2) & (sums["w"] != 0), whole).when(F.size(lonlats) > 0, first)


def res_zoom(res: Column) -> Column:
    """Zoom level at which a tile's pixel is ``res`` metres wide; 20 below a millimetre."""
    return F.when(F.abs(res) < 0.001, F.lit(20.0)).otherwise(F.log2(F.lit(EARTH_WIDTH * 2 / 256) / res))


def length_zoom(length: Column, least: float) -> Column:
    return res_zoom(length / least).cast("bigint") if least > 0 else F.lit(0).cast("bigint")


def area_zoom(area: Column, least: float) -> Column:
    return res_zoom(F.sqrt(F.abs(area) / least)).cast("bigint") if least > 0 else F.lit(0).cast("bigint")


def _head(kind: int, srid: int | None) -> bytes:
    return struct.pack(">BI", 0, kind) if srid is None else struct.pack(">BII", 0, kind | 0x20000000, srid)


def _corners(points: pa.StructArray, transform: bool) -> bytes:
    """Big-endian x, y of all points, 16 bytes each."""
    lon, lat = (points.field(c).to_numpy(zero_copy_only=False).astype(np.float64) * 1e-7 for c in ("lon", "lat"))
    if transform:
        with np.errstate(divide="ignore"):
            lon, lat = lon / 180.0 * EARTH_WIDTH, np.log(np.tan((lat / 90.0 + 1.0) * (math.pi / 4))) / math.pi * EARTH_WIDTH
    return np.stack([lon, lat], axis=1).astype(">f8").tobytes()


def wkb(kind: Column, lonlats: Column, rings: Column, srid: int | None = None, *, transform: bool = False, backwards: Column | None = None) -> Column:
    """Big-endian WKB (EWKB with ``srid``) in degrees, or in mercator metres with ``transform``: ``point``, ``line``, ``polygon`` of
    lonlats (in reverse where ``backwards``), or ``multipolygon`` of ``rings`` (array of polygons, each an array of rings); null for
    other kinds. A multipolygon of one part is a polygon, one of none an empty collection."""

    @F.arrow_udf("binary")
    def pack(kinds: pa.Array, lines: pa.Array, areas: pa.Array, turned: pa.Array) -> pa.Array:
        sizes = lambda lists: lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat, ends = _corners(lines.flatten(), transform), np.concatenate([[0], np.cumsum(sizes(lines))])
        polygons = areas.flatten()
        ring_lists = polygons.flatten()
        inner, inner_ends = _corners(ring_lists.flatten(), transform), np.concatenate([[0], np.cumsum(sizes(ring_lists))])
        part_sizes, ring_counts = sizes(areas), sizes(polygons)
        part, ring, out = 0, 0, []

        def path(k: int) -> bytes:
            a, b = int(inner_ends[k]), int(inner_ends[k + 1])
            return struct.pack(">I", b - a) + inner[16 * a : 16 * b]

        for k, name in enumerate(kinds.to_pylist()):
            n, body = int(ends[k + 1] - ends[k]), flat[16 * int(ends[k]) : 16 * int(ends[k + 1])]
            parts = []
            for size in ring_counts[part : part + int(part_sizes[k])]:
                parts.append(struct.pack(">I", int(size)) + b"".join(path(r) for r in range(ring, ring + int(size))))
                ring += int(size)
            part += int(part_sizes[k])
            if name == "point":
                out.append(_head(1, srid) + body[:16] if n else None)
            elif name == "line":
                out.append(_head(2, srid) + struct.pack(">I", n) + body)
            elif name == "polygon":
                if turned[k].as_py():
                    body = np.frombuffer(body, ">f8").reshape(-1, 2)[::-1].tobytes()
                out.append(_head(3, srid) + struct.pack(">II", 1, n) + body)
            elif name == "multipolygon":
                if len(parts) == 1:
                    out.append(_head(3, srid) + parts[0])
                else:
                    out.append(_head(6 if parts else 7, srid) + struct.pack(">I", len(parts)) + b"".join(_head(3, None) + p for p in parts))
            else:
                out.append(None)
        return pa.array(out, pa.binary())

    return pack(kind, lonlats, rings, F.lit(False) if backwards is None else F.coalesce(backwards, F.lit(False)))
