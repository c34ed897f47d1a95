"""Geometries in block files, and the packed forms of boxes, rings and polygon parts.

In a group, geometries are fields 20 (point), 21 (line), 22 (polygon) and 23 (multipolygon). Beside the fields of every
element they have: 8 and 9 latitude and longitude of a point (else 8 node ids), 12 drawing order, 13 and 14 longitudes and
latitudes, 15 length, 16 area (both in hundredths), 22 zoom, 23 whether the ring runs backwards, 24 layer, 25 polygon parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilewright.schema import TAGS
from tilewright.sources import files
from tilewright.sources.pbf import Names, block_frames, block_parts, common_fields, pack_about, pack_common, read_frame, write_blocks
from tilewright.sources.wire import deltas, field, fields, packed_deltas, unzigzag, zigzag

POINT, LINE, POLYGON, MULTIPOLYGON = 3, 4, 5, 6
#: Field number of a geometry, less its type.
ABOVE = 17
POINTS = "array<struct<lon:bigint,lat:bigint>>"
GEOMETRY = f"type int, id bigint, quadtree bigint, tags {TAGS}, layer bigint, zorder bigint, minzoom bigint, lonlats {POINTS}, rings array<array<{POINTS}>>, length double, area double, reversed boolean, tile_qt bigint"
_POINT = pa.struct([("lon", pa.int64()), ("lat", pa.int64())])
_SCHEMA = pa.schema(
    [("type", pa.int32()), ("id", pa.int64()), ("quadtree", pa.int64()), ("tags", pa.list_(pa.struct([("key", pa.string()), ("val", pa.string())]))), ("layer", pa.int64()), ("zorder", pa.int64()), ("minzoom", pa.int64()), ("lonlats", pa.list_(_POINT))]
    + [("rings", pa.list_(pa.list_(pa.list_(_POINT)))), ("length", pa.float64()), ("area", pa.float64()), ("reversed", pa.bool_()), ("tile_qt", pa.int64())]
)

Ring = list[dict]


def _hundredths(v: float | None) -> int:
    v = (v or 0.0) * 100
    return int(v - 0.5) if v < 0 else int(v + 0.5)


def _lonlats(lons: bytes, lats: bytes) -> Ring:
    x, y = packed_deltas(lons).tolist(), packed_deltas(lats).tolist()
    if len(x) != len(y):
        raise ValueError("numbers of longitudes and latitudes differ")
    return [{"lon": a, "lat": b} for a, b in zip(x, y)]


def pack_bounds(box: tuple[int, int, int, int]) -> bytes:
    """Box minx, miny, maxx, maxy: its corner, width and height."""
    return b"".join(field(n, zigzag(v)) for n, v in enumerate((box[0], box[1], box[2] - box[0], box[3] - box[1]), 1))


def unpack_bounds(data: bytes) -> tuple[int, int, int, int]:
    got = {n: unzigzag(v) for n, v in fields(data)}
    x, y = got.get(1, 0), got.get(2, 0)
    return x, y, x + got.get(3, 0), y + got.get(4, 0)


def pack_ring(parts: list[dict]) -> bytes:
    """Ring of parts: each the ``id`` of a way, its ``refs`` and ``lonlats``, and whether it is ``reversed`` in the ring."""
    out = b""
    for p in parts:
        one = field(1, p["id"]) + field(2, deltas(p["refs"])) + field(3, deltas([a["lon"] for a in p["lonlats"]])) + field(4, deltas([a["lat"] for a in p["lonlats"]]))
        out += field(1, one + (field(5, 1) if p["reversed"] else b""))
    return out


def unpack_ring(data: bytes) -> list[dict]:
    parts = []
    for number, value in fields(data):
        if number == 1:
            got = dict(fields(value))
            parts.append({"id": got.get(1, 0), "refs": packed_deltas(got.get(2, b"")).tolist(), "lonlats": _lonlats(got.get(3, b""), got.get(4, b"")), "reversed": got.get(5, 0) == 1})
    return parts


def ring_points(parts: list[dict], key: str = "lonlats") -> list:
    """Points (or ``refs``) of a ring in order; where parts meet, once."""
    out: list = []
    for p in parts:
        some = p[key][::-1] if p["reversed"] else p[key]
        out = out[:-1] + some if out else list(some)
    return out


def pack_polygon_part(index: int, outer: list[dict], inners: list[list[dict]], area: float) -> bytes:
    return field(1, index) + field(2, pack_ring(outer)) + b"".join(field(3, pack_ring(r)) for r in inners) + field(4, zigzag(_hundredths(area)))


def unpack_polygon_part(data: bytes) -> dict:
    out: dict = {"index": 0, "outer": [], "inners": [], "area": 0.0}
    for number, value in fields(data):
        if number == 1:
            out["index"] = value
        elif number == 2:
            out["outer"] = unpack_ring(value)
        elif number == 3:
            out["inners"].append(unpack_ring(value))
        elif number == 4:
            out["area"] = unzigzag(value) * 0.01
    return out


def _plain(ring: Ring) -> list[dict]:
    return [{"id": 0, "refs": [], "lonlats": ring, "reversed": False}]


def _extras(row: dict) -> bytes:
    out = b""
    if row["type"] == POINT:
        out += field(8, zigzag(row["lonlats"][0]["lat"])) + field(9, zigzag(row["lonlats"][0]["lon"]))
    else:
        out += field(12, zigzag(row["zorder"])) if row["zorder"] is not None else b""
    if row["type"] in (LINE, POLYGON):
        out += field(13, deltas([p["lon"] for p in row["lonlats"]])) + field(14, deltas([p["lat"] for p in row["lonlats"]]))
    if row["type"] == LINE:
        out += field(15, zigzag(_hundredths(row["length"])))
    elif row["type"] != POINT:
        out += field(16, zigzag(_hundredths(row["area"])))
    out += field(22, row["minzoom"]) if row["minzoom"] is not None else b""
    out += field(23, 1) if row["reversed"] else b""
    out += field(24, zigzag(row["layer"])) if row["layer"] is not None else b""
    if row["type"] == MULTIPOLYGON:
        out += b"".join(field(25, pack_polygon_part(k, _plain(part[0]), [_plain(r) for r in part[1:]], 0.0)) for k, part in enumerate(row["rings"] or ()) if part)
    return out


def encode_geometries(rows: list[dict], tile: int | None, dates: tuple[int | None, int | None] = (None, None)) -> bytes:
    name = Names()
    body = b"".join(field(r["type"] + ABOVE, pack_common(r, name) + _extras(r)) for r in rows)
    return name.packed() + field(2, body) + pack_about(tile, dates)


def _geometry(kind: int, row: dict, rest: list) -> dict:
    got = dict(rest)
    number = lambda n: unzigzag(got[n]) if n in got else None
    out = {c: row.get(c) for c in ("type", "id", "quadtree", "tags")}
    out |= {"layer": number(24), "zorder": number(12), "minzoom": got.get(22), "lonlats": None, "rings": None, "length": None, "area": None, "reversed": None}
    if kind == POINT:
        out["lonlats"] = [{"lon": number(9), "lat": number(8)}]
    elif kind in (LINE, POLYGON):
        out["lonlats"] = _lonlats(got.get(13, b""), got.get(14, b""))
    if kind == LINE:
        out["length"] = (number(15) or 0) * 0.01
    elif kind in (POLYGON, MULTIPOLYGON):
        out["area"] = (number(16) or 0) * 0.01
    if kind == POLYGON:
        out["reversed"] = got.get(23, 0) == 1
    elif kind == MULTIPOLYGON:
        parts = [unpack_polygon_part(v) for n, v in rest if n == 25]
        if not parts and 17 in got:  # the older form: one part, in the element itself
            parts = [{"outer": unpack_ring(got[17]), "inners": [unpack_ring(v) for n, v in rest if n == 18]}]
        out["rings"] = [[ring_points(p["outer"]), *map(ring_points, p["inners"])] for p in parts]
    return out


def decode_geometries(data: bytes, kinds: set[int]) -> list[dict]:
    """Geometries of the wanted types in a block; other elements are passed over."""
    strings, groups, about = block_parts(data)
    out = []
    for group in groups:
        for number, value in fields(group):
            kind = number - ABOVE
            if kind in kinds and kind >= POINT:
                row, rest = common_fields(kind, value, strings, 0, {"tags"}, None)
                out.append(_geometry(kind, row, rest) | {"tile_qt": about["tile_qt"]})
    return out


def read_geometry_blocks(spark: SparkSession, paths: str | list[str], *, kinds: tuple[int, ...] = (POINT, LINE, POLYGON, MULTIPOLYGON), box: tuple[int, int, int, int] | None = None, frames_a_task: int = 64) -> DataFrame:
    """Geometries of block files (columns of GEOMETRY). With a box, blocks whose tile doesn't touch it are left out where the file has an index."""
    frames, _ = block_frames(paths, box=box)
    wanted = set(kinds)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                with files.open_input(f["path"]) as file:
                    rows = decode_geometries(read_frame(file, f["offset"], f["length"]), wanted)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    index = spark.createDataFrame(frames, "path string, offset bigint, length bigint")
    return index.repartition(int(max(1, np.ceil(len(frames) / frames_a_task))), "path", "offset").mapInArrow(decode, GEOMETRY)


def write_geometry_blocks(shapes: DataFrame, folder: str, *, box: tuple[int, int, int, int] | None = None, index: str | None = "header") -> list[str]:
    """Write geometries (columns of GEOMETRY, ``tile_qt`` if there is one), a file a partition, in their order. Rows without a type,
    an id or a shape are left out. Lengths and areas are kept to hundredths, node ids of rings aren't kept."""
    columns = [c.split(" ", 1)[0] for c in ("type", "id", "quadtree", "tags", "layer", "zorder", "minzoom", "lonlats", "rings", "length", "area", "reversed")]
    columns += ["tile_qt"] if "tile_qt" in shapes.columns else []
    whole = shapes.where("id is not null and ((type in (3, 4, 5) and size(lonlats) > 0) or (type = 6 and rings is not null))")
    return write_blocks(whole.select(*columns), folder, encode_geometries, box=box, index=index)
