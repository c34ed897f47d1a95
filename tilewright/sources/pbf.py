"""Reading and writing files of framed, compressed protocol-buffer blocks of elements.

A file is a sequence of frames, each a length, a small header and a blob. The driver only reads a file's index, or walks
its frame headers where there is none; blobs are read and decoded by the tasks, in batches of frames. The format is the
public one of element files, with further fields for the quadtree of elements (20) and blocks (31, 32), block dates (33, 34),
the group's change type (10) and an index of blocks in the header (22, or a file beside it, 23).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.quadtree import from_xyz_int, overlaps_tile, tile_box
from tilewright.schema import COLUMNS, ELEMENT
from tilewright.sources import files
from tilewright.sources.wire import blob_of_frame, deltas, field, fields, frame, many, open_blob, packed, packed_deltas, signed, unzigzag, zigzag

BLOCK = 8000
#: Name of the index beside a file.
BESIDE = "-filelocs.json"

INFO_FIELDS = ("version", "timestamp", "changeset", "user_id", "user", "visible")
_INFO = pa.struct([("version", pa.int64()), ("timestamp", pa.int64()), ("changeset", pa.int64()), ("user_id", pa.int64()), ("user", pa.string()), ("visible", pa.bool_())])
_TAG = pa.struct([("key", pa.string()), ("val", pa.string())])
_MEMBER = pa.struct([("type", pa.int32()), ("ref", pa.int64()), ("role", pa.string())])
ARROW = {
    "type": pa.int32(),
    "id": pa.int64(),
    "changetype": pa.int32(),
    "quadtree": pa.int64(),
    "info": _INFO,
    "tags": pa.list_(_TAG),
    "lon": pa.int64(),
    "lat": pa.int64(),
    "refs": pa.list_(pa.int64()),
    "members": pa.list_(_MEMBER),
    "tile_qt": pa.int64(),
    "start_date": pa.int64(),
    "end_date": pa.int64(),
}
TYPES = {**dict(part.strip().split(" ", 1) for part in ELEMENT.replace("struct<", "struct\0").split(", ")), "tile_qt": "bigint", "start_date": "bigint", "end_date": "bigint"}
TYPES = {c: t.replace("\0", "<") for c, t in TYPES.items()}


def frame_index(path: str) -> list[tuple[str, str, int, int]]:
    """(path, kind, offset, length) of each blob, from the headers only."""
    out = []
    with files.open_input(path) as file:
        end = file.size()
        while head := file.read(4):
            if len(head) < 4:
                raise ValueError("file ends inside a frame")
            kind, size = "", 0
            for number, value in fields(file.read(struct.unpack(">I", head)[0])):
                if number == 1:
                    kind = value.decode()
                elif number == 3:
                    size = value
            at = file.tell()
            if at + size > end:
                raise ValueError("file ends inside a frame")
            out.append((path, kind, at, size))
            file.seek(at + size)
    return out


def _old_key(data: bytes) -> int:
    at = dict(fields(data))
    return from_xyz_int(at.get(1, 0), at.get(2, 0), at.get(3, 0))


def read_header(path: str) -> dict:
    """bbox (degrees x 1e7), writer, features and index: (quadtree, offset, length) of the frame of each block, where the file
    has an index in its header or beside it."""
    with files.open_input(path) as file:
        head = file.read(4)
        kind, blob, at = "", b"", 0
        if len(head) == 4:
            size = struct.unpack(">I", head)[0]
            about = dict(fields(file.read(size)))
            kind = about.get(1, b"").decode()
            blob = file.read(about.get(3, 0)) if kind == "OSMHeader" else b""
            at = 4 + size + len(blob)
    if kind != "OSMHeader":
        raise ValueError("no header block")
    out: dict = {"bbox": None, "writer": None, "features": [], "index": []}
    for number, value in fields(open_blob(blob)):
        if number == 1:
            sides = {n: unzigzag(v) // 100 for n, v in fields(value)}
            out["bbox"] = tuple(sides.get(n) for n in (1, 4, 2, 3))
        elif number == 4:
            out["features"].append(value.decode())
        elif number == 16:
            out["writer"] = value.decode()
        elif number == 22:
            entry = dict(fields(value))
            key = unzigzag(entry[4]) if 4 in entry else _old_key(entry.get(1, b""))
            size = unzigzag(entry.get(3, 0))
            out["index"].append((key, at, size))
            at += size
        elif number == 23:
            rows = json.loads(files.read_text(path + value.decode()))
            out["index"].extend((int(q), int(a), int(n)) for q, a, n in rows)
    return out


class _Strings:
    """String table of a block, taken by index as Arrow arrays."""

    def __init__(self, data: bytes):
        self.list = [s.decode("utf-8", "replace") for n, s in fields(data) if n == 1]
        self.array = pa.array(self.list, pa.string())

    def take(self, at: np.ndarray) -> pa.Array:
        if len(at) and int(at.max()) >= len(self.list):
            raise ValueError("block names a string that it lacks")
        return self.array.take(pa.array(at.astype(np.int64)))


def _tag_lists(strings: _Strings, keys: np.ndarray, vals: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    both = pa.StructArray.from_arrays([strings.take(keys), strings.take(vals)], fields=list(_TAG))
    return pa.ListArray.from_arrays(pa.array(ends), both)


def _dense_tags(keys: np.ndarray, n: int, strings: _Strings) -> pa.Array:
    """Tags of dense nodes: pairs of numbers, each node's followed by 0."""
    if not len(keys):
        return _tag_lists(strings, keys, keys, np.zeros(n, np.int64))
    stops = np.flatnonzero(keys == 0)
    sizes = np.diff(np.concatenate([[-1], stops])) - 1
    if len(stops) != n or (sizes % 2).any() or stops[-1] != len(keys) - 1:  # a value may be the empty string of number 0
        at, stops = 0, np.empty(n, np.int64)
        for k in range(n):
            while at < len(keys) and keys[at]:
                at += 2
            stops[k] = at
            at += 1
        sizes = np.diff(np.concatenate([[-1], stops])) - 1
    plain = np.ones(len(keys), bool)
    plain[stops[stops < len(keys)]] = False
    flat = keys[plain]
    return _tag_lists(strings, flat[0::2], flat[1::2], sizes // 2)


def _dense(data: bytes, strings: _Strings, change: int, columns: set[str], ids: np.ndarray | None) -> pa.Table | None:
    got = dict(fields(data))
    id_ = packed_deltas(got.get(1, b""))
    n = len(id_)
    keep = None
    if ids is not None:
        keep = np.isin(id_, ids)
        if not keep.any():
            return None
    out: dict[str, pa.Array] = {"type": pa.array(np.zeros(n, np.int32)), "id": pa.array(id_), "changetype": pa.array(np.full(n, change, np.int32))}
    for name, number in (("lat", 8), ("lon", 9)):
        if name in columns:
            out[name] = pa.array(packed_deltas(got.get(number, b"")))
    if "quadtree" in columns:
        out["quadtree"] = pa.array(packed_deltas(got[20]) if got.get(20) else np.full(n, -1, np.int64))
    if "tags" in columns:
        out["tags"] = _dense_tags(packed(got.get(10, b"")), n, strings)
    if "info" in columns:
        info = dict(fields(got.get(5, b"")))
        version = packed(info.get(1, b"")).astype(np.int64)
        if len(version) == n and n:
            parts = [packed_deltas(info[k]) if info.get(k) else np.zeros(n, np.int64) for k in (2, 3, 4, 5)]
            shown = packed(info[6]).astype(bool) if info.get(6) else np.ones(n, bool)
            arrays = [pa.array(version), *(pa.array(p) for p in parts[:3]), strings.take(parts[3]), pa.array(shown)]
            out["info"] = pa.StructArray.from_arrays(arrays, fields=list(_INFO))
    return _table(out, n, columns, keep)


def _table(parts: dict[str, pa.Array], n: int, columns: set[str], keep: np.ndarray | None = None) -> pa.Table:
    table = pa.table({c: parts[c] if c in parts else pa.nulls(n, t) for c, t in ARROW.items() if c in columns})
    return table if keep is None else table.filter(pa.array(keep))


def _info(data: bytes, strings: _Strings) -> dict:
    got = dict(fields(data))
    return {"version": signed(got.get(1, 0)), "timestamp": signed(got.get(2, 0)), "changeset": signed(got.get(3, 0)), "user_id": signed(got.get(4, 0)), "user": strings.list[got[5]] if 5 in got else None, "visible": bool(got.get(6, 1))}


def common_fields(kind: int, data: bytes, strings: _Strings, change: int, columns: set[str], ids: np.ndarray | None) -> tuple[dict, list] | None:
    """Row and further fields of a single element; None if it isn't wanted."""
    row = {"type": kind, "id": 0, "changetype": change, "quadtree": -1, "info": None, "tags": []}
    keys = vals = ()
    rest = []
    for number, value in fields(data):
        if number == 1:
            row["id"] = unzigzag(value) if kind == 0 else signed(value)
            if ids is not None and not len(np.intersect1d(ids, [row["id"]])):
                return None
        elif number == 2:
            keys = packed(value)
        elif number == 3:
            vals = packed(value)
        elif number == 4:
            row["info"] = _info(value, strings) if "info" in columns else None
        elif number == 20:
            row["quadtree"] = unzigzag(value)
        else:
            rest.append((number, value))
    if "tags" in columns:
        row["tags"] = [{"key": strings.list[k], "val": strings.list[v]} for k, v in zip(keys, vals)]
    return row, rest


def _single(kind: int, data: bytes, strings: _Strings, change: int, columns: set[str], ids: np.ndarray | None) -> dict | None:
    read = common_fields(kind, data, strings, change, columns, ids)
    if read is None:
        return None
    row, rest = read
    got = dict(rest)
    if kind == 0:
        row["lat"], row["lon"] = (unzigzag(got[n]) if n in got else None for n in (8, 9))
    elif kind == 1 and "refs" in columns:
        row["refs"] = packed_deltas(got.get(8, b"")).tolist()
    elif kind == 2 and "members" in columns:
        parts = packed(got.get(10, b"")).tolist(), packed_deltas(got.get(9, b"")).tolist(), packed(got.get(8, b"")).tolist()
        row["members"] = [{"type": t, "ref": r, "role": strings.list[s]} for t, r, s in zip(*parts)]
    return row


def block_parts(data: bytes) -> tuple[_Strings, list[bytes], dict]:
    """String table, groups, and the block's tile and dates."""
    strings, groups, about = _Strings(b""), [], {"tile_qt": None, "start_date": None, "end_date": None}
    for number, value in fields(data):
        if number == 1:
            strings = _Strings(value)
        elif number == 2:
            groups.append(value)
        elif number == 31:
            about["tile_qt"] = _old_key(value)
        elif number == 32:
            about["tile_qt"] = unzigzag(value)
        elif number == 33:
            about["start_date"] = signed(value)
        elif number == 34:
            about["end_date"] = signed(value)
    return strings, groups, about


def decode_block(data: bytes, kinds: set[int], columns: list[str] | None = None, ids: dict[int, np.ndarray] | None = None) -> pa.Table:
    """Elements of the wanted kinds, columns and ids of a block. A missing quadtree is -1, and ``visible`` is true where it isn't given."""
    columns = columns or [*COLUMNS, "tile_qt"]
    wanted = set(columns)
    strings, groups, about = block_parts(data)
    tables: list[pa.Table] = []
    rows: list[dict] = []
    schema = pa.schema([(c, t) for c, t in ARROW.items() if c in wanted])

    def flush() -> None:
        if rows:
            tables.append(pa.Table.from_pylist(rows, schema=schema))
            rows.clear()

    for group in groups:
        parts = list(fields(group))
        change = next((v for n, v in parts if n == 10), 0)
        for number, value in parts:
            kind = {1: 0, 2: 0, 3: 1, 4: 2}.get(number)
            if kind is None or kind not in kinds or (ids is not None and kind not in ids):
                continue
            some = None if ids is None else ids[kind]
            if number == 2:
                flush()
                table = _dense(value, strings, change, wanted, some)
                if table is not None:
                    tables.append(table)
            else:
                row = _single(kind, value, strings, change, wanted, some)
                if row is not None:
                    rows.append(row)
    flush()
    out = pa.concat_tables(tables) if tables else schema.empty_table()
    for name, value in about.items():
        if name in wanted:
            out = out.set_column(out.schema.get_field_index(name), name, pa.array([value] * len(out), pa.int64()))
    return out.select(columns)


def block_frames(paths: str | list[str], *, box: tuple[int, int, int, int] | None = None, tiles: Iterable[int] | None = None) -> tuple[list[tuple[str, int, int]], bool]:
    """(path, offset, length) of the frames of all blocks that may hold what lies in a box, or what belongs to the given tiles; and whether
    all of them came from an index. Without an index a file's blocks all may."""
    tiles = None if tiles is None else set(tiles)
    out, indexed = [], True
    for path in [paths] if isinstance(paths, str) else paths:
        try:
            index = read_header(path)["index"]
        except ValueError:
            index = []
        if index:
            for key, offset, length in index:
                if (box is None or key < 0 or _touches(key, box)) and (tiles is None or key in tiles):
                    out.append((path, offset, length))
            continue
        indexed = False
        for _, kind, at, size in frame_index(path):
            if kind == "OSMData":
                out.append((path, at, -size))  # a blob, not a frame
    return out, indexed


def _touches(key: int, box: tuple[int, int, int, int]) -> bool:
    x0, y0, x1, y1 = tile_box(key)
    return x0 <= box[2] and x1 >= box[0] and y0 <= box[3] and y1 >= box[1]


def read_frame(file, offset: int, length: int) -> bytes:
    """Content of a block: of a frame, or of the blob alone where ``length`` is negative; empty for other kinds of frames."""
    file.seek(offset)
    data = file.read(abs(length))
    if length < 0:
        return open_blob(data)
    kind, blob = blob_of_frame(data)
    return open_blob(blob) if kind == "OSMData" else b""


def read_pbf(
    spark: SparkSession,
    paths: str | list[str],
    *,
    kinds: tuple[int, ...] = (0, 1, 2),
    columns: list[str] | None = None,
    ids: Iterable[tuple[int, int]] | None = None,
    box: tuple[int, int, int, int] | None = None,
    tiles: Iterable[int] | None = None,
    frames_a_task: int = 64,
) -> DataFrame:
    """Elements of files that all executors can open, with the block's ``tile_qt``.

    Kinds, columns (of ``schema.ELEMENT``, ``tile_qt``, ``start_date``, ``end_date``) and ids ((type, id), as many as fit a
    task; join with ``extract.inside`` for more) that aren't wanted are not decoded. With a box only blocks whose tile touches
    it are read, with ``tiles`` only those of these tiles: by the index where a file has one. A box that no indexed tile
    touches is an error. Elements of blocks without a tile always come out.
    """
    frames, indexed = block_frames(paths, box=box, tiles=tiles)
    if box is not None and indexed and not frames:
        raise ValueError("no tiles match the box")
    wanted, columns = set(kinds), list(columns or [*COLUMNS, "tile_qt"])
    only = None
    if ids is not None:
        pairs = list(ids)
        only = {k: np.unique(np.array([i for t, i in pairs if t == k], np.int64)) for k in {t for t, _ in pairs}}
    filtered = not indexed and (box is not None or tiles is not None)
    decoded = columns + (["tile_qt"] if filtered and "tile_qt" not in columns else [])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                with files.open_input(f["path"]) as file:
                    table = decode_block(read_frame(file, f["offset"], f["length"]), wanted, decoded, only)
                yield from table.combine_chunks().to_batches()

    index = spark.createDataFrame(frames, "path string, offset bigint, length bigint")
    out = index.repartition(max(1, -(-len(frames) // frames_a_task)), "path", "offset").mapInArrow(decode, ", ".join(f"{c} {TYPES[c]}" for c in decoded))
    if filtered and box is not None:
        out = out.where(F.coalesce(overlaps_tile("tile_qt", *box), F.lit(True)) | (F.col("tile_qt") < 0))
    if filtered and tiles is not None:
        out = out.where(F.col("tile_qt").isin(*tiles))
    return out.select(*columns)


def uncompressed_size(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, blocks, size) of files: the size of all blocks without compression."""
    paths = [paths] if isinstance(paths, str) else paths
    index = spark.createDataFrame([f for p in paths for f in frame_index(p)], "path string, kind string, offset bigint, length bigint")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for f in batch.to_pylist():
                with files.open_input(f["path"]) as file:
                    file.seek(f["offset"])
                    sizes.append(len(open_blob(file.read(f["length"]))))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "size"])

    return index.mapInArrow(measure, "path string, size bigint").groupBy("path").agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("size"))


class Names:
    """String table that is being made. Number 0 ends lists and names nothing."""

    def __init__(self):
        self.at: dict[str | None, int] = {None: 0}

    def __call__(self, text: str | None) -> int:
        return self.at.setdefault(text or "", len(self.at))

    def packed(self) -> bytes:
        return field(1, b"".join(field(1, (s or "").encode()) for s in self.at))


def pack_common(row: dict, name: Names) -> bytes:
    """Id, tags, info and quadtree of one element. Null info is left out."""
    tags = [t for t in row["tags"] or () if t]
    out = field(1, row["id"]) + field(2, many([name(t["key"]) for t in tags])) + field(3, many([name(t["val"]) for t in tags]))
    info = row.get("info")
    if info:
        numbers = b"".join(field(n, info[c]) for n, c in enumerate(INFO_FIELDS[:4], 1) if info[c] is not None)
        user = b"" if info["user"] is None else field(5, name(info["user"]))
        out += field(4, numbers + user + (field(6, 0) if info["visible"] is False else b""))
    return out + field(20, zigzag(-1 if row["quadtree"] is None else row["quadtree"]))


def encode_block(rows: list[dict], tile: int | None, dates: tuple[int | None, int | None] = (None, None)) -> bytes:
    """A block of elements, one group for each kind and change type.

    Nodes with place and info are packed densely; the others, deleted ones mostly, one by one without what they lack, so
    nothing that is null comes back as a value.
    """
    name = Names()
    groups = []
    dense = lambda r: r["type"] == 0 and r["lon"] is not None and r["lat"] is not None and r["info"] is not None and None not in r["info"].values()
    for kind, change, whole in dict.fromkeys((r["type"], r["changetype"] or 0, dense(r)) for r in rows):
        some = [r for r in rows if (r["type"], r["changetype"] or 0, dense(r)) == (kind, change, whole)]
        if whole:
            infos = [r["info"] for r in some]
            keys = [v for r in some for v in [*(x for t in r["tags"] or () if t for x in (name(t["key"]), name(t["val"]))), 0]]
            about = b"".join(field(n, f([i[c] for i in infos])) for n, c, f in ((1, "version", many), (2, "timestamp", deltas), (3, "changeset", deltas), (4, "user_id", deltas)))
            about += field(5, deltas([name(i["user"]) for i in infos])) + field(6, many([int(i["visible"]) for i in infos]))
            body = field(2, field(1, deltas([r["id"] for r in some])) + field(5, about) + field(8, deltas([r["lat"] for r in some])) + field(9, deltas([r["lon"] for r in some])) + field(10, many(keys)) + field(20, deltas([-1 if r["quadtree"] is None else r["quadtree"] for r in some])))
        else:
            body = b""
            for r in some:
                one = pack_common(r | {"id": zigzag(r["id"])} if kind == 0 else r, name)
                if kind == 0:
                    one += b"".join(field(n, zigzag(r[c])) for n, c in ((8, "lat"), (9, "lon")) if r[c] is not None)
                elif kind == 1:
                    one += field(8, deltas([x for x in r["refs"] or () if x is not None]))
                else:
                    members = [m for m in r["members"] or () if m and m["type"] is not None and m["ref"] is not None]
                    one += field(8, many([name(m["role"]) for m in members])) + field(9, deltas([m["ref"] for m in members])) + field(10, many([m["type"] for m in members]))
                body += field({0: 1, 1: 3, 2: 4}[kind], one)
        groups.append(field(2, body + (field(10, change) if change else b"")))
    return name.packed() + b"".join(groups) + pack_about(tile, dates)


def pack_about(tile: int | None, dates: tuple[int | None, int | None] = (None, None)) -> bytes:
    """Tile and dates of a block."""
    return (b"" if tile is None else field(32, zigzag(tile))) + b"".join(field(n, d) for n, d in zip((33, 34), dates) if d)


def write_blocks(rows: DataFrame, folder: str, encode, *, box: tuple[int, int, int, int] | None, index: str | None, dates: tuple[int | None, int | None] = (None, None)) -> list[str]:
    """Write one file a partition: rows in their order, a block for each tile and BLOCK rows, made by ``encode(rows, tile, dates)``.

    ``index``: ``header`` puts (tile, length) of each block into the header, ``beside`` into a file beside it, None neither.
    A task writes its blocks first, the header before them when it knows the index, and gives the file its name last, so one
    that runs again leaves one whole file.
    """
    files.make_folder(folder)
    sides = box or (-1_800_000_000, -900_000_000, 1_800_000_000, 900_000_000)
    head = field(1, b"".join(field(n, zigzag(v * 100)) for n, v in zip((1, 4, 2, 3), sides))) + field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes") + field(16, b"tilewright")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        path = files.join(folder, f"part-{task.partitionId():05}.pbf")
        part = f"{path}.{task.taskAttemptId()}"
        held: list[dict] = []
        lengths: list[tuple[int, int]] = []

        def block(file) -> None:
            tile = held[-1].get("tile_qt")
            data = frame("OSMData", encode(held, tile, dates))
            file.write(data)
            lengths.append((-1 if tile is None else tile, len(data)))
            held.clear()

        with files.open_output(part + ".blocks") as file:
            for batch in batches:
                for row in batch.to_pylist():
                    if held and (len(held) == BLOCK or row.get("tile_qt") != held[-1].get("tile_qt")):
                        block(file)
                    held.append(row)
            if held:
                block(file)
        if lengths:
            entries = b"".join(field(22, field(2, 0) + field(3, zigzag(n)) + field(4, zigzag(q))) for q, n in lengths) if index == "header" else b""
            first = frame("OSMHeader", head + entries + (field(23, BESIDE.encode()) if index == "beside" else b""))
            with files.open_output(part) as file, files.open_input(part + ".blocks") as blocks:
                file.write(first)
                while piece := blocks.read(1 << 24):
                    file.write(piece)
            if index == "beside":
                starts = np.cumsum([len(first), *(n for _, n in lengths)]).tolist()
                files.write_text(path + BESIDE, json.dumps([[q, at, n] for (q, n), at in zip(lengths, starts)]))
            files.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])
        files.remove(part + ".blocks")

    return sorted(r["path"] for r in rows.mapInArrow(write, "path string").collect())


def write_pbf(elements: DataFrame, folder: str, *, box: tuple[int, int, int, int] | None = None, index: str | None = "header", dates: tuple[int | None, int | None] = (None, None)) -> list[str]:
    """Write elements into a folder that all executors share; see ``write_blocks``. Gives the files' paths. Null ids and types are left
    out, null references, tags and members too, and members without type or id."""
    columns = [*COLUMNS, "tile_qt"] if "tile_qt" in elements.columns else COLUMNS
    return write_blocks(elements.where("id is not null and type is not null").select(*columns), folder, encode_block, box=box, index=index, dates=dates)


