"""Change files in XML, and areas from text."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.geo import from_degrees
from tilewright.schema import COLUMNS, ELEMENT, MEMBERS, TAGS
from tilewright.sources import files

_ABOUT = "_id bigint, _version bigint, _timestamp string, _changeset bigint, _uid bigint, _user string, _visible boolean, tag array<struct<_k:string,_v:string>>"
_FLAT = _ABOUT.replace(" bigint", ":bigint").replace(" string", ":string").replace(" boolean", ":boolean").replace(" array", ":array").replace(", ", ",")
_SCHEMA = f"node array<struct<{_FLAT},_lat:string,_lon:string>>, way array<struct<{_FLAT},nd:array<struct<_ref:bigint>>>>, relation array<struct<{_FLAT},member:array<struct<_type:string,_ref:bigint,_role:string>>>>"
_ROW = re.sub(r"(^|, )(\w+) ", lambda m: f"{',' if m.group(1) else ''}{m.group(2)}:", ELEMENT) + ",pos:bigint"
ACTIONS = {"delete": 1, "modify": 4, "create": 5}


def _seconds(text: Column) -> Column:
    """Epoch seconds (UTC) of a time with or without a clock part or zone; null if it is none."""
    plain = F.regexp_replace(F.trim(text), "(Z|[+-]00:?00)$", "")
    return F.unix_timestamp(F.coalesce(F.try_to_timestamp(F.concat(plain, F.lit("+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssxxx")), F.try_to_timestamp(F.concat(plain, F.lit("T00:00:00+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssxxx"))))


def _row(kind: int, change: int) -> Column:
    """An element of a change block as a row; ``pos`` keeps its place among those of its kind in the block."""
    name = ("node", "way", "relation")[kind]
    none = F.array().cast(TAGS)

    def row(e: Column, pos: Column) -> Column:
        info = F.struct(e["_version"].alias("version"), _seconds(e["_timestamp"]).alias("timestamp"), e["_changeset"].alias("changeset"), e["_uid"].alias("user_id"), e["_user"].alias("user"), F.coalesce(e["_visible"], F.lit(change != 1)).alias("visible"))
        tags = F.coalesce(F.transform(e["tag"], lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("val"))), none)
        place = [from_degrees(e[c].try_cast("double")) if kind == 0 else F.lit(None).cast("bigint") for c in ("_lon", "_lat")]
        refs = F.coalesce(F.transform(e["nd"], lambda n: n["_ref"]), F.array().cast("array<bigint>")) if kind == 1 else F.lit(None).cast("array<bigint>")
        member = lambda m: F.struct(F.coalesce(*[F.when(m["_type"] == n, k) for k, n in enumerate(("node", "way", "relation"))]).alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role"))
        members = F.coalesce(F.transform(e["member"], member), F.array().cast(MEMBERS)) if kind == 2 else F.lit(None).cast(MEMBERS)
        values = (F.lit(kind), e["_id"], F.lit(change), F.lit(-1).cast("bigint"), info, tags, *place, refs, members)
        return F.struct(*[v.alias(c) for v, c in zip(values, COLUMNS)], pos.cast("bigint").alias("pos"))

    return F.coalesce(F.transform(name, row), F.array().cast(f"array<struct<{_ROW}>>")).cast(f"array<struct<{_ROW}>>")


def read_osc(spark: SparkSession, paths: str | list[str] | dict[str, int], file_idx: int = 0) -> DataFrame:
    """Rows of change files (``.osc``, also compressed) with ``file_idx`` and ``pos``, which grows along a file for rows of one
    kind and action. ``paths`` may name each file's own ``file_idx``; the files are still read together.

    Read once for each action, so that a row is one such block of a file, not the whole file. Quadtrees are -1: a change
    file has none.
    """
    which = F.lit(file_idx)
    if isinstance(paths, dict):
        names = F.element_at(F.split(F.input_file_name(), "/"), -1)
        which = F.element_at(F.create_map(*[F.lit(v) for p, k in paths.items() for v in (quote(p.rpartition("/")[2]), k)]), names)
        if len({p.rpartition("/")[2] for p in paths}) < len(paths):
            raise ValueError("change files that are read together need different names")
    out = None
    for action, change in ACTIONS.items():
        blocks = spark.read.format("xml").option("rowTag", action).schema(_SCHEMA).load(list(paths) if isinstance(paths, dict) else paths)
        numbered = blocks.withColumn("block", F.monotonically_increasing_id()).withColumn("file_idx", which)
        every = numbered.select("block", "file_idx", F.explode(F.concat(*[_row(kind, change) for kind in range(3)])).alias("e")).select("block", "file_idx", "e.*")
        rows = every.withColumn("pos", F.col("block").cast("decimal(38,0)") * (1 << 31) + F.col("pos")).drop("block")
        out = rows if out is None else out.unionByName(rows)
    return out.select(*COLUMNS, "file_idx", "pos")


def read_ring(path: str) -> list[tuple[int, int]]:
    """Ring of a ``.poly`` file in degrees x 1e7: every line of two numbers, whatever else is in it."""
    out = []
    for line in files.read_text(path).splitlines():
        try:
            lon, lat = map(float, line.split())
        except ValueError:
            continue
        out.append(tuple(int(v * 1e7 + (0.5 if v > 0 else -0.5 if v < 0 else 0)) for v in (lon, lat)))
    return out


#: Fixed value: the box named nwkent.
NWKENT = (750_000, 512_000_000, 3_000_000, 514_000_000)
#: Names that stand for a box.
PLACES = {"planet": (-1_800_000_000, -900_000_000, 1_800_000_000, 900_000_000), "nwkent": NWKENT}


def parse_box(text: str) -> tuple[int, int, int, int]:
    """Box of a name, or of four whole numbers minx, miny, maxx, maxy (degrees x 1e7)."""
    if text in PLACES:
        return PLACES[text]
    match = re.fullmatch(r"\s*[\[(]?\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*[\])]?\s*", text)
    if not match:
        raise ValueError(f"not a box: {text!r}")
    return tuple(map(int, match.groups()))
