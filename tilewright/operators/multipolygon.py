"""Multipolygons of relations, assembled from the lines of their member ways."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import tags as T
from tilewright.functions.geo import mercator, point_in_ring
from tilewright.functions.style import Style

Part = tuple[int, list[int], list[tuple[int, int]]]


class Chain:
    """Ways joined end to end."""

    def __init__(self, parts: list[Part]):
        self.parts = parts

    @property
    def head(self) -> int:
        return self.parts[0][1][0]

    @property
    def tail(self) -> int:
        return self.parts[-1][1][-1]

    @property
    def closed(self) -> bool:
        return self.head == self.tail and len(self.refs()) > 2

    def turned(self) -> list[Part]:
        return [(i, refs[::-1], at[::-1]) for i, refs, at in reversed(self.parts)]

    def take(self, other: Chain) -> bool:
        """Join ``other`` where its ends meet this chain's: its start or end to the tail, else its start or end to the head."""
        if other.head == self.tail:
            self.parts = self.parts + other.parts
        elif other.tail == self.tail:
            self.parts = self.parts + other.turned()
        elif other.head == self.head:
            self.parts = other.turned() + self.parts
        elif other.tail == self.head:
            self.parts = other.parts + self.parts
        else:
            return False
        return True

    def refs(self) -> list[int]:
        return self.parts[0][1] + [r for _, refs, _ in self.parts[1:] for r in refs[1:]]

    def places(self) -> list[tuple[int, int]]:
        return self.parts[0][2] + [p for _, _, at in self.parts[1:] for p in at[1:]]


def join_chains(parts: list[Part]) -> list[Chain]:
    """Closed chains and what is left open, from ways in their order: each goes to the first open chain that it fits, until no two fit."""
    chains = [Chain([p]) for p in parts]
    while True:
        joined: list[Chain] = []
        for chain in chains:
            if chain.closed or not any(not c.closed and c.take(chain) for c in joined):
                joined.append(chain)
        if len(joined) == len(chains):
            return joined
        chains = joined


def _signed_area(ring: list[tuple[int, int]], metres: dict) -> float:
    at = [metres[p] for p in ring]
    return -0.5 * sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(at, at[1:]))


def assemble(outer: list[Part], inner: list[Part], metres: dict, box: tuple[int, int, int, int] | None) -> tuple[list | None, float, str | None]:
    """(polygons as lists of rings, area, error) of a relation's outer and inner ways.

    Outer rings come out clockwise, holes the other way. A hole belongs to the first outer ring around all its points. Errors:
    ``incomplete rings``, ``orphan inner`` (both may go with a geometry) and ``no outers!!!``.
    """
    error = None
    sides, passed = [], []
    for parts in (outer, inner):
        rings = []
        for chain in join_chains(parts):
            at = chain.places()
            clear = box is not None and (min(p[0] for p in at) > box[2] or max(p[0] for p in at) < box[0] or min(p[1] for p in at) > box[3] or max(p[1] for p in at) < box[1])
            if chain.closed and len(chain.refs()) > 3 and not clear:
                rings.append(at)
            else:
                passed.append(chain.closed)
        sides.append(rings)
    if passed and (sides[0] or sides[1] or not all(passed)):
        error = "incomplete rings"
    polygons: list[list] = [[ring] for ring in sides[0]]
    for hole in sides[1]:
        home = next((p for p in polygons if all(point_in_ring(p[0], at) for at in hole)), None)
        if home is None:
            error = "orphan inner"
        else:
            home.append(hole)
    if not polygons:
        return None, 0.0, None if passed and all(passed) and not sides[1] else "no outers!!!"
    area, out = 0.0, []
    for polygon in polygons:
        signed = [_signed_area(r, metres) for r in polygon]
        area += max(0.0, abs(signed[0]) - sum(map(abs, signed[1:])))
        out.append([r if (a > 0) == (k == 0) else r[::-1] for k, (r, a) in enumerate(zip(polygon, signed))])
    return out, area, error


def build_multipolygons(relations: DataFrame, ways: DataFrame, style: Style, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(id, tags, layer, rings, area, error) of relations with type ``multipolygon`` or ``boundary`` and way members.

    ``ways`` have ``lonlats``. Roles ``outer`` and empty or null are outer, ``inner`` is inner, others are left out, as are missing ways and
    ways with missing nodes. ``rings`` is null where there is no outer ring. Each relation is one row of its own members,
    grouped by id; its size is that of the relation.
    """
    kind = T.find_tag(F.col("tags"), "type")
    kinds = [k for k, on in (("multipolygon", style.multipolygons), ("boundary", style.boundaries)) if on]
    wanted = relations.where(kind.isin(*kinds) if kinds else F.lit(False)).select("id", "tags", "members")
    flat = wanted.select("id", F.posexplode("members").alias("pos", "m")).where("m.type = 1")
    role = F.when(F.coalesce("m.role", F.lit("")).isin("", "outer"), 0).when(F.col("m.role") == "inner", 1)
    flat = flat.select("id", "pos", F.col("m.ref").alias("way_id"), role.alias("side")).where("side is not null")
    usable = ways.where("missing = 0 and size(lonlats) >= 2").select(F.col("id").alias("way_id"), "refs", F.transform("lonlats", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), mercator(p["lon"], p["lat"]).alias("m"))).alias("at"))
    packed = flat.join(usable, "way_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "side", "way_id", "refs", "at"))).alias("parts"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for id_, parts in zip(frame["id"], frame["parts"]):
                metres: dict = {}
                sides: tuple[list, list] = ([], [])
                for part in parts:
                    at = [(p["lon"], p["lat"]) for p in part["at"]]
                    metres.update({a: (p["m"]["x"], p["m"]["y"]) for a, p in zip(at, part["at"])})
                    sides[part["side"]].append((part["way_id"], [int(r) for r in part["refs"]], at))
                polygons, area, error = assemble(*sides, metres, box)
                rings = polygons and [[[{"lon": x, "lat": y} for x, y in ring] for ring in polygon] for polygon in polygons]
                rows.append((id_, rings, area, error))
            yield pd.DataFrame(rows, columns=["id", "rings", "area", "error"])

    built = packed.mapInPandas(build, "id bigint, rings array<array<array<struct<lon:bigint,lat:bigint>>>>, area double, error string")
    keep = T.filter_tags(F.col("tags"), list(style.feature_keys), None if style.other_keys is None else list(style.other_keys), list(style.drop_keys))
    tagged = wanted.select("id", T.layer(F.col("tags")).alias("layer"), (T.remove_tag(keep, "type") if style.drop_keys else keep).alias("tags"))
    return tagged.join(built, "id")


def error_counts(made: DataFrame) -> DataFrame:
    """(error, n, least_id, greatest_id): how many relations of ``build_multipolygons`` have each error, and between which ids."""
    return made.where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id"), F.max("id").alias("greatest_id"))
