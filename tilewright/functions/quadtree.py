"""Quadtree keys: two bits a level from bit 61 downwards, the depth in the low five bits; -1 is null, 0 the root.

Quadrants are 0 north-west, 1 north-east, 2 south-west, 3 south-east of a web-mercator square. In numeric order keys
are in pre-order, so a tile and all below it are one range, and the deepest common tile of a set of keys is that of its
least and greatest. Every function gives null for a null key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH, BUFFER = 18, 0.05
ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def depth(qt: ColumnOrName) -> Column:
    return _col(qt).bitwiseAND(F.lit(31).cast("bigint"))


def tile_round(qt: ColumnOrName, level: ColumnOrName | int) -> Column:
    """The key's ancestor at ``level``; a key that isn't deeper, and -1, stay as they are."""
    q, level = _col(qt), F.lit(level) if isinstance(level, int) else _col(level)
    shift = (F.lit(63) - level * 2).cast("int")
    cut = F.call_function("shiftleft", F.call_function("shiftright", q, shift), shift) + level
    return F.when(q.isNull(), None).when(q < 0, q).when(level == 0, F.lit(0)).when(depth(q) < level, q).otherwise(cut).cast("bigint")


def common(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The deepest tile that holds both keys; -1 leaves the other as it is."""
    a, b = _col(a), _col(b)
    differ = F.shiftright(a.bitwiseXOR(b), 5)
    same = F.when(differ == 0, F.lit(31)).otherwise(F.floor((F.lit(63) - F.length(F.bin(F.shiftleft(differ, 5)))) / 2).cast("int"))
    level = F.least(depth(a), depth(b), same.cast("bigint"))
    return F.when(a.isNull() | b.isNull(), None).when(a < 0, b).when(b < 0, a).when(a == b, a).otherwise(tile_round(a, level)).cast("bigint")


def common_of(qt: ColumnOrName) -> Column:
    """Aggregate: deepest tile that holds all keys, null and -1 left out; -1 if none is left."""
    q = F.when(_col(qt) >= 0, _col(qt))
    return F.coalesce(common(F.min(q), F.max(q)), F.lit(-1).cast("bigint"))


def _quadrant(q: Column, level: Column) -> Column:
    """Quadrant at ``level`` (int, 0 at the top)."""
    return F.call_function("shiftright", q, (F.lit(61) - level * 2).cast("int")).bitwiseAND(F.lit(3).cast("bigint"))


def _levels(q: Column) -> Column:
    """0 .. depth-1, empty for the root and for -1."""
    return F.when((q < 0) | (depth(q) == 0), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (depth(q) - 1).cast("int")))


def as_text(qt: ColumnOrName) -> Column:
    """One letter a level, A to D; ``NULL`` for -1, empty for the root."""
    q = _col(qt)
    letters = F.transform(_levels(q), lambda i: F.substring(F.lit("ABCD"), (_quadrant(q, i) + 1).cast("int"), F.lit(1)))
    return F.when(q.isNull(), None).when(q < 0, F.lit("NULL")).otherwise(F.array_join(letters, ""))


def from_text(text: ColumnOrName) -> Column:
    """The key of a tile's letters; 0 if any other letter is in it, -1 for ``NULL``."""
    t = _col(text)
    places = F.sequence(F.lit(1), F.length(t))
    built = F.aggregate(F.when(F.length(t) == 0, F.array().cast("array<int>")).otherwise(places), F.lit(0).cast("bigint"), lambda key, i: key + F.call_function("shiftleft", (F.instr(F.lit("ABCD"), F.substring(t, i, F.lit(1))) - 1).cast("bigint"), (F.lit(63) - i * 2).cast("int")))
    return F.when(t.isNull(), None).when(t == "NULL", F.lit(-1)).when(t.rlike("^[ABCD]{0,29}$"), built + F.length(t)).otherwise(F.lit(0)).cast("bigint")


def tile_xyz(qt: ColumnOrName) -> Column:
    """struct x, y, z of the tile; y counts from the north. Null for -1."""
    q = _col(qt)
    bits = lambda pick: F.aggregate(_levels(q), F.lit(0).cast("bigint"), lambda n, i: n * 2 + pick(_quadrant(q, i)))
    return F.when(q < 0, None).when(q.isNotNull(), F.struct(bits(lambda v: v.bitwiseAND(F.lit(1).cast("bigint"))).alias("x"), bits(lambda v: F.shiftright(v, 1)).alias("y"), depth(q).alias("z")))


def from_xyz(x: ColumnOrName, y: ColumnOrName, z: ColumnOrName) -> Column:
    """The key of tile x, y at depth z."""
    x, y, z = (_col(c).cast("bigint") for c in (x, y, z))
    bit = lambda n, i: F.call_function("shiftright", n, (z - 1 - i).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    steps = F.when(z == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (z - 1).cast("int")))
    return F.aggregate(steps, z, lambda key, i: key + F.call_function("shiftleft", bit(x, i) + bit(y, i) * 2, (F.lit(61) - i * 2).cast("int")))


def last_below(qt: ColumnOrName) -> Column:
    """Greatest key of the tile and all below it: those are the keys from the tile's own to this one."""
    q = _col(qt)
    start = q - depth(q)
    return F.when(depth(q) == 0, F.lit(2**63 - 1)).otherwise(start + F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(63) - depth(q) * 2).cast("int")) - 1)


def ancestors(qt: ColumnOrName) -> Column:
    """Keys from the root to the tile itself; empty for -1."""
    q = _col(qt)
    return F.when(q.isNull() | (q < 0), F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), depth(q).cast("int")), lambda i: tile_round(q, i)))


def _unmercator(y: Column) -> Column:
    return (F.atan(F.exp(y * F.lit(np.pi / 90.0))) * F.lit(4.0 / np.pi) - 1.0) * 90.0


def tile_bbox(qt: ColumnOrName, buffer: float = 0.0) -> Column:
    """struct minx, miny, maxx, maxy (degrees x 1e7) of the tile, widened by ``buffer`` of its size in degrees."""
    q = _col(qt)
    at = tile_xyz(q)
    size = F.lit(2.0) / F.pow(F.lit(2.0), at["z"])
    x0, y1 = at["x"] * size - 1.0, F.lit(1.0) - at["y"] * size
    minx, maxx = x0 * 180.0, (x0 + size) * 180.0
    maxy, miny = _unmercator(y1 * 90.0), _unmercator((y1 - size) * 90.0)
    dx, dy = (maxx - minx) * buffer, (maxy - miny) * buffer
    whole = lambda v: (v * 1e7 + F.signum(v) * 0.5).cast("bigint")
    return F.when(q >= 0, F.struct(whole(minx - dx).alias("minx"), whole(miny - dy).alias("miny"), whole(maxx + dx).alias("maxx"), whole(maxy + dy).alias("maxy")))


def overlaps_tile(qt: ColumnOrName, minx: int, miny: int, maxx: int, maxy: int) -> Column:
    """Whether the box touches the tile widened by 5 %."""
    b = tile_bbox(qt, 0.05)
    return (b["minx"] <= maxx) & (b["maxx"] >= minx) & (b["miny"] <= maxy) & (b["maxy"] >= miny)


def box_keys(minx: np.ndarray, miny: np.ndarray, maxx: np.ndarray, maxy: np.ndarray, buffer: float = BUFFER, max_depth: int = DEPTH) -> np.ndarray:
    """Keys of the deepest tiles, widened by ``buffer`` of their size, that hold boxes given in degrees x 1e7."""
    empty = ~((minx <= maxx) & (miny <= maxy))
    with np.errstate(all="ignore"):
        x0, x1 = minx * 1e-7, maxx * 1e-7
        y0, y1 = miny * 1e-7, maxy * 1e-7
        x1, y1 = np.where(x0 == x1, x1 + 1e-7, x1), np.where(y0 == y1, y1 + 1e-7, y1)
        north = lambda v: np.nan_to_num(np.log(np.tan((1.0 + v / 90.0) * np.pi / 4.0)) / np.pi, nan=-1e9)
        x0, x1, y0, y1 = x0 / 180.0, x1 / 180.0, north(y0), north(y1)
    key = np.zeros(len(x0), np.int64)
    going = ~empty
    edge = 1.0 + buffer
    for level in range(max_depth):
        going = going & (x0 >= -edge) & (x1 <= edge) & (y0 >= -edge) & (y1 <= edge)
        if not going.any():
            break
        west, east, north_, south = x1 <= 0, x0 >= 0, y0 >= 0, y1 <= 0
        nearly_w, nearly_e = (x1 < buffer) & (abs(x1) < abs(x0)), (x0 > -buffer) & (abs(x1) >= abs(x0))
        nearly_n, nearly_s = (y0 > -buffer) & (abs(y1) >= abs(y0)), (y1 < buffer) & (abs(y1) < abs(y0))
        choices = [west & north_, east & north_, west & south, east & south, nearly_w & nearly_n, nearly_e & nearly_n, nearly_w & nearly_s, nearly_e & nearly_s]
        q = np.select(choices, [0, 1, 2, 3, 0, 1, 2, 3], -1)
        going = going & (q >= 0)
        key = np.where(going, key + (q.astype(np.int64) << (61 - 2 * level)) + 1, key)
        x0, x1 = (2 * np.where((q == 0) | (q == 2), v + 0.5, v - 0.5) for v in (x0, x1))
        y0, y1 = (2 * np.where(q >= 2, v + 0.5, v - 0.5) for v in (y0, y1))
    return np.where(empty, -1, key)


def key_of_box(minx: ColumnOrName, miny: ColumnOrName, maxx: ColumnOrName, maxy: ColumnOrName, buffer: float = BUFFER, max_depth: int = DEPTH) -> Column:
    """Key of a box in degrees x 1e7: -1 if it is empty or a side is null, 0 if it leaves the world.

    Eighteen dependent steps a box: a vectorised function over Arrow batches, as the unrolled expression makes the
    plan blow up.
    """

    @F.pandas_udf("bigint")
    def keys(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        lost = (a.isna() | b.isna() | c.isna() | d.isna()).to_numpy()
        sides = [s.to_numpy(np.float64, na_value=0) for s in (a, b, c, d)]
        return pd.Series(np.where(lost, -1, box_keys(*sides, buffer, max_depth)))

    return keys(_col(minx), _col(miny), _col(maxx), _col(maxy))


def key_of_point(lon: ColumnOrName, lat: ColumnOrName, buffer: float = BUFFER, max_depth: int = DEPTH) -> Column:
    return key_of_box(lon, lat, lon, lat, buffer, max_depth)


def from_xyz_int(x: int, y: int, z: int) -> int:
    """``from_xyz`` of plain numbers."""
    key = z
    for i in range(z):
        bit = z - 1 - i
        key += ((x >> bit & 1) + 2 * (y >> bit & 1)) << (61 - 2 * i)
    return key


def tile_box(qt: int, buffer: float = BUFFER) -> tuple[int, int, int, int]:
    """``tile_bbox`` of a plain key that isn't negative."""
    z = qt & 31
    x = y = 0
    for i in range(z):
        q = qt >> (61 - 2 * i) & 3
        x, y = 2 * x + (q & 1), 2 * y + (q >> 1)
    size = 2.0 / 2.0**z
    x0, y1 = x * size - 1.0, 1.0 - y * size
    flat = lambda v: (np.arctan(np.exp(v * np.pi)) * 4.0 / np.pi - 1.0) * 90.0
    minx, maxx, miny, maxy = x0 * 180.0, (x0 + size) * 180.0, flat(y1 - size), flat(y1)
    dx, dy = (maxx - minx) * buffer, (maxy - miny) * buffer
    return tuple(int(v * 1e7 + np.sign(v) * 0.5) for v in (minx - dx, miny - dy, maxx + dx, maxy + dy))
