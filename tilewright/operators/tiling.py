"""Tiles: histograms over keys, roll-ups, size-bounded groups, and clustering of elements by tile."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.quadtree import ancestors, depth, last_below, tile_round
from tilewright.plans.lineage import cut, task_count


def key_histogram(keys: DataFrame, level: int, weight: str | None = None) -> DataFrame:
    """(quadtree, n): rows (or summed weight) per key rounded to ``level``; null and -1 are left out."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return keys.where("quadtree >= 0").groupBy(tile_round("quadtree", level).alias("quadtree")).agg(n.alias("n"))


def subtree_totals(histogram: DataFrame) -> DataFrame:
    """(quadtree, own, total) of every tile that has rows or lies above one that does."""
    up = histogram.select(F.explode(ancestors("quadtree")).alias("at"), "quadtree", "n")
    return up.groupBy(F.col("at").alias("quadtree")).agg(F.coalesce(F.sum(F.when(F.col("at") == F.col("quadtree"), F.col("n"))), F.lit(0)).alias("own"), F.sum("n").alias("total"))


def rolled_up(histogram: DataFrame, least: int, levels: int = 17) -> DataFrame:
    """Histogram in which tiles whose subtree holds fewer than ``least`` are folded into their parents, from the deepest level up."""
    now = histogram
    for level in range(levels, 0, -1):
        deep = now.where(depth("quadtree") >= level).groupBy(tile_round("quadtree", level).alias("tile")).agg(F.sum("n").alias("total"))
        small = deep.where(F.col("total") < least).select("tile")
        keyed = now.withColumn("tile", tile_round("quadtree", level)).join(small.withColumn("small", F.lit(True)), "tile", "left")
        now = keyed.select(F.when(F.col("small") & (depth("quadtree") >= level), tile_round("quadtree", level - 1)).otherwise(F.col("quadtree")).alias("quadtree"), "n").groupBy("quadtree").agg(F.sum("n").alias("n"))
        now = cut(now, "histogram")  # each level reads the one before twice
    return now


class TileTree:
    """Tree of the tiles of a histogram, on the driver. Its size is that of the histogram and the tiles above."""

    def __init__(self, weights: dict[int, int]):
        self.own: dict[int, int] = defaultdict(int)
        self.total: dict[int, int] = defaultdict(int)
        self.children: dict[int, list[int]] = defaultdict(list)
        for qt, n in weights.items():
            self.own[qt] += n
            for level in range((qt & 31) + 1):
                self.total[self.up(qt, level)] += n
        for qt in sorted(self.total):
            if qt & 31:
                self.children[self.up(qt, (qt & 31) - 1)].append(qt)

    @staticmethod
    def up(qt: int, level: int) -> int:
        return 0 if level == 0 else ((qt >> (63 - 2 * level)) << (63 - 2 * level)) + level

    def groups(self, target: int, least: int, step: int = 50) -> dict[int, int]:
        """(tile -> total) of greedy groups of about ``target``, each one subtree or what is left at a tile.

        In pre-order, a tile that has rows of its own, or below which nothing is taken yet, is taken if what remains at and below it lies in a
        window around the target, or can't be divided: it is all its own, or what remains below each child is at most ``least``. Passes over the tree repeat until one
        takes nothing, then the window widens by ``step`` at both ends (never below ``least``). Once less than the window's
        upper end remains, or only the root's own rows, it is the root's group; so is what no window has taken.
        """
        left = dict(self.total)
        taken: dict[int, int] = {}
        low, high = target - step, target + step
        while left.get(0, 0) > 0:
            while left[0] >= high and left[0] != self.own[0] and self._pass(left, taken, low, high, least):
                pass
            if left[0] < high or left[0] == self.own[0]:
                break
            low, high = max(least, low - step), high + step
            if high > step * target:
                break
        if left.get(0, 0) > 0:
            taken[0] = taken.get(0, 0) + left[0]
        return taken

    def _pass(self, left: dict[int, int], taken: dict[int, int], low: int, high: int, least: int) -> bool:
        """Take what fits the window, once in pre-order; whether anything was taken."""
        some = False
        stack = [0]
        while stack:
            qt = stack.pop()
            n = left[qt]
            if n < low or n <= 0:
                continue
            below = self.children[qt]
            if (self.own[qt] or n == self.total[qt]) and (n == self.own[qt] or n <= high or all(left[c] <= least for c in below)):
                taken[qt] = taken.get(qt, 0) + n
                some = True
                for level in range((qt & 31) + 1):
                    left[self.up(qt, level)] -= n
                clear = list(below)
                while clear:
                    c = clear.pop()
                    left[c] = 0
                    clear.extend(self.children[c])
            else:
                stack.extend(reversed(below))
        return some


def without_light(histogram: DataFrame, least: int) -> DataFrame:
    """Histogram in which each greatest subtree with a total below ``least`` is one tile, its root; weights aren't negative.

    No part of such a subtree is a group by itself, so groups are the same; it has at most 4 rows for each heavier tile more.
    """
    heavy = subtree_totals(histogram).where(F.col("total") >= least).select(F.col("quadtree").alias("at"))
    up = histogram.select("quadtree", "n", F.explode(ancestors("quadtree")).alias("at"))
    deepest = up.join(heavy, "at").groupBy("quadtree").agg(F.max(depth("at")).alias("heavy"))
    below = tile_round("quadtree", F.least(depth("quadtree"), F.coalesce("heavy", F.lit(-1)) + 1).cast("int"))
    return histogram.join(deepest, "quadtree", "left").groupBy(below.alias("quadtree")).agg(F.sum("n").alias("n"))


def grouped_tiles(histogram: DataFrame, target: int, least: int) -> DataFrame:
    """(tile_qt, weight, nth) of size-bounded groups, numbered from 1 in pre-order.

    The greedy choice is sequential; it runs on the driver, over what is left when subtrees lighter than ``least`` are one tile
    each. So its size follows the total weight divided by ``least``, times the depth, whatever the level of the keys.
    """
    spark = histogram.sparkSession
    tree = TileTree({r["quadtree"]: r["n"] for r in without_light(histogram, least).toLocalIterator()})
    rows = [(qt, n, k) for k, (qt, n) in enumerate(sorted(tree.groups(target, least).items()), 1)]
    return spark.createDataFrame(rows, "tile_qt bigint, weight bigint, nth int")


def assign_tiles(keys: DataFrame, tiles: DataFrame, key: str = "quadtree") -> DataFrame:
    """``keys`` with ``tile_qt``: the deepest of ``tiles`` that holds the key, the root if none does; null for a null key or -1.

    Tiles nest, so in key order the wanted tile is one of those open at the key: matched by the key's ancestors, of
    which there are at most 32, against distinct tiles. Distinct keys are matched, not rows.
    """
    distinct = keys.where(F.col(key) >= 0).select(F.col(key).alias("_key")).distinct()
    up = distinct.select("_key", F.explode(ancestors("_key")).alias("_tile"))
    found = up.join(tiles.select(F.col("tile_qt").alias("_tile")).where("_tile >= 0").distinct(), "_tile").groupBy("_key").agg(F.max_by("_tile", depth("_tile")).alias("_tile"))
    joined = keys.join(found, keys[key] == found["_key"], "left")
    return joined.withColumn("tile_qt", F.when(F.col(key) >= 0, F.coalesce("_tile", F.lit(0).cast("bigint")))).drop("_key", "_tile")


def clustered(elements: DataFrame, tiles: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """Elements with their tile, in ranges of tiles, sorted by (tile_qt, type, id) within: ready to be written so that files and row
    groups hold few tiles each. The range key takes the id too, so a tile with too many rows is divided.

    Without ``rows_a_task`` ranges are sized by the engine from the bytes that are shuffled, which saves a count."""
    tiled = assign_tiles(elements, tiles)
    order = ("tile_qt", "type", "id")
    ranged = tiled.repartitionByRange(*order) if rows_a_task is None else tiled.repartitionByRange(task_count(elements.sparkSession, elements.count(), rows_a_task), *order)
    return ranged.sortWithinPartitions(*order)


def with_keys(elements: DataFrame, keys: DataFrame) -> DataFrame:
    """Elements with the ``quadtree`` of ``keys`` (type, id, quadtree). An element without a key is an error, and so is a second key
    for one; keys of other elements are ignored."""
    joined = elements.drop("quadtree", "tile_qt").join(keys.groupBy("type", "id").agg(F.max("quadtree").alias("quadtree"), F.count(F.lit(1)).alias("_n")), ["type", "id"], "left")
    name = F.concat_ws(" ", F.col("type").cast("string"), F.col("id").cast("string"))
    known = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no key for element "), name))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several keys for element "), name))).otherwise(F.col("quadtree"))
    return joined.withColumn("quadtree", known.cast("bigint")).drop("_n")


def joined_keys(parts: list[DataFrame]) -> DataFrame:
    """Keys (type, id, quadtree) of several stores, which must not share an element: one that two of them have is an error."""
    out = parts[0].select("type", "id", "quadtree")
    for p in parts[1:]:
        out = out.unionByName(p.select("type", "id", "quadtree"))
    name = F.concat_ws(" ", F.lit("stores share element"), F.col("type").cast("string"), F.col("id").cast("string"))
    counted = out.groupBy("type", "id").agg(F.max("quadtree").alias("quadtree"), F.count(F.lit(1)).alias("_n"))
    return counted.select("type", "id", F.when(F.col("_n") > 1, F.raise_error(name).cast("bigint")).otherwise(F.col("quadtree")).alias("quadtree"))


def in_tile(column: str, tile: int) -> Column:
    """Keys of the tile and all below: a range, so files are skipped by their least and greatest key."""
    q = F.lit(tile)
    return F.col(column).between(q, last_below(q))


def numbered_blocks(elements: DataFrame, size: int = 8000, bucket: int = 1 << 16, *, strict: bool = False) -> DataFrame:
    """(type, id, block): elements in order of (type, id), ``size`` to a block, numbered from 0 per type.

    ``strict`` makes an element that comes twice an error. Positions come from counts of id ranges and a rank inside each range, so no single task sees a whole type.
    """
    keyed = elements.select("type", "id").withColumn("range", F.floor(F.col("id") / bucket).cast("bigint"))
    counts = keyed.groupBy("type", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("type").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = counts.select("type", "range", before.alias("start"))
    along = Window.partitionBy("type", "range").orderBy("id")
    inside = F.row_number().over(along) - 1
    if strict:
        twice = F.concat_ws(" ", F.lit("element comes twice:"), F.col("type").cast("string"), F.col("id").cast("string"))
        keyed = keyed.withColumn("_before", F.lag("id").over(along)).withColumn("id", F.when(F.col("_before") == F.col("id"), F.raise_error(twice).cast("bigint")).otherwise(F.col("id"))).drop("_before")
    return keyed.withColumn("inside", inside).join(starts, ["type", "range"]).select("type", "id", F.floor((F.col("start") + F.col("inside")) / size).cast("bigint").alias("block"))


def split_key(kind: Column, id_: Column, node_split: int, way_split: int, offset: int) -> Column:
    """Number of the id range of an element: nodes, ways (from ``offset``) and relations (from twice that), each capped; else -1."""
    part = lambda width: F.least(F.floor(id_ / width).cast("bigint"), F.lit(offset - 1).cast("bigint"))
    return F.when(kind == 0, part(node_split)).when(kind == 1, part(way_split) + offset).when(kind == 2, part(way_split // 2) + 2 * offset).otherwise(F.lit(-1).cast("bigint"))
