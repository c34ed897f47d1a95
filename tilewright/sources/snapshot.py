"""Datasets of a base and dated deltas in one folder, with a list of their files.

``base/part=P`` and ``delta/file_idx=N`` hold elements with their tile, clustered by tile; ``tiles`` names the tiles of the base and
the parts that hold them, ``index/...`` the tiles that hold an element or a relation with it as member. ``filelist.json`` names base and
deltas in order with their end dates, ``settings.json`` how the dataset is kept; these two lists are small and kept by the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.geo import tile_meets_ring
from tilewright.functions.quadtree import overlaps_tile
from tilewright.functions.text import read_state
from tilewright.operators import overlay
from tilewright.operators.extract import area_ids, filter_members
from tilewright.operators.tiling import clustered
from tilewright.plans.lineage import cut
from tilewright.schema import COLUMNS
from tilewright.sources import files

Box = tuple[int, int, int, int]


def _read(root: str, name: str) -> list | dict:
    return json.loads(files.read_text(files.join(root, name)))


def _write(root: str, name: str, value: list | dict) -> None:
    files.write_text(files.join(root, name), json.dumps(value))


def file_list(root: str) -> list[dict]:
    return _read(root, "filelist.json")


def settings(root: str) -> dict:
    return _read(root, "settings.json")


def init_snapshot(elements: DataFrame, tiles: DataFrame, root: str, end_date: int, state: int = 0, **more) -> None:
    """Start a dataset of elements (columns of ``schema.ELEMENT``), clustered by the given tiles; null and -1 keys go to the root."""
    spark = elements.sparkSession
    keyed = elements.select(*COLUMNS).withColumn("quadtree", F.when(F.col("quadtree") >= 0, F.col("quadtree")).otherwise(F.lit(0)))
    parted = clustered(keyed, tiles).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "tile_qt", "type", "id")
    parted.write.mode("overwrite").partitionBy("part").parquet(files.join(root, "base"))
    base = spark.read.parquet(files.join(root, "base"))
    base.select("tile_qt", "part").distinct().repartition(1).sortWithinPartitions("tile_qt", "part").write.mode("overwrite").parquet(files.join(root, "tiles"))
    _write_index(base, files.join(root, "index/base"))
    _write(root, "settings.json", {"RoundTime": True, "InitialState": state, **more})
    count = spark.read.parquet(files.join(root, "tiles")).select("tile_qt").distinct().count()
    _write(root, "filelist.json", [{"Filename": "base", "EndDate": end_date, "NumTiles": count, "State": state}])


def _write_index(elements: DataFrame, path: str) -> None:
    """In ranges of ids, so that row groups without any wanted id are skipped."""
    overlay.id_index(elements, refs=False).repartitionByRange("type", "id", "tile_qt").sortWithinPartitions("type", "id").write.mode("overwrite").parquet(path)


def _numbers(root: str, as_of: int | None) -> list[int]:
    """Numbers of the deltas up to a date."""
    names = [f["Filename"] for f in file_list(root) if as_of is None or f["EndDate"] <= as_of]
    if not names or names[0] != "base":
        raise ValueError("the dataset has no state of that date")
    return [int(n.rpartition("=")[2]) for n in names[1:]]


def _deltas(spark: SparkSession, root: str, numbers: list[int], folder: str = "delta") -> DataFrame | None:
    """All deltas of the list as one table with ``file_idx``; of its folders only theirs are read."""
    if not numbers:
        return None
    return spark.read.parquet(files.join(root, folder)).where(F.col("file_idx").isin(numbers))


def _of_tiles(spark: SparkSession, root: str, tiles: DataFrame, numbers: list[int]) -> DataFrame:
    """State of some tiles of the base. Only the parts that hold them are opened: a list of numbers of folders, no longer than that of the folders."""
    parts = spark.read.parquet(files.join(root, "tiles")).join(tiles, "tile_qt", "left_semi")
    wanted = [r["part"] for r in parts.select("part").distinct().collect()]
    base = spark.read.parquet(files.join(root, "base")).where(F.col("part").isin(wanted)).drop("part").join(tiles, "tile_qt", "left_semi")
    deltas = _deltas(spark, root, numbers)
    if deltas is None:
        return base
    with_root = tiles.union(spark.range(1).toDF("tile_qt")).distinct()
    return overlay.overlay(base, deltas.join(with_root, "tile_qt", "left_semi"), root=True)


def read_snapshot(spark: SparkSession, root: str, *, box: Box | None = None, ring: list[tuple[int, int]] | None = None, as_of: int | None = None) -> DataFrame:
    """Elements with ``tile_qt`` as of a date. With a box, only of tiles that it touches; with a ring, of those that the ring does: the
    other tiles' files aren't opened.

    Raises if no tile is left.
    """
    numbers = _numbers(root, as_of)
    if box is None and ring is not None:
        xs, ys = zip(*ring)
        box = (min(xs), min(ys), max(xs), max(ys))
    if box is not None:
        tiles = spark.read.parquet(files.join(root, "tiles")).select("tile_qt").distinct().where(overlaps_tile("tile_qt", *box))
        if ring is not None:
            tiles = tiles.where(tile_meets_ring("tile_qt", ring))
        if tiles.isEmpty():
            raise ValueError("no tiles match the box")
        return _of_tiles(spark, root, tiles, numbers)
    base = spark.read.parquet(files.join(root, "base")).drop("part")
    deltas = _deltas(spark, root, numbers)
    return base if deltas is None else overlay.overlay(base, deltas, root=True)


def tile_count(spark: SparkSession, root: str, *, box: Box | None = None) -> int:
    """Number of tiles of the base, of a box if there is one."""
    tiles = spark.read.parquet(files.join(root, "tiles")).select("tile_qt").distinct()
    return (tiles if box is None else tiles.where(overlaps_tile("tile_qt", *box))).count()


def ids_of_area(spark: SparkSession, root: str, box: Box, ring: list[tuple[int, int]] | None = None, *, as_of: int | None = None) -> DataFrame:
    """(type, id) of what belongs to an area of the dataset; see ``extract.area_ids``."""
    rows = cut(read_snapshot(spark, root, box=box, ring=ring, as_of=as_of), "area")
    return area_ids(*(rows.where(F.col("type") == k) for k in range(3)), box, ring)


def tiles_to_read(root: str, newest: DataFrame) -> DataFrame:
    """Tiles that an update has to read: those that hold what new keys depend on, or relations with such members."""
    spark = newest.sparkSession
    index = spark.read.parquet(files.join(root, "index/base"))
    later = _deltas(spark, root, _numbers(root, None), "index/delta")
    if later is not None:
        index = index.unionByName(later.drop("file_idx"))
    return overlay.tiles_with(index, overlay.ids_to_look_up(newest))


def update_snapshot(changes: DataFrame, root: str, end_date: int, state: int | None = None, *, most_missing: int | None = None) -> dict:
    """Add a delta of changes (columns of ``schema.ELEMENT`` and ``file_idx``): new keys and tiles of what they change, and of what hangs on it.

    Of the dataset only the id index, and the tiles that it names for the changes, are read. Written under its own number, so a
    run that is repeated replaces its own delta. Where the settings say AllowMissingUsers false, a change without a user is an
    error. ``most_missing`` as in ``overlay.changed_keys``. Gives the entry of the file list.
    """
    spark = changes.sparkSession
    known = file_list(root)
    number = len(known)
    newest = cut(overlay.newest_changes(changes), "newest")
    if not settings(root).get("AllowMissingUsers", True) and not newest.where("changetype > 2 and info.user is null").isEmpty():
        raise ValueError("a change has no user")
    now = cut(_of_tiles(spark, root, cut(tiles_to_read(root, newest), "tiles"), _numbers(root, None)), "now")
    pick = lambda kind, *columns: now.where(F.col("type") == kind).select("id", "quadtree", *columns)
    keys = cut(overlay.changed_keys(pick(0, "lon", "lat"), pick(1, "refs"), pick(2, "members"), newest, most_missing=most_missing), "changed")
    # what has no key, as nodes without a place, belongs to the root
    keys = keys.withColumn("quadtree", F.when((F.col("changetype") > overlay.REMOVE) & (F.col("quadtree") < 0), F.lit(0)).otherwise(F.col("quadtree")).cast("bigint"))
    tiles = spark.read.parquet(files.join(root, "tiles")).select("tile_qt").distinct()
    placed = overlay.change_tiles(keys, now.select("type", "id", "tile_qt"), tiles)
    content = now.join(newest.select("type", "id"), ["type", "id"], "left_anti").select(*COLUMNS).unionByName(newest.select(*COLUMNS))
    rest = [c for c in COLUMNS if c not in ("changetype", "quadtree")]
    # a changed way may name nodes that are nowhere: these get no row
    rows = placed.join(content.select(*rest, F.lit(True).alias("_there")), ["type", "id"], "left").where(F.col("_there") | F.col("changetype").isin(overlay.DELETE, overlay.REMOVE)).select(*COLUMNS, "tile_qt")
    name = f"delta/file_idx={number}"
    rows.repartition("tile_qt").sortWithinPartitions("tile_qt", "type", "id").write.mode("overwrite").parquet(files.join(root, name))
    made = spark.read.parquet(files.join(root, name))
    _write_index(made, files.join(root, f"index/{name}"))
    count = made.select("tile_qt").distinct().count()
    entry = {"Filename": name, "EndDate": end_date, "NumTiles": count, "State": number if state is None else state}
    _write(root, "filelist.json", [*known, entry])
    return entry


def new_changes(root: str, folder: str, *, merge: bool = False, most_bytes: int = 100 * 1024 * 1024) -> list[list[tuple[str, int, int]]]:
    """Change files (path, sequence, time) of a folder that are newer than the dataset's state, in groups that make one delta each: every
    file alone, or with ``merge`` (or the setting MergeOscFiles) neighbours of ``most_bytes`` together at most.

    Files are named by their sequence number (``2619.osc.gz``), with a state file beside each (``2619.state.txt``).
    """
    state = file_list(root)[-1]["State"]
    merge = merge or bool(settings(root).get("MergeOscFiles"))
    found = []
    for path in files.listing(folder):
        name = path.rpartition("/")[2]
        number, _, rest = name.partition(".")
        if rest.startswith("osc") and number.isdigit() and int(number) > state:
            about = read_state(files.read_text(path[: -len(rest)] + "state.txt"))
            found.append((path, int(number), about["timestamp"], files.size_of(path)))
    groups: list[list[tuple[str, int, int]]] = []
    total = 0
    for path, number, at, size in sorted(found, key=lambda f: f[1]):
        if not merge or not groups or total + size > most_bytes:
            groups.append([])
            total = 0
        groups[-1].append((path, number, at))
        total += size
    return groups


def drop_last(root: str) -> dict:
    """Take the newest delta away again."""
    known = file_list(root)
    if len(known) < 2:
        raise ValueError("the dataset has no delta")
    last = known.pop()
    _write(root, "filelist.json", known)
    for folder in (last["Filename"], f"index/{last['Filename']}"):
        files.remove(files.join(root, folder))
    return last


def compact(spark: SparkSession, root: str, *, box: tuple[int, int, int, int] | None = None, ring: list[tuple[int, int]] | None = None, as_of: int | None = None, filter_objects: bool = True, sort: bool = True) -> DataFrame:
    """One state of a dataset without its history: of an area, what belongs to it, and members only as far as they do; by (type, id) or by tile."""
    rows = read_snapshot(spark, root, box=box, ring=ring, as_of=as_of)
    if (box or ring) and filter_objects:
        rows = cut(rows, "area")
        if box is None:
            xs, ys = zip(*ring)
            box = (min(xs), min(ys), max(xs), max(ys))
        ids = area_ids(rows.where("type = 0"), rows.where("type = 1"), rows.where("type = 2"), box, ring)
        kept = rows.join(ids, ["type", "id"], "left_semi")
        rows = kept.where("type <> 2").unionByName(filter_members(kept.where("type = 2"), ids).select(kept.columns))
    return rows.orderBy("type", "id") if sort else rows.repartitionByRange("tile_qt", "type", "id").sortWithinPartitions("tile_qt", "type", "id")
