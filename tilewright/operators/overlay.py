"""Overlaying change files on base rows, snapshots as of a date, and incremental keys and tiles.

Change types: 0 Normal, 1 Delete, 2 Remove, 3 Unchanged, 4 Modify, 5 Create; their order matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.quadtree import common, common_of, key_of_box, key_of_point
from tilewright.operators.keys import way_boxes, way_nodes
from tilewright.operators.tiling import assign_tiles

DELETE, REMOVE, UNCHANGED, MODIFY, CREATE = 1, 2, 3, 4, 5


def newest_changes(changes: DataFrame) -> DataFrame:
    """One row per (type, id): the highest version; of equal versions the row of the earliest file. A null version is below every other.

    Rows equal in both: the greatest change type, then the first by ``pos`` (place in the file) where there is such a
    column, then the greatest row; so the order in which rows are read decides nothing.
    """
    first = [-F.col("pos")] if "pos" in changes.columns else []
    rank = F.struct(F.coalesce("info.version", F.lit(-1)).alias("version"), (-F.coalesce("file_idx", F.lit(2**31 - 1))).alias("early"), F.col("changetype"), *[c.alias("first") for c in first], F.struct(*changes.columns).alias("row"))
    return changes.where("type is not null and id is not null").groupBy("type", "id").agg(F.max(rank).alias("r")).select("r.row.*")


def overlay(base: DataFrame, deltas: DataFrame, *, apply: bool = True, root: bool = False) -> DataFrame:
    """Base rows with the deltas of their tiles laid over: per (tile_qt, type, id) the row of the highest ``file_idx`` wins.

    Both: ``tile_qt, type, id, changetype`` and equal further columns; ``deltas`` also ``file_idx``. Tiles that the base
    lacks are not read, but for tile 0 with ``root``: elements go there that fit no other tile. With ``apply``, in tiles that have a delta, deleted and removed rows go and the others become
    Normal; tiles without one stay as they are. Of rows equal in file the greatest change type wins, then the greatest
    row.
    """
    columns = [c for c in base.columns if c in deltas.columns]
    tiles = base.select("tile_qt").distinct()
    if root:
        tiles = tiles.union(base.sparkSession.range(1))
    later = deltas.select(*columns, "file_idx").join(tiles, "tile_qt", "left_semi")
    touched = later.select("tile_qt").distinct().withColumn("touched", F.lit(True))
    rows = base.select(*columns, F.lit(-1).alias("file_idx")).unionByName(later)
    won = rows.groupBy("tile_qt", "type", "id").agg(F.max(F.struct("file_idx", F.struct(F.col("changetype").alias("rank"), F.struct(*columns).alias("row")).alias("of"))).alias("r")).select("r.of.row.*")
    if not apply:
        return won
    marked = won.join(touched, "tile_qt", "left")
    kept = marked.where(F.col("touched").isNull() | ~F.coalesce(F.col("changetype").isin(DELETE, REMOVE), F.lit(False)))
    return kept.withColumn("changetype", F.when(F.col("touched"), F.lit(0)).otherwise(F.col("changetype"))).drop("touched").select(*columns)


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base rows without those that any change names, and the newest change of each that is a Modify or Create, as Normal."""
    newest = newest_changes(changes)
    columns = [c for c in base.columns if c in changes.columns]
    kept = base.select(*columns).join(newest.select("type", "id"), ["type", "id"], "left_anti")
    added = newest.where(F.col("changetype") >= MODIFY).withColumn("changetype", F.lit(0)).select(*columns)
    return kept.unionByName(added)


def files_as_of(manifest: DataFrame, end_date: int | None) -> DataFrame:
    """Files whose end date isn't after the given one; null dates are before all. None takes every file."""
    return manifest if end_date is None else manifest.where(F.col("end_date").isNull() | (F.col("end_date") <= end_date))


def originals(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The newest stored row of each changed (type, id): by file index, Remove rows aside; none if that row is a Delete."""
    wanted = files.where("coalesce(changetype, 0) <> 2").join(changed.select("type", "id").distinct(), ["type", "id"], "left_semi")
    newest = wanted.groupBy("type", "id").agg(F.max(F.struct("file_idx", "changetype", F.struct(*files.columns).alias("row"))).alias("r")).select("r.row.*")
    return newest.where("coalesce(changetype, 0) <> 1")


def id_index(elements: DataFrame, *, refs: bool = True) -> DataFrame:
    """(tile_qt, type, id): which tile holds which ids, references of ways (if ``refs``) and members of relations included where those
    columns exist."""
    parts = [elements.select("tile_qt", "type", "id")]
    if refs and "refs" in elements.columns:
        parts.append(elements.select("tile_qt", F.lit(0).alias("type"), F.explode("refs").alias("id")))
    if "members" in elements.columns:
        parts.append(elements.select("tile_qt", F.explode("members").alias("m")).select("tile_qt", F.col("m.type").alias("type"), F.col("m.ref").alias("id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("type is not null and id is not null").distinct()


def tiles_with(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct tiles that hold any of the (type, id)."""
    return index.join(ids.select("type", "id").distinct(), ["type", "id"], "left_semi").select("tile_qt").distinct()


def ids_to_look_up(changes: DataFrame) -> DataFrame:
    """(type, id) of all that new keys of changes depend on: what changed, and the nodes of changed ways."""
    nodes = changes.where("type = 1 and changetype > 2").select(F.lit(0).alias("type"), F.explode("refs").alias("id")).where("id is not null")
    return changes.select("type", "id").union(nodes).distinct()


def changed_keys(nodes: DataFrame, ways: DataFrame, relations: DataFrame, changes: DataFrame, *, most_missing: int | None = None) -> DataFrame:
    """(type, id, quadtree, changetype) after changes, from the keys that the elements have.

    With ``most_missing``, more references of changed ways to nodes that are nowhere than that are an error.

    ``nodes``, ``ways``, ``relations``: current live rows with ``quadtree``; ``changes``: one row per (type, id). Changed ways are
    keyed anew over all their nodes; their nodes, and changed nodes, only ever get coarser keys, and so do relations with a
    changed member. Ways whose nodes moved, but that did not change themselves, keep their key. Elements that did not
    change but whose key did are Unchanged rows. Deleted ones have the key they had.
    """
    alive = changes.where(F.col("changetype") > REMOVE)
    new_nodes = alive.where("type = 0").select("id", "lon", "lat")
    places = nodes.select("id", "lon", "lat").join(new_nodes.select("id"), "id", "left_anti").unionByName(new_nodes)
    new_ways = alive.where("type = 1").select("id", "refs")
    boxes = way_boxes(new_ways, places)
    if most_missing is not None:
        lost = boxes.agg(F.sum("missing")).first()[0] or 0
        if lost > most_missing:
            raise ValueError(f"{lost} nodes of changed ways are missing")
    way_qts = boxes.select("id", key_of_box("minx", "miny", "maxx", "maxy").alias("quadtree"))
    through = way_nodes(new_ways).join(way_qts.withColumnRenamed("id", "way_id"), "way_id").groupBy(F.col("node_id").alias("id")).agg(common_of("quadtree").alias("by_way"))
    stored = nodes.select("id", F.col("quadtree").alias("old"))
    own = new_nodes.select("id", key_of_point("lon", "lat").alias("by_place"))
    node_qts = through.join(own, "id", "full_outer").join(stored, "id", "left").select("id", "old", common(F.coalesce("old", F.lit(-1)), F.coalesce("by_way", "by_place", F.lit(-1))).alias("quadtree"))
    members = relations.select("id", "members").join(alive.where("type = 2").select("id"), "id", "left_anti").unionByName(alive.where("type = 2").select("id", "members"))
    moved = node_qts.where("old is null or quadtree <> old").select(F.lit(0).alias("kind"), F.col("id").alias("ref"), "quadtree").unionByName(way_qts.select(F.lit(1).alias("kind"), F.col("id").alias("ref"), "quadtree"))
    of_members = members.select("id", F.explode("members").alias("m")).select("id", F.col("m.type").alias("kind"), F.col("m.ref").alias("ref")).join(moved, ["kind", "ref"]).groupBy("id").agg(common_of("quadtree").alias("by_member"))
    relation_qts = of_members.join(relations.select("id", F.col("quadtree").alias("old")), "id", "left").select("id", "old", common(F.coalesce("old", F.lit(-1)), "by_member").alias("quadtree"))
    rows = node_qts.select(F.lit(0).alias("type"), "id", "old", "quadtree")
    rows = rows.unionByName(way_qts.join(ways.select("id", F.col("quadtree").alias("old")), "id", "left").select(F.lit(1).alias("type"), "id", "old", "quadtree"))
    rows = rows.unionByName(relation_qts.select(F.lit(2).alias("type"), "id", "old", "quadtree"))
    named = changes.select("type", "id", "changetype", F.col("quadtree").alias("named"))
    both = rows.join(named, ["type", "id"], "full_outer")
    result = both.select("type", "id", F.coalesce("quadtree", "named", F.lit(-1)).alias("quadtree"), F.coalesce("changetype", F.lit(UNCHANGED)).alias("changetype"), "old")
    return result.where(F.col("changetype").isin(DELETE, MODIFY, CREATE) | F.col("old").isNull() | (F.col("quadtree") != F.col("old"))).drop("old")


def change_tiles(changed: DataFrame, stored: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile_qt, type, id, changetype, quadtree) of a new delta.

    ``changed``: ``type, id, changetype, quadtree``; ``stored``: (type, id, tile_qt) of the elements as they are. A live row goes to its
    key's tile; if that isn't its old one, a Remove row with key 0 goes to the old. A Delete goes to the old tile, and nowhere
    if there is none.
    """
    placed = assign_tiles(changed, tiles).join(stored.select("type", "id", F.col("tile_qt").alias("old_tile")), ["type", "id"], "left")
    live = placed.where(F.col("changetype") > REMOVE)
    here = live.select("tile_qt", "type", "id", "changetype", "quadtree")
    gone = live.where("old_tile is not null and old_tile <> tile_qt").select(F.col("old_tile").alias("tile_qt"), "type", "id", F.lit(REMOVE).alias("changetype"), F.lit(0).cast("bigint").alias("quadtree"))
    dead = placed.where((F.col("changetype") == DELETE) & F.col("old_tile").isNotNull()).select(F.col("old_tile").alias("tile_qt"), "type", "id", "changetype", "quadtree")
    return here.unionByName(gone).unionByName(dead)
