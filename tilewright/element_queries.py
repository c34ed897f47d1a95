"""Queries of the element operators over the element tables; each takes a session and a data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import quadtree as Q
from tilewright.functions import tags as T
from tilewright.functions.geo import box_contains, boxes_touch, line_length, meets_ring, mercator, mercator_box, ring_area, ring_centroid, wkb
from tilewright.functions.style import DROP_KEYS, FEATURE_KEYS, MIN_ZOOM, PARENT_TAGS, POLYGON_TAGS, RELATION_TAGS, Style
from tilewright.functions.text import date_text, long_key, packed_tags, short_key, unpacked_tags
from tilewright.operators import diff, extract, geometry, keys, overlay, stats, tiling
from tilewright.operators.current import current_rows
from tilewright.operators.multipolygon import build_multipolygons
from tilewright.plans.lineage import shared_dir
from tilewright.schema import MEMBERS
from tilewright.sources import snapshot
from tilewright.streaming.updates import keep_newest

#: Area of the extract queries, degrees x 1e7, and a ring inside it.
BOX = (115_000_000, 431_000_000, 121_000_000, 435_000_000)
RING = [(115_500_000, 431_500_000), (120_500_000, 431_800_000), (119_000_000, 434_600_000), (116_000_000, 434_200_000)]
#: Tiles may not be found for the level of a histogram that is deeper than this.
LEVEL = 8
#: Level of the histogram that groups and folded tiles are made from, so that dense areas are divided.
DEEPEST = 17
#: A date inside the span of the tile files' end dates.
AS_OF = 1_705_000_000
MONTH = 26

Spark = SparkSession
KINDS = {0: "osm_nodes", 1: "osm_ways", 2: "osm_relations"}


def table(spark: Spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _live(spark: Spark, folder: str, kind: int, columns: list[str]) -> DataFrame:
    return current_rows(table(spark, folder, KINDS[kind]), columns).where("live")


def _nodes(spark: Spark, folder: str, *more: str) -> DataFrame:
    """Live nodes at valid places."""
    return _live(spark, folder, 0, ["lon", "lat", *more]).where("abs(lon) <= 1800000000 and abs(lat) <= 900000000")


def _ways(spark: Spark, folder: str, *more: str) -> DataFrame:
    return _live(spark, folder, 1, ["refs", *more])


def _relations(spark: Spark, folder: str, *more: str) -> DataFrame:
    return _live(spark, folder, 2, ["members", *more])


def _all(spark: Spark, folder: str, *columns: str) -> DataFrame:
    """Rows of all three tables as stored."""
    parts = [table(spark, folder, name).select(F.lit(kind).alias("type"), "id", "changetype", *columns) for kind, name in KINDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _elements(spark: Spark, folder: str, *columns: str) -> DataFrame:
    """Live current elements of all kinds."""
    parts = [_live(spark, folder, kind, list(columns)).select(F.lit(kind).alias("type"), "id", *columns) for kind in KINDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _text(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(t["key"], F.lit("="), F.coalesce(t["val"], F.lit("")))), ";")


def count_by_type_changetype(spark: Spark, folder: str) -> DataFrame:
    return stats.count_elements(_all(spark, folder, "info"))


def node_bounds(spark: Spark, folder: str) -> DataFrame:
    return stats.count_nodes(table(spark, folder, "osm_nodes"))


def way_ref_stats(spark: Spark, folder: str) -> DataFrame:
    return stats.count_ways(table(spark, folder, "osm_ways"))


def relation_member_stats(spark: Spark, folder: str) -> DataFrame:
    return stats.count_relations(table(spark, folder, "osm_relations"))


def tile_summary(spark: Spark, folder: str) -> DataFrame:
    return stats.tile_summary(_all(spark, folder, "quadtree"))


def qt_point(spark: Spark, folder: str) -> DataFrame:
    return _nodes(spark, folder).select("id", Q.key_of_point("lon", "lat").alias("quadtree"))


def _keys(spark: Spark, folder: str) -> DataFrame:
    return _elements(spark, folder, "quadtree").where("quadtree is not null")


def qt_round(spark: Spark, folder: str) -> DataFrame:
    return _keys(spark, folder).select("type", "id", Q.tile_round("quadtree", 6).alias("at_6"), Q.tile_round("quadtree", 0).alias("at_0"))


def qt_common(spark: Spark, folder: str) -> DataFrame:
    other = F.lit(1998375577622413322)
    return _keys(spark, folder).select("type", "id", Q.common("quadtree", other).alias("shared"))


def qt_common_by_user(spark: Spark, folder: str) -> DataFrame:
    """The deepest tile around everything that a user touched last."""
    return _elements(spark, folder, "quadtree", "info").groupBy(F.col("info.user_id").alias("user_id")).agg(Q.common_of("quadtree").alias("shared"))


def qt_text(spark: Spark, folder: str) -> DataFrame:
    return _keys(spark, folder).select("type", "id", Q.as_text("quadtree").alias("letters"), (Q.from_text(Q.as_text("quadtree")) == F.col("quadtree")).alias("back"))


def qt_xyz(spark: Spark, folder: str) -> DataFrame:
    at = Q.tile_xyz("quadtree")
    return _keys(spark, folder).where("quadtree >= 0").select("type", "id", at["x"].alias("x"), at["y"].alias("y"), at["z"].alias("z"), (Q.from_xyz(at["x"], at["y"], at["z"]) == F.col("quadtree")).alias("back"))


def qt_tile_bbox(spark: Spark, folder: str) -> DataFrame:
    """Boxes of the tiles, in whole thousandths of degrees."""
    b = Q.tile_bbox("tile_qt")
    return table(spark, folder, "tiles").select("tile_qt").distinct().where("tile_qt >= 0").select("tile_qt", *[F.round(b[c] / 10000.0).cast("bigint").alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def qt_histogram(spark: Spark, folder: str) -> DataFrame:
    return tiling.key_histogram(table(spark, folder, "qt_items").withColumnRenamed("qt", "quadtree"), LEVEL, "weight").where("n is not null")


def _deep_histogram(spark: Spark, folder: str) -> DataFrame:
    return tiling.key_histogram(table(spark, folder, "qt_items").withColumnRenamed("qt", "quadtree"), DEEPEST, "weight").where("n is not null")


def qt_rollup(spark: Spark, folder: str) -> DataFrame:
    return tiling.subtree_totals(qt_histogram(spark, folder))


def qt_fold_small(spark: Spark, folder: str) -> DataFrame:
    """Histogram with tiles below 200 folded into their parents."""
    return tiling.rolled_up(_deep_histogram(spark, folder), 200, DEEPEST)


def group_tiles(spark: Spark, folder: str) -> DataFrame:
    return tiling.grouped_tiles(_deep_histogram(spark, folder), 2000, 500)


def tiles_of_box(spark: Spark, folder: str) -> DataFrame:
    """Tiles that a scan of the box has to read, by file and as of a date."""
    files = overlay.files_as_of(table(spark, folder, "tiles"), AS_OF)
    return files.where(Q.overlaps_tile("tile_qt", *BOX)).select("tile_qt", "file_idx").distinct()


def way_bbox(spark: Spark, folder: str) -> DataFrame:
    return keys.way_boxes(_ways(spark, folder), _nodes(spark, folder))


def way_quadtree(spark: Spark, folder: str) -> DataFrame:
    return keys.way_keys(_ways(spark, folder), _nodes(spark, folder))


def node_quadtree(spark: Spark, folder: str) -> DataFrame:
    nodes, ways = _nodes(spark, folder), _ways(spark, folder)
    return keys.node_keys(nodes, ways, keys.way_keys(ways, nodes))


def relation_quadtree(spark: Spark, folder: str) -> DataFrame:
    nodes, ways = _nodes(spark, folder), _ways(spark, folder)
    by_way = keys.way_keys(ways, nodes)
    return keys.relation_keys(_relations(spark, folder), keys.node_keys(nodes, ways, by_way), by_way)


def assign_tile(spark: Spark, folder: str) -> DataFrame:
    return tiling.assign_tiles(_keys(spark, folder), table(spark, folder, "tiles")).select("type", "id", "tile_qt")


def cluster_counts(spark: Spark, folder: str) -> DataFrame:
    """Elements per tile, counted over the clustered rows."""
    return tiling.clustered(_keys(spark, folder), table(spark, folder, "tiles")).groupBy("tile_qt").agg(F.count(F.lit(1)).alias("n"))


def block_8000(spark: Spark, folder: str) -> DataFrame:
    return tiling.numbered_blocks(_elements(spark, folder)).groupBy("type", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def split_id_key(spark: Spark, folder: str) -> DataFrame:
    return _elements(spark, folder).select("type", "id", tiling.split_key(F.col("type"), F.col("id"), 1000, 200, 12).alias("part"))


def filter_tags(spark: Spark, folder: str) -> DataFrame:
    tags = F.col("tags")
    kept = T.filter_tags(tags, FEATURE_KEYS, None, DROP_KEYS)
    return _elements(spark, folder, "tags").select("type", "id", _text(kept).alias("kept"), T.is_feature(tags, FEATURE_KEYS).alias("feature"), T.layer(tags).alias("layer"))


def polygon_tags(spark: Spark, folder: str) -> DataFrame:
    return _elements(spark, folder, "tags").select("type", "id", T.is_polygon(F.col("tags"), POLYGON_TAGS).alias("polygon"))


def zorder(spark: Spark, folder: str) -> DataFrame:
    return _elements(spark, folder, "tags").select("type", "id", T.z_order(F.col("tags")).alias("zorder"))


def minzoom_tag(spark: Spark, folder: str) -> DataFrame:
    """Least zoom of the tags: of nodes as points, of ways and relations as lines or polygons."""
    table_ = tuple(MIN_ZOOM)
    zoom = F.when(F.col("type") == 0, T.tag_zoom(F.col("tags"), [0], table_)).otherwise(T.tag_zoom(F.col("tags"), [1, 2], table_))
    return _elements(spark, folder, "tags").select("type", "id", zoom.alias("zoom"), F.when(F.col("type") == 0, T.shows_by(F.col("tags"), [0], table_, 14)).otherwise(T.shows_by(F.col("tags"), [1, 2], table_, 12)).alias("shows"))


def tags_json(spark: Spark, folder: str) -> DataFrame:
    return _elements(spark, folder, "tags").where("tags is not null").select("type", "id", T.as_json(F.col("tags")).alias("json"))


def tags_hstore(spark: Spark, folder: str) -> DataFrame:
    return _elements(spark, folder, "tags").where("tags is not null").select("type", "id", T.as_hstore(F.col("tags")).alias("hstore"))


def tags_fixed(spark: Spark, folder: str) -> DataFrame:
    """Sorted tags without delete characters."""
    return _elements(spark, folder, "tags").select("type", "id", _text(T.fix_tags(F.filter("tags", lambda t: t["key"].isNotNull() & t["val"].isNotNull()))).alias("fixed"), T.has_delete_character(F.col("tags")).alias("odd"))


def parent_tags(spark: Spark, folder: str) -> DataFrame:
    return geometry.parent_tags(_nodes(spark, folder, "tags"), _ways(spark, folder, "tags"), PARENT_TAGS)


def relation_tags(spark: Spark, folder: str) -> DataFrame:
    return geometry.relation_tags(_relations(spark, folder, "tags"), RELATION_TAGS)


def mercator_forward(spark: Spark, folder: str) -> DataFrame:
    at = mercator(F.col("lon"), F.col("lat"))
    return _nodes(spark, folder).select("id", F.round(at["x"], 2).alias("x"), F.round(at["y"], 2).alias("y"))


def _placed(spark: Spark, folder: str, *more: str) -> DataFrame:
    return geometry.ways_with_nodes(_ways(spark, folder, *more), _nodes(spark, folder))


def line_lengths(spark: Spark, folder: str) -> DataFrame:
    return _placed(spark, folder).select("id", "missing", F.size("lonlats").cast("bigint").alias("points"), F.round(line_length(F.col("lonlats")), 1).alias("length"))


def ring_areas(spark: Spark, folder: str) -> DataFrame:
    """Areas of closed ways, in whole hectares."""
    closed = _placed(spark, folder).where("size(refs) > 3 and refs[0] = element_at(refs, -1) and missing = 0")
    middle = ring_centroid(F.col("lonlats"))
    return closed.select("id", F.round(ring_area(F.col("lonlats")) / 1e4, 0).cast("bigint").alias("hectares"), (F.abs(middle["lat"]) <= 900000000).alias("placed"))


def bbox_extract(spark: Spark, folder: str) -> DataFrame:
    return extract.area_ids(_nodes(spark, folder), _ways(spark, folder), _relations(spark, folder), BOX)


def poly_extract(spark: Spark, folder: str) -> DataFrame:
    return extract.area_ids(_nodes(spark, folder), _ways(spark, folder), _relations(spark, folder), BOX, RING)


def filter_members(spark: Spark, folder: str) -> DataFrame:
    kept = extract.filter_members(_relations(spark, folder), bbox_extract(spark, folder))
    return kept.select("id", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["type"].cast("string"), m["ref"].cast("string"))), ",").alias("members"))


def idset_invert(spark: Spark, folder: str) -> DataFrame:
    """Elements of all kinds that no way or relation refers to."""
    ways, relations = _ways(spark, folder), _relations(spark, folder)
    named = extract.named_ids(ways.limit(0), ways.withColumn("id", F.lit(None).cast("bigint")), relations.withColumn("id", F.lit(None).cast("bigint")))
    return extract.outside(_elements(spark, folder, "quadtree").select("type", "id"), named)


def dedupe_version(spark: Spark, folder: str) -> DataFrame:
    return overlay.newest_changes(table(spark, folder, "osm_changes")).select("type", "id", F.col("info.version").alias("version"), "file_idx", "changetype")


def _stored(spark: Spark, folder: str) -> DataFrame:
    return tiling.assign_tiles(_elements(spark, folder, "quadtree", "info"), table(spark, folder, "tiles")).where("tile_qt is not null").select("tile_qt", "type", "id", F.lit(0).alias("changetype"), F.col("info.version").alias("version"))


def _deltas(spark: Spark, folder: str) -> DataFrame:
    changes = table(spark, folder, "osm_changes").where("id is not null")
    return tiling.assign_tiles(changes, table(spark, folder, "tiles")).where("tile_qt is not null").select("tile_qt", "type", "id", "changetype", F.col("info.version").alias("version"), "file_idx")


def overlay_merge(spark: Spark, folder: str) -> DataFrame:
    return overlay.overlay(_stored(spark, folder), _deltas(spark, folder), apply=False)


def overlay_apply(spark: Spark, folder: str) -> DataFrame:
    return overlay.overlay(_stored(spark, folder), _deltas(spark, folder))


def snapshot_asof(spark: Spark, folder: str) -> DataFrame:
    """Base rows with the change files up to one laid over."""
    return overlay.overlay(_stored(spark, folder), _deltas(spark, folder).where(f"file_idx <= {MONTH}"))


def apply_change(spark: Spark, folder: str) -> DataFrame:
    base = _elements(spark, folder, "info").withColumn("changetype", F.lit(0))
    return overlay.apply_changes(base, table(spark, folder, "osm_changes")).select("type", "id", "changetype", F.col("info.version").alias("version"))


def original_rows(spark: Spark, folder: str) -> DataFrame:
    """Newest stored rows of what the later half of the change files names."""
    files = _all(spark, folder, "info").withColumn("file_idx", F.lit(0)).unionByName(table(spark, folder, "osm_changes").where("file_idx <= 30").select("type", "id", "changetype", "info", "file_idx"))
    later = table(spark, folder, "osm_changes").where("file_idx > 30")
    plain = files.select("type", "id", "changetype", F.coalesce("info.version", F.lit(-1)).alias("version"), "file_idx")
    latest = plain.groupBy("type", "id", "file_idx").agg(F.max_by(F.struct("changetype", "version"), F.struct("version", "changetype")).alias("r")).select("type", "id", "r.changetype", "r.version", "file_idx")
    return overlay.originals(latest, later).select("type", "id", "version", "file_idx")


def index_lookup(spark: Spark, folder: str) -> DataFrame:
    """Tiles that hold anything that the change files name, itself or by reference."""
    nodes, ways, relations = (t(spark, folder, "quadtree") for t in (_nodes, _ways, _relations))
    parts = [t.select(F.lit(k).alias("type"), "id", "quadtree", *[(F.col(c) if c in t.columns else F.lit(None).cast(kind)).alias(c) for c, kind in (("refs", "array<bigint>"), ("members", MEMBERS))]) for k, t in enumerate((nodes, ways, relations))]
    stored = tiling.assign_tiles(parts[0].unionByName(parts[1]).unionByName(parts[2]), table(spark, folder, "tiles")).where("tile_qt is not null")
    return overlay.tiles_with(overlay.id_index(stored), table(spark, folder, "osm_changes"))


def change_tiles(spark: Spark, folder: str) -> DataFrame:
    changed = overlay.newest_changes(table(spark, folder, "osm_changes")).select("type", "id", "changetype", "quadtree")
    return overlay.change_tiles(changed, _stored(spark, folder), table(spark, folder, "tiles"))


def change_keys(spark: Spark, folder: str) -> DataFrame:
    return overlay.changed_keys(_nodes(spark, folder, "quadtree"), _ways(spark, folder, "quadtree"), _relations(spark, folder, "quadtree"), overlay.newest_changes(table(spark, folder, "osm_changes")))


def dataset_diff(spark: Spark, folder: str) -> DataFrame:
    base = _elements(spark, folder, "info", "tags").withColumn("changetype", F.lit(0))
    return diff.difference_counts(base, overlay.apply_changes(base, table(spark, folder, "osm_changes")))


def renamed_users(spark: Spark, folder: str) -> DataFrame:
    base = _elements(spark, folder, "info")
    return diff.renamed_users(base, overlay.newest_changes(table(spark, folder, "osm_changes")).select("type", "id", "info"))


def _shapes(spark: Spark, folder: str) -> DataFrame:
    return geometry.process_geometry(_nodes(spark, folder, "tags"), _ways(spark, folder, "tags"), _relations(spark, folder, "tags"))


def geometries(spark: Spark, folder: str) -> DataFrame:
    return _shapes(spark, folder).select("type", "id", "quadtree", "layer", "zorder", "minzoom", F.round("length", 1).alias("length"), F.round("area", 0).alias("area"), "reversed", F.size("tags").alias("n_tags"))


def plain_shapes(spark: Spark, folder: str) -> DataFrame:
    """Points, lines and polygons of nodes and ways by their own tags, with keys and zooms."""
    style = Style(parent_tags=(), relation_tags=(), multipolygons=False, boundaries=False)
    made = geometry.process_geometry(_nodes(spark, folder, "tags"), _ways(spark, folder, "tags"), _relations(spark, folder, "tags"), style)
    return made.select("type", "id", "quadtree", "layer", "zorder", "minzoom", F.round("length", 1).alias("length"), F.round(F.col("area") / 1e4, 0).alias("hectares"), _text(F.col("tags")).alias("kept"))


def plain_shapes_to_zoom(spark: Spark, folder: str) -> DataFrame:
    """Points and lines that show by zoom 13, with keys cut to their zoom."""
    style = Style(parent_tags=(), relation_tags=(), multipolygons=False, boundaries=False, polygon_tags={})
    made = geometry.process_geometry(_nodes(spark, folder, "tags"), _ways(spark, folder, "tags"), _relations(spark, folder, "tags"), style, max_zoom=13)
    return made.select("type", "id", "minzoom", "zorder")


def geometries_to_zoom(spark: Spark, folder: str) -> DataFrame:
    nodes, ways, relations = _nodes(spark, folder, "tags"), _ways(spark, folder, "tags"), _relations(spark, folder, "tags")
    return geometry.process_geometry(nodes, ways, relations, max_zoom=14).select("type", "id", "quadtree", "minzoom")


def multipolygons(spark: Spark, folder: str) -> DataFrame:
    made = build_multipolygons(_relations(spark, folder, "tags"), _placed(spark, folder), Style())
    return made.select("id", F.coalesce(F.size("rings"), F.lit(0)).alias("polygons"), F.round("area", 0).alias("area"), "error")


def geometry_wkb(spark: Spark, folder: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("point"), F.lit("line"), F.lit("polygon"), F.lit("multipolygon")), F.col("type") - 2)
    return _shapes(spark, folder).select("type", "id", wkb(kind, F.col("lonlats"), F.col("rings"), 4326, backwards=F.col("reversed")).alias("wkb"))


def geojson(spark: Spark, folder: str) -> DataFrame:
    return geometry.as_geojson(_shapes(spark, folder))


def dataset_update(spark: Spark, folder: str) -> DataFrame:
    """Elements of a dataset that was started from the base tables and then updated by all change files."""
    root = f"{shared_dir(spark)}/tilewright/dataset-{uuid.uuid4().hex}"
    base = _nodes(spark, folder, "quadtree", "info", "tags").select(F.lit(0).alias("type"), "*")
    for kind, part in ((1, _ways(spark, folder, "quadtree", "info", "tags")), (2, _relations(spark, folder, "quadtree", "info", "tags"))):
        base = base.unionByName(part.select(F.lit(kind).alias("type"), "*"), allowMissingColumns=True)
    snapshot.init_snapshot(base.withColumn("changetype", F.lit(0)), table(spark, folder, "tiles"), root, 1)
    changes = table(spark, folder, "osm_changes").where("changetype in (1, 4, 5) and id is not null")
    snapshot.update_snapshot(changes, root, 2)
    return snapshot.read_snapshot(spark, root).select("type", "id", "changetype", F.col("info.version").alias("version"))


def tiles_of_ring(spark: Spark, folder: str) -> DataFrame:
    """How tiles and the ring meet: 0 not by their extents, 1 tile around ring, 2 tile's centre inside, 3 edges cross, 4 not at all."""
    tiles = table(spark, folder, "tiles").select("tile_qt").distinct().where("tile_qt >= 0")
    return tiles.select("tile_qt", meets_ring(Q.tile_bbox("tile_qt", 0.05), RING).cast("int").alias("code"))


def way_node_pairs(spark: Spark, folder: str) -> DataFrame:
    return keys.way_nodes(_ways(spark, folder))


def box_tests(spark: Spark, folder: str) -> DataFrame:
    """Which ways' boxes touch the area, and which lie in it."""
    boxes = keys.way_boxes(_ways(spark, folder), _nodes(spark, folder)).where("found > 0").select("id", F.struct("minx", "miny", "maxx", "maxy").alias("b"))
    return boxes.select("id", boxes_touch(F.col("b"), BOX).alias("touches"), box_contains(BOX, F.col("b")).alias("inside"))


def tag_edits(spark: Spark, folder: str) -> DataFrame:
    """Tags without ``note``, with ``checked`` set, and the first and last ``name``."""
    tags = F.col("tags")
    edited = T.set_tag(T.remove_tag(tags, "note"), "checked", T.find_tag(tags, "highway"))
    return _elements(spark, folder, "tags").select("type", "id", _text(edited).alias("edited"), T.find_tag(tags, "name").alias("first_name"), T.last_tag(tags, "name").alias("last_name"), T.has_tag(tags, "highway", "residential").alias("residential"))


def tags_packed(spark: Spark, folder: str) -> DataFrame:
    """Tags packed into bytes and unpacked again; nulls come back as empty texts."""
    packed = packed_tags(F.col("tags"))
    return _elements(spark, folder, "tags").where("tags is not null").select("type", "id", F.length(packed).alias("bytes"), _text(unpacked_tags(packed)).alias("tags"))


def members_fixed(spark: Spark, folder: str) -> DataFrame:
    """Members' roles without delete characters."""
    roles = F.array_join(F.transform(T.fix_members(F.col("members")), lambda m: F.coalesce(m["role"], F.lit("-"))), ";")
    return _relations(spark, folder).select("id", roles.alias("roles"), T.roles_have_delete_character(F.col("members")).alias("odd"))


def dates(spark: Spark, folder: str) -> DataFrame:
    return _elements(spark, folder, "info").select("type", "id", date_text(F.col("info.timestamp")).alias("at"))


def short_keys(spark: Spark, folder: str) -> DataFrame:
    """Keys in 48 bits and back."""
    return _keys(spark, folder).select("type", "id", short_key(F.col("quadtree")).alias("short"), long_key(short_key(F.col("quadtree"))).alias("long"))


def keys_of_elements(spark: Spark, folder: str) -> DataFrame:
    """Elements with the keys of three stores that must not overlap, and must have a key for each."""
    stores = [_elements(spark, folder, "quadtree").where(F.col("type") == k).select("type", "id", F.coalesce("quadtree", F.lit(-1)).alias("quadtree")) for k in range(3)]
    return tiling.with_keys(_elements(spark, folder, "info"), tiling.joined_keys(stores)).select("type", "id", "quadtree")


def id_positions(spark: Spark, folder: str) -> DataFrame:
    """Place of each element in the order of (type, id); one that came twice would be an error."""
    return tiling.numbered_blocks(_elements(spark, folder), 1, strict=True).select("type", "id", F.col("block").alias("place"))


def mercator_boxes(spark: Spark, folder: str) -> DataFrame:
    """Boxes of ways in metres."""
    boxes = keys.way_boxes(_ways(spark, folder), _nodes(spark, folder)).where("found > 0")
    b = mercator_box(F.struct("minx", "miny", "maxx", "maxy"))
    return boxes.select("id", *[F.round(b[c], 1).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def stream_update(spark: Spark, folder: str) -> DataFrame:
    """Newest change of each element, from the change files as a stream."""
    schema = table(spark, folder, "osm_changes").schema
    return keep_newest(spark, f"{folder}/osm_changes.parque[t]", schema, ["type", "id", "info", "file_idx", "changetype"]).select("type", "id", F.col("info.version").alias("version"), "file_idx", "changetype")


QUERIES = {
    f.__name__: f
    for f in (
        count_by_type_changetype, node_bounds, way_ref_stats, relation_member_stats, tile_summary, qt_point, qt_round, qt_common, qt_common_by_user, qt_text, qt_xyz, qt_tile_bbox,
        qt_histogram, qt_rollup, qt_fold_small, group_tiles, tiles_of_box, way_bbox, way_quadtree, node_quadtree, relation_quadtree, assign_tile, cluster_counts, block_8000, split_id_key,
        filter_tags, polygon_tags, zorder, minzoom_tag, tags_json, tags_hstore, tags_fixed, parent_tags, relation_tags, mercator_forward, line_lengths, ring_areas, bbox_extract, poly_extract,
        filter_members, idset_invert, dedupe_version, overlay_merge, overlay_apply, snapshot_asof, apply_change, original_rows, index_lookup, change_tiles, change_keys, dataset_diff,
        renamed_users, geometries, plain_shapes, plain_shapes_to_zoom, geometries_to_zoom, multipolygons, geometry_wkb, geojson, stream_update, dataset_update, tiles_of_ring, way_node_pairs, box_tests,
        tag_edits, tags_packed, members_fixed, dates, short_keys, keys_of_elements, id_positions, mercator_boxes,
    )
}
