"""Geometries of elements: points, lines and polygons with tags, lengths, areas, drawing order and zoom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import tags as T
from tilewright.functions.geo import area_zoom, boxes_touch, in_box, length_zoom, line_length, ring_area
from tilewright.functions.quadtree import key_of_box, tile_round, tile_xyz
from tilewright.functions.style import ParentTag, RelationTag, Style
from tilewright.operators.multipolygon import build_multipolygons

POINT, LINE, POLYGON, MULTIPOLYGON = 3, 4, 5, 6


def ways_with_nodes(ways: DataFrame, nodes: DataFrame, *, strict: bool = False) -> DataFrame:
    """Ways with ``lonlats``, the places of their nodes in order, and ``missing``, how many references have none.

    ``strict`` raises for a way with a missing node; else such references are left out.
    """
    refs = ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))
    places = nodes.where("lon is not null and lat is not null").select(F.col("id").alias("node_id"), "lon", "lat")
    met = refs.join(places, "node_id", "left")
    lists = met.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.col("lon").isNotNull(), F.struct("pos", "lon", "lat")))).alias("at"), F.count_if(F.col("lon").isNull()).alias("missing"))
    none = F.array().cast("array<struct<lon:bigint,lat:bigint>>")
    out = ways.join(lists, "id", "left").withColumn("lonlats", F.coalesce(F.transform("at", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))), none)).withColumn("missing", F.coalesce("missing", F.lit(0))).drop("at")
    if strict:
        out = out.withColumn("lonlats", F.when(F.col("missing") == 0, F.col("lonlats")).otherwise(F.raise_error(F.concat(F.lit("nodes missing in way "), F.col("id").cast("string")))))
    return out


def box_of(lonlats: Column) -> Column:
    side = lambda f, c: f(F.transform(lonlats, lambda p: p[c]))
    return F.struct(side(F.array_min, "lon").alias("minx"), side(F.array_min, "lat").alias("miny"), side(F.array_max, "lon").alias("maxx"), side(F.array_max, "lat").alias("maxy"))


def parent_tags(nodes: DataFrame, ways: DataFrame, specs: tuple[ParentTag, ...]) -> DataFrame:
    """(id, key, val) that nodes get from the ways through them.

    Of ranked values the highest wins; without ranks the value of the way with the least id. A repeated key of a way counts
    with its last value; an empty value counts as none.
    """
    out = None
    refs = ways.select("id", "tags", F.explode(F.array_distinct("refs")).alias("node_id"))
    for key in dict.fromkeys(s.out_key for s in specs):
        same = [s for s in specs if s.out_key == key]
        way_key, ranks = same[0].way_key, same[0].ranks
        wanted = nodes.where(" or ".join(f"exists(tags, t -> t.key = '{s.node_key}')" for s in same)).select(F.col("id").alias("node_id"))
        met = refs.select("id", "node_id", T.last_tag(F.col("tags"), way_key).alias("val")).where("val is not null and val <> ''").join(wanted, "node_id", "left_semi")
        if ranks:
            table = F.map_from_arrays(F.array(*map(F.lit, ranks)), F.array(*map(F.lit, range(len(ranks)))))
            met = met.withColumn("rank", F.try_element_at(table, F.col("val"))).where("rank is not null")
            best = met.groupBy("node_id").agg(F.max_by("val", "rank").alias("val"))
        else:
            best = met.groupBy("node_id").agg(F.min_by("val", F.struct("id", "val")).alias("val"))
        some = best.select(F.col("node_id").alias("id"), F.lit(key).alias("key"), "val")
        out = some if out is None else out.unionByName(some)
    return out


def relation_tags(relations: DataFrame, specs: tuple[RelationTag, ...]) -> DataFrame:
    """(id, key, val) that ways get from the relations they are members of.

    ``min`` and ``max`` over the integers that values start with (others are left out), ``list`` the sorted distinct values joined by ``; ``.
    """
    out = None
    for spec in specs:
        passes = F.lit(True)
        for key, val in spec.where:
            passes = passes & T.has_tag(F.col("tags"), key, val)
        met = relations.where(passes).select(T.find_tag(F.col("tags"), spec.source).alias("val"), F.explode("members").alias("m")).where("val is not null and m.type = 1").select(F.col("m.ref").alias("id"), "val")
        if spec.how == "list":
            some = met.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("val")), "; ").alias("val"))
        else:
            number = met.withColumn("n", T.leading_number(F.col("val"))).where("n is not null")
            some = number.groupBy("id").agg((F.min if spec.how == "min" else F.max)("n").cast("string").alias("val"))
        some = some.select("id", F.lit(spec.target).alias("key"), "val")
        out = some if out is None else out.unionByName(some)
    return out


def _with_extra(elements: DataFrame, extra: DataFrame) -> DataFrame:
    """Elements with further tags (id, key, val) at the end, in the keys' order, in place of such keys before."""
    lists = extra.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "val"))).alias("more"))
    both = elements.join(lists, "id", "left")
    none = F.array().cast(T.NONE)
    kept = F.filter(F.coalesce("tags", none), lambda t: F.coalesce(~F.exists(F.coalesce("more", none), lambda m: m["key"] == t["key"]), F.lit(True)))
    return both.withColumn("tags", F.concat(kept, F.coalesce("more", none))).drop("more")


def make_geometries(nodes: DataFrame, ways: DataFrame, style: Style, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Points of nodes and lines or polygons of ways (with ``lonlats``) whose kept tags make them features.

    A way needs two places; one that is closed over at least four, with a polygon tag, is a polygon. With a box, only what touches it.
    """
    keep = T.filter_tags(F.col("tags"), list(style.feature_keys), None if style.other_keys is None else list(style.other_keys), list(style.drop_keys))
    wanted = F.size(keep) > 0 if style.all_objects else T.is_feature(F.col("tags"), list(style.feature_keys))
    picked = lambda df: df.withColumn("layer", T.layer(F.col("tags"))).where(wanted).withColumn("tags", keep)
    points = picked(nodes.where("lon is not null and lat is not null"))
    if box:
        points = points.where(in_box(F.col("lon"), F.col("lat"), box))
    points = points.select(F.lit(POINT).alias("type"), "id", "tags", "layer", F.array(F.struct("lon", "lat")).alias("lonlats"))
    lines = picked(ways.where("size(lonlats) >= 2"))
    if box:
        lines = lines.where(boxes_touch(box_of(F.col("lonlats")), box))
    closed = (F.size("refs") > 3) & (F.get("refs", F.lit(0)) == F.try_element_at("refs", F.lit(-1))) & (F.size("lonlats") > 3)
    lines = lines.select(F.when(closed & T.is_polygon(F.col("tags"), style.polygon_tags), POLYGON).otherwise(LINE).alias("type"), "id", "tags", "layer", "lonlats")
    both = points.unionByName(lines)
    area = ring_area(F.col("lonlats"))
    return both.select(
        "*",
        F.lit(None).cast("array<array<array<struct<lon:bigint,lat:bigint>>>>").alias("rings"),
        F.when(F.col("type") != POINT, T.z_order(F.col("tags"))).alias("zorder"),
        F.when(F.col("type") == LINE, line_length(F.col("lonlats"))).alias("length"),
        F.when(F.col("type") == POLYGON, F.abs(area)).alias("area"),
        F.when(F.col("type") == POLYGON, area < 0).alias("reversed"),
    )


def with_keys_and_zoom(shapes: DataFrame, style: Style, max_zoom: int | None = None, max_depth: int = 18, *, zoom: Column | None = None) -> DataFrame:
    """Shapes with ``minzoom`` and ``quadtree``. ``zoom`` (over the columns of shapes) takes the place of the zoom that the style's table gives. With ``max_zoom``, keys are made without buffer and rounded to the zoom, and what only shows deeper
    (or never) goes."""
    tag = F.when(F.col("type") == POINT, T.tag_zoom(F.col("tags"), [0], style.min_zoom)).when(F.col("type") == LINE, T.tag_zoom(F.col("tags"), [1, 2], style.min_zoom)).otherwise(T.tag_zoom(F.col("tags"), [1, 2], style.min_zoom))
    tag = tag if zoom is None else zoom
    size = F.when(F.col("type") == LINE, length_zoom(F.col("length"), style.min_length)).when(F.col("type").isin(POLYGON, MULTIPOLYGON), area_zoom(F.col("area"), style.min_area)).otherwise(F.lit(0).cast("bigint"))
    outline = F.when(F.col("type") == MULTIPOLYGON, F.flatten(F.flatten("rings"))).otherwise(F.col("lonlats"))
    boxed = shapes.withColumn("_b", box_of(outline))
    keyed = boxed.withColumn("quadtree", key_of_box("_b.minx", "_b.miny", "_b.maxx", "_b.maxy", 0.05 if max_zoom is None else 0.0, max_depth)).drop("_b")
    zoomed = keyed.withColumn("_tag", tag).withColumn("minzoom", F.when(F.col("_tag").isNotNull(), F.greatest("_tag", size))).drop("_tag")
    if max_zoom is None:
        return zoomed
    return zoomed.where(F.col("minzoom") <= max_zoom).withColumn("quadtree", tile_round("quadtree", F.col("minzoom")))


def process_geometry(nodes: DataFrame, ways: DataFrame, relations: DataFrame, style: Style | None = None, box: tuple[int, int, int, int] | None = None, max_zoom: int | None = None, *, zoom: Column | None = None) -> DataFrame:
    """All geometries of elements: tags of parents and relations are added first, so that they count in what follows.

    ``zoom`` as in ``with_keys_and_zoom``."""
    style = style or Style()
    tagged = nodes.where("size(tags) > 0")
    if style.parent_tags:
        tagged = _with_extra(tagged, parent_tags(tagged, ways, style.parent_tags))
    wanted = ways
    if max_zoom is not None and zoom is None:
        # what its tags alone keep from showing needs no geometry; tags of relations may still let a way show, and rings need all ways
        tagged = tagged.where(T.shows_by(F.col("tags"), [0], style.min_zoom, max_zoom))
        if not (style.relation_tags or style.multipolygons or style.boundaries):
            wanted = ways.where(T.shows_by(F.col("tags"), [1, 2], style.min_zoom, max_zoom))
    placed = ways_with_nodes(wanted, nodes)
    if style.relation_tags:
        placed = _with_extra(placed, relation_tags(relations, style.relation_tags))
    shapes = make_geometries(tagged, placed, style, box)
    if style.multipolygons or style.boundaries:
        made = build_multipolygons(relations, placed, style, box).where("rings is not null")
        shapes = shapes.unionByName(made.select(F.lit(MULTIPOLYGON).alias("type"), "id", "tags", "layer", F.lit(None).cast("array<struct<lon:bigint,lat:bigint>>").alias("lonlats"), "rings", T.z_order(F.col("tags")).alias("zorder"), F.lit(None).cast("double").alias("length"), "area", F.lit(None).cast("boolean").alias("reversed")))
    return with_keys_and_zoom(shapes, style, max_zoom, zoom=zoom)


def as_geojson(shapes: DataFrame) -> DataFrame:
    """(type, id, feature): GeoJSON text of each shape, degrees with seven digits.

    Beside id, properties and geometry a feature has its quadtree as x, y, z, its zoom if it has one, its layer if that isn't 0 or is tagged 0,
    its box, length or area with one digit, and its drawing order if that isn't 0. A ring that runs backwards is turned; a multipolygon of
    one part is a polygon.
    """
    degrees = lambda v: F.round(v * 1e-7, 7)
    place = lambda p: F.array(degrees(p["lon"]), degrees(p["lat"]))
    line = F.transform("lonlats", place)
    rings = F.transform("rings", lambda poly: F.transform(poly, lambda ring: F.transform(ring, place)))
    turned = F.when(F.coalesce("reversed", F.lit(False)), F.reverse(line)).otherwise(line)
    text = lambda kind, coordinates: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(coordinates), F.lit("}"))
    shape = F.when(F.col("type") == POINT, text("Point", F.get(line, F.lit(0)))).when(F.col("type") == LINE, text("LineString", line)).when(F.col("type") == POLYGON, text("Polygon", F.array(turned)))
    shape = shape.when(F.size("rings") == 1, text("Polygon", F.get(rings, F.lit(0)))).otherwise(text("MultiPolygon", rings))
    outline = F.when(F.col("type") == MULTIPOLYGON, F.flatten(F.transform("rings", lambda poly: F.get(poly, F.lit(0))))).otherwise(F.col("lonlats"))
    b = box_of(outline)
    box = F.to_json(F.array(*[degrees(b[c]) for c in ("minx", "miny", "maxx", "maxy")]))
    number = lambda name, value, shown: F.when(shown, F.concat(F.lit(f',"{name}":'), value.cast("string"))).otherwise(F.lit(""))
    parts = [F.lit('{"type":"Feature","id":'), F.col("id").cast("string")]
    if "quadtree" in shapes.columns:
        at = tile_xyz("quadtree")
        parts.append(F.coalesce(F.concat(F.lit(',"quadtree":'), F.to_json(F.array(at["x"], at["y"], at["z"]))), F.lit("")))
    if "minzoom" in shapes.columns:
        parts.append(number("minzoom", F.col("minzoom"), F.col("minzoom") >= 0))
    parts += [F.lit(',"properties":'), F.coalesce(T.as_json(F.col("tags")), F.lit("{}"))]
    if "layer" in shapes.columns:
        parts.append(number("layer", F.col("layer"), (F.col("layer") != 0) | T.has_tag(F.col("tags"), "layer", "0")))
    parts += [F.lit(',"geometry":'), shape, F.lit(',"bbox":'), box]
    parts += [number("way_length", F.round("length", 1), F.col("length").isNotNull()), number("way_area", F.round("area", 1), F.col("area").isNotNull()), number("z_order", F.col("zorder"), F.col("zorder") != 0), F.lit("}")]
    return shapes.select("type", "id", F.concat(*parts).alias("feature"))
