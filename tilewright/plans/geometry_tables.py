"""Tables of geometries: written clustered by tile, read by box and zoom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.geo import boxes_touch
from tilewright.functions.quadtree import overlaps_tile, tile_round
from tilewright.operators.geometry import MULTIPOLYGON, as_geojson, box_of


def write_geometries(shapes: DataFrame, path: str) -> None:
    """With their boxes, in ranges of keys, so that readers skip what lies elsewhere."""
    outline = F.when(F.col("type") == MULTIPOLYGON, F.flatten(F.flatten("rings"))).otherwise(F.col("lonlats"))
    shapes.withColumn("box", box_of(outline)).repartitionByRange("quadtree", "id").sortWithinPartitions("quadtree", "type", "id").write.mode("overwrite").parquet(path)


def read_geometries(spark: SparkSession, path: str, *, box: tuple[int, int, int, int] | None = None, max_zoom: int | None = None) -> DataFrame:
    """Geometries that touch the box and show by ``max_zoom`` (those without a zoom don't)."""
    shapes = spark.read.parquet(path)
    if box is not None:
        shapes = shapes.where(overlaps_tile("quadtree", *box) & boxes_touch(F.col("box"), box))
    return shapes if max_zoom is None else shapes.where(F.col("minzoom").between(0, max_zoom))


#: Names of the layers of geometry types.
LAYERS = {3: "point", 4: "line", 5: "polygon", 6: "polygon"}


def feature_collections(shapes: DataFrame, tile_level: int = 8, *, features: int = 10_000) -> DataFrame:
    """(tile_qt, layer, part, collection): GeoJSON feature collections with their boxes, one for each tile of a level and layer (point, line,
    polygon); one with more than ``features`` features is divided by id into parts of about as many."""
    layer = F.element_at(F.create_map(*[F.lit(v) for pair in LAYERS.items() for v in pair]), F.col("type"))
    about = shapes.select("type", "id", tile_round("quadtree", tile_level).alias("tile_qt"), layer.alias("layer"), box_of(F.when(F.col("type") == MULTIPOLYGON, F.flatten(F.flatten("rings"))).otherwise(F.col("lonlats"))).alias("b"))
    keyed = as_geojson(shapes).join(about, ["type", "id"])
    counts = about.groupBy("tile_qt", "layer").agg(F.ceil(F.count(F.lit(1)) / features).alias("parts"))
    parted = keyed.join(counts, ["tile_qt", "layer"]).withColumn("part", F.pmod(F.xxhash64("type", "id"), F.col("parts")))
    side = lambda f, c: F.round(f(f"b.{c}") * 1e-7, 7).alias(c)
    lists = parted.groupBy("tile_qt", "layer", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "type", "feature"))), lambda f: f["feature"]), ",").alias("all"), side(F.min, "minx"), side(F.min, "miny"), side(F.max, "maxx"), side(F.max, "maxy"))
    box = F.to_json(F.array("minx", "miny", "maxx", "maxy"))
    return lists.select("tile_qt", "layer", "part", F.concat(F.lit('{"type":"FeatureCollection","table":"'), F.col("layer"), F.lit('","bbox":'), box, F.lit(',"features":['), F.col("all"), F.lit("]}")).alias("collection"))


def feature_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(type, id, left, right) of features that differ or that one side lacks."""
    a, b = (as_geojson(df).withColumnRenamed("feature", side) for df, side in ((left, "left"), (right, "right")))
    return a.join(b, ["type", "id"], "full_outer").where("not (left <=> right)")
