"""Command line: ``python -m tilewright VERB [ARGUMENT...] [NAME=VALUE...]``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.quadtree import overlaps_tile
from tilewright.functions.style import Style, read_min_zoom, read_style
from tilewright.functions.tags import fix_members, fix_tags
from tilewright.functions.text import read_date
from tilewright.operators import overlay, stats, tiling
from tilewright.operators.geometry import process_geometry
from tilewright.operators.keys import node_keys, relation_keys, way_keys
from tilewright.plans.geometry_tables import write_geometries
from tilewright.schema import COLUMNS
from tilewright.sources import geometry_blocks, pbf, snapshot
from tilewright.sources.osc import parse_box, read_osc, read_ring

USAGE = """\
count IN [filter=BOX]                      numbers and bounds by kind and change type, of geometries too
calcqts IN OUT [buffer=0.05] [max_depth=17]  quadtree keys of all elements (Parquet: type, id, quadtree)
sortblocks IN QTS OUT [target=40000] [min=20000] [max_depth=15] [rollup=0] [groups=OUT] [timestamp=DATE] [fixstrs=1]
                                           elements clustered by tile (Parquet, or block files if OUT ends in .pbf)
applychange IN CHANGE... OUT               change files applied to elements (Parquet)
readfile IN                                uncompressed size of block files
initial IN ROOT END_DATE                   start a dated dataset of clustered elements
update ROOT END_DATE CHANGE... [most_missing=N]  add a delta
update_downloaded ROOT FOLDER [merge=1]    add deltas of all newer change files of a folder: one for each, or merged up to 100 MB
droplast ROOT                              take the newest delta away
mergechanges ROOT OUT [filter=BOX or .poly file] [as_of=DATE] [sort=1]  one state without its history (Parquet;
                                           by (type, id), or by tile with sort=0)
geometry IN OUT [filter=BOX] [zoom=N] [style=JSON] [zooms=CSV] [minlen=0] [minarea=5] [lastdate=DATE]
                                           points, lines and polygons (Parquet, or block files if OUT ends in .pbf)
IN: a block file (.pbf), or a Parquet folder of elements."""


def load(spark: SparkSession, path: str, **more) -> DataFrame:
    return pbf.read_pbf(spark, path, **more) if path.endswith((".pbf", ".pbfc")) else spark.read.parquet(path)


def changes_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of change files; ``file_idx`` is each one's place in the list. XML files are read together, by their names."""
    texts = {p: k for k, p in enumerate(paths) if ".osc" in p}
    out = None
    if texts:
        out = read_osc(spark, texts)
    for k, p in enumerate(paths):
        if p not in texts:
            some = spark.read.parquet(p)
            some = some if "file_idx" in some.columns else some.withColumn("file_idx", F.lit(k))
            out = some if out is None else out.unionByName(some, allowMissingColumns=True)
    return out


def area(text: str | None) -> dict:
    if text is None:
        return {}
    return {"ring": read_ring(text)} if text.endswith(".poly") else {"box": parse_box(text)}


def main(words: list[str]) -> int:
    options = dict(w.split("=", 1) for w in words if "=" in w)
    verb, *args = [w for w in words if "=" not in w] or [""]
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if verb == "count":
        box = area(options.get("filter")).get("box")
        elements = load(spark, args[0], **({"box": box} if box and args[0].endswith((".pbf", ".pbfc")) else {}))
        if box and "tile_qt" in elements.columns:
            elements = elements.where(F.coalesce(overlaps_tile("tile_qt", *box), F.lit(True)))
        if args[0].endswith((".pbf", ".pbfc")):
            geometry_blocks.read_geometry_blocks(spark, args[0], box=box).groupBy("type").count().orderBy("type").show(100, False)
        stats.count_elements(elements).orderBy("type", "changetype").show(100, False)
        stats.count_nodes(elements.where("type = 0")).show(100, False)
        stats.count_ways(elements.where("type = 1")).show(100, False)
        stats.count_relations(elements.where("type = 2")).show(100, False)
    elif verb == "calcqts":
        elements = load(spark, args[0])
        nodes, ways, relations = (elements.where(F.col("type") == k) for k in range(3))
        how = (float(options.get("buffer", 0.05)), int(options.get("max_depth", 17)))
        by_way = way_keys(ways, nodes, *how)
        by_node = node_keys(nodes, ways, by_way, *how)
        parts = [by_node, by_way, relation_keys(relations, by_node, by_way)]
        keyed = [p.select(F.lit(k).alias("type"), "id", "quadtree") for k, p in enumerate(parts)]
        tiling.joined_keys(keyed).write.parquet(args[1])
    elif verb == "sortblocks":
        keyed = tiling.with_keys(load(spark, args[0]), spark.read.parquet(args[1]))
        if "fixstrs" in options:
            keyed = keyed.withColumn("tags", fix_tags(F.col("tags"))).withColumn("members", fix_members(F.col("members")))
        histogram = tiling.key_histogram(keyed, int(options.get("max_depth", 15)))
        if int(options.get("rollup", 0)):
            histogram = tiling.rolled_up(histogram, int(options["rollup"]), int(options.get("max_depth", 15)))
        tiles = tiling.grouped_tiles(histogram, int(options.get("target", 40_000)), int(options.get("min", 20_000)))
        if "groups" in options:
            tiles.write.parquet(options["groups"])
        rows = tiling.clustered(keyed.select(*COLUMNS), tiles)
        if args[2].endswith(".pbf"):
            pbf.write_pbf(rows, args[2], dates=(None, read_date(options["timestamp"]) if "timestamp" in options else None))
        else:
            rows.write.parquet(args[2])
    elif verb == "applychange":
        overlay.apply_changes(load(spark, args[0]), changes_of(spark, args[1:-1])).write.parquet(args[-1])
    elif verb == "readfile":
        pbf.uncompressed_size(spark, args).show(1000, False)
    elif verb == "initial":
        elements = load(spark, args[0])
        snapshot.init_snapshot(elements, elements.select("tile_qt").distinct() if "tile_qt" in elements.columns else elements.select(F.col("quadtree").alias("tile_qt")).distinct(), args[1], read_date(args[2]))
    elif verb == "update":
        print(snapshot.update_snapshot(changes_of(spark, args[2:]), args[0], read_date(args[1]), most_missing=int(options["most_missing"]) if "most_missing" in options else None))
    elif verb == "update_downloaded":
        for group in snapshot.new_changes(args[0], args[1], merge=options.get("merge") == "1"):
            print(snapshot.update_snapshot(changes_of(spark, [path for path, *_ in group]), args[0], group[-1][2], group[-1][1]))
    elif verb == "droplast":
        print(snapshot.drop_last(args[0]))
    elif verb == "mergechanges":
        snapshot.compact(spark, args[0], as_of=read_date(options["as_of"]) if "as_of" in options else None, sort=options.get("sort", "1") != "0", **area(options.get("filter"))).write.parquet(args[1])
    elif verb == "geometry":
        elements = load(spark, args[0])
        box = area(options.get("filter")).get("box")
        if "lastdate" in options:
            elements = elements.where(F.coalesce(F.col("info.timestamp") <= read_date(options["lastdate"]), F.lit(True)))
        sizes = {"min_length": float(options.get("minlen", 0)), "min_area": float(options.get("minarea", 5))}
        if "zooms" in options:
            sizes["min_zoom"] = read_min_zoom(options["zooms"])
        style = read_style(options["style"], **sizes) if "style" in options else Style(**sizes)
        shapes = process_geometry(*(elements.where(F.col("type") == k) for k in range(3)), style=style, box=box, max_zoom=int(options["zoom"]) if "zoom" in options else None)
        if args[1].endswith(".pbf"):
            geometry_blocks.write_geometry_blocks(shapes.repartitionByRange("quadtree", "id").sortWithinPartitions("quadtree", "type", "id"), args[1], box=box)
        else:
            write_geometries(shapes, args[1])
    else:
        print(USAGE)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
