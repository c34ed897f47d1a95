"""Quadtree keys of elements: ways by their nodes' extent, nodes by their ways, relations by their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.quadtree import BUFFER, DEPTH, common, common_of, key_of_box, key_of_point
from tilewright.plans.lineage import cut, forget
from tilewright.plans.reach import Links


def way_nodes(ways: DataFrame) -> DataFrame:
    """(way_id, pos, node_id) of every reference."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id")).where("node_id is not null")


def way_boxes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, minx, miny, maxx, maxy, found, missing) of every way over the nodes that exist; null sides where none does."""
    refs = way_nodes(ways).select("way_id", "node_id").distinct()
    places = nodes.where("lon is not null and lat is not null").select(F.col("id").alias("node_id"), "lon", "lat")
    met = refs.join(places, "node_id", "left").groupBy("way_id").agg(F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"), F.count("lon").alias("found"), F.count_if(F.col("lon").isNull()).alias("missing"))
    return ways.select("id").join(met.withColumnRenamed("way_id", "id"), "id", "left").fillna(0, ["found", "missing"])


def way_keys(ways: DataFrame, nodes: DataFrame, buffer: float = BUFFER, max_depth: int = DEPTH) -> DataFrame:
    """(id, quadtree) of every way; -1 where none of its nodes exists."""
    return way_boxes(ways, nodes).select("id", key_of_box("minx", "miny", "maxx", "maxy", buffer, max_depth).alias("quadtree"))


def node_keys(nodes: DataFrame, ways: DataFrame, keyed_ways: DataFrame, buffer: float = BUFFER, max_depth: int = DEPTH) -> DataFrame:
    """(id, quadtree): the deepest tile that holds all ways of the node, or its own place if it is in none."""
    of_ways = way_nodes(ways).select("way_id", "node_id").join(keyed_ways.select(F.col("id").alias("way_id"), "quadtree"), "way_id").groupBy("node_id").agg(common_of("quadtree").alias("shared"))
    both = nodes.select("id", "lon", "lat").join(of_ways.withColumnRenamed("node_id", "id"), "id", "left")
    return both.withColumn("own", key_of_point("lon", "lat", buffer, max_depth)).select("id", F.when(F.coalesce("shared", F.lit(-1)) >= 0, F.col("shared")).otherwise(F.col("own")).alias("quadtree"))


def relation_keys(relations: DataFrame, keyed_nodes: DataFrame, keyed_ways: DataFrame) -> DataFrame:
    """(id, quadtree): the deepest tile that holds all members; missing members are ignored, without any it is 0.

    Members that are relations pass their key on in rounds until none changes, at any depth. Keys only get coarser, so
    circles come to rest too; a round reaches twice as far as the one before.
    """
    members = relations.select("id", F.explode("members").alias("m")).select("id", F.col("m.type").alias("kind"), F.col("m.ref").alias("ref")).distinct()
    leaves = keyed_nodes.select(F.lit(0).alias("kind"), F.col("id").alias("ref"), "quadtree").unionByName(keyed_ways.select(F.lit(1).alias("kind"), F.col("id").alias("ref"), "quadtree"))
    direct = members.join(leaves, ["kind", "ref"]).groupBy("id").agg(common_of("quadtree").alias("quadtree"))
    state = cut(relations.select("id").join(direct, "id", "left").select("id", F.coalesce("quadtree", F.lit(-1)).alias("quadtree")), "keys")
    nested = Links(members.where("kind = 2").select("id", "ref").join(relations.select(F.col("id").alias("ref")), "ref", "left_semi"))
    # only relations that contain others can change; the rest is joined once, at the end
    above = nested.links.select("id").distinct()
    inner = cut(state.join(above, "id", "left_semi"), "keys")
    outer = cut(state.join(nested.links.select(F.col("ref").alias("id")).distinct(), "id", "left_semi").join(above, "id", "left_anti"), "keys")
    while True:
        passed = nested.links.join(inner.unionByName(outer).select(F.col("id").alias("ref"), "quadtree"), "ref").groupBy("id").agg(common_of("quadtree").alias("passed"))
        step = inner.join(passed, "id", "left").select("id", common("quadtree", F.coalesce("passed", F.lit(-1))).alias("quadtree"), F.col("quadtree").alias("before"))
        step = cut(step.select("id", "quadtree", (F.col("quadtree") != F.col("before")).alias("changed")), "keys")
        before, inner = inner, step.select("id", "quadtree")
        forget(before)
        if not step.where("changed").limit(1).count():
            break
        nested.widen()
    final = state.join(inner.withColumnRenamed("quadtree", "passed"), "id", "left").select("id", F.coalesce("passed", "quadtree").alias("quadtree"))
    return final.select("id", F.when(F.col("quadtree") < 0, F.lit(0)).otherwise(F.col("quadtree")).alias("quadtree"))
