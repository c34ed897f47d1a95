"""Ids as sets, and extracts of an area with everything that belongs to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geo import in_box, in_polygon
from tilewright.operators.keys import way_nodes
from tilewright.plans.lineage import cut
from tilewright.plans.reach import Links

def in_range(id_: Column, least: int, below: int) -> Column:
    """Half-open range of ids; without an upper end if ``below`` isn't positive."""
    return (id_ >= least) if below <= 0 else (id_ >= least) & (id_ < below)


def outside(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """Elements that the set of (type, id) lacks."""
    return elements.join(ids.select("type", "id").distinct(), ["type", "id"], "left_anti")


def inside(elements: DataFrame, ids: DataFrame) -> DataFrame:
    return elements.join(ids.select("type", "id").distinct(), ["type", "id"], "left_semi")


def named_ids(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct (type, id) of elements and all that they refer to."""
    parts = [t.select(F.lit(k).alias("type"), "id") for k, t in enumerate((nodes, ways, relations))]
    parts.append(ways.select(F.lit(0).alias("type"), F.explode("refs").alias("id")))
    parts.append(relations.select(F.explode("members").alias("m")).select(F.col("m.type").alias("type"), F.col("m.ref").alias("id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("type is not null and id is not null").distinct()


def area_ids(nodes: DataFrame, ways: DataFrame, relations: DataFrame, box: tuple[int, int, int, int], ring: list[tuple[int, int]] | None = None) -> DataFrame:
    """(type, id) of an area: nodes in the box (and ring), ways with any of them, all nodes of those ways, relations with any of
    these as member, and relations with such relations as members, at any depth and in circles too.

    Ways' nodes count whether or not the node table has them; only ids of the way and relation tables are found for those.
    """
    hit = in_box(F.col("lon"), F.col("lat"), box)
    if ring is not None:
        hit = hit & in_polygon(F.col("lon"), F.col("lat"), ring)
    seeds = nodes.where(hit).select("id").distinct()
    refs = way_nodes(ways)
    got_ways = refs.join(seeds.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select(F.col("way_id").alias("id")).distinct()
    all_nodes = refs.join(got_ways.withColumnRenamed("id", "way_id"), "way_id", "left_semi").select(F.col("node_id").alias("id")).union(seeds).distinct()
    low = cut(all_nodes.select(F.lit(0).alias("type"), "id").unionByName(got_ways.select(F.lit(1).alias("type"), "id")), "area")
    members = cut(relations.select("id", F.explode("members").alias("m")).select("id", F.col("m.type").alias("kind"), F.col("m.ref").alias("ref")).distinct(), "members")
    found = cut(members.join(low.select(F.col("type").alias("kind"), F.col("id").alias("ref")), ["kind", "ref"], "left_semi").select("id").distinct(), "relations")
    known = relations.select(F.col("id").alias("ref"))
    nested = Links(members.where("kind = 2").select("id", "ref").join(known, "ref", "left_semi"))
    parts, fresh = [found], found
    while True:
        above = nested.links.join(found.withColumnRenamed("id", "ref"), "ref", "left_semi").select("id").distinct()
        fresh = cut(above.join(found, "id", "left_anti"), "relations")
        if not fresh.limit(1).count():
            break
        parts.append(fresh)
        found = reduce(DataFrame.union, parts)
        nested.widen()
    return low.unionByName(found.select(F.lit(2).alias("type"), "id"))


def filter_members(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with only the members that the set holds, in their order; relations left without any, or without any before, go."""
    flat = relations.select("id", F.posexplode("members").alias("pos", "m"))
    keep = flat.join(ids.select("type", F.col("id").alias("ref")).distinct(), (F.col("m.type") == F.col("type")) & (F.col("m.ref") == F.col("ref")), "left_semi")
    packed = keep.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("members"))
    return relations.drop("members").join(packed, "id")
