"""Statistics of element tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_elements(elements: DataFrame) -> DataFrame:
    """Per (type, changetype): number, least and greatest id and timestamp."""
    time = F.col("info.timestamp")
    return elements.groupBy("type", "changetype").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def count_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("changetype").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])


def count_ways(ways: DataFrame) -> DataFrame:
    """References: their number, least and greatest (0 counts as none), and the longest way's."""
    n = F.coalesce(F.size("refs"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    set_ = F.filter("refs", lambda r: r != 0)
    return ways.groupBy("changetype").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("refs"), F.min(F.array_min(set_)).alias("min_ref"), F.max(F.array_max(set_)).alias("max_ref"), F.max(n).cast("bigint").alias("longest"))


def count_relations(relations: DataFrame) -> DataFrame:
    """Members by kind, relations without any, and the longest one's number."""
    n = F.greatest(F.coalesce(F.size("members"), F.lit(0)), F.lit(0))
    of = lambda kind: F.sum(F.greatest(F.coalesce(F.size(F.filter("members", lambda m: m["type"] == kind)), F.lit(0)), F.lit(0)))
    return relations.groupBy("changetype").agg(F.count(F.lit(1)).alias("n"), of(0).alias("node_members"), of(1).alias("way_members"), of(2).alias("relation_members"), F.count_if(n == 0).alias("empty"), F.max(n).cast("bigint").alias("longest"))


def tile_summary(elements: DataFrame, tile: str = "quadtree") -> DataFrame:
    """Nodes, ways and relations per tile."""
    return elements.groupBy(F.col(tile).alias("tile_qt")).agg(*[F.count_if(F.col("type") == k).alias(n) for k, n in enumerate(("nodes", "ways", "relations"))])
