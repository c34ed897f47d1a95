"""Queries over the element tables: each takes a session and a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright import element_oracle, element_queries, oracle
from tilewright.operators.current import current_rows, is_live
from tilewright.operators.hierarchy import hierarchy
from tilewright.operators.geometry import ways_with_nodes
from tilewright.operators.history import attribute_history, version_history
from tilewright.operators.patches import current_table, final_state, patched_table
from tilewright.operators.proximity import within_distance
from tilewright.operators.references import orphan_references
from tilewright.operators.regions import points_in_regions
from tilewright.operators.skew import keys_above_share, salted_totals

KINDS = {0: "osm_nodes", 1: "osm_ways", 2: "osm_relations"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of live nodes at most 5 m apart."""
    nodes = current_rows(table(spark, folder, "osm_nodes"), ["lon", "lat"])
    placed = nodes.where("live and abs(lon) <= 1800000000 and abs(lat) <= 900000000")
    return within_distance(placed.select("id", (F.col("lon") / 1e7).alias("lon"), (F.col("lat") / 1e7).alias("lat")), 5.0)


def p1_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Live nodes inside the areas of closed live ways whose nodes are all there."""
    nodes = current_rows(table(spark, folder, "osm_nodes"), ["lon", "lat"]).where("live and abs(lon) <= 1800000000 and abs(lat) <= 900000000")
    ways = current_rows(table(spark, folder, "osm_ways"), ["refs"]).where("live and size(refs) > 3 and refs[0] = element_at(refs, -1)")
    closed = ways_with_nodes(ways, nodes).where("missing = 0")
    return points_in_regions(nodes, closed.select(F.col("id").alias("region_id"), F.col("lonlats").alias("ring")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every visible version of nodes and ways with its validity period."""
    seen = table(spark, folder, "info_snapshots")
    states = seen.select("type", "id", F.col("info.version").alias("version"), F.col("info.timestamp").alias("time"), F.col("info.visible").alias("visible"))
    return version_history(states, ["type", "id"]).where("visible").drop("visible")


def p2_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Version, changeset, user and visibility of nodes and ways as the snapshots show them, with the periods by snapshot date."""
    seen = table(spark, folder, "info_snapshots").where("info is not null")
    attributes = ["version", "changeset", "user_id", "visible"]
    states = seen.select("type", "id", "snapshot_idx", "snapshot_date", *[F.col(f"info.{c}").alias(c) for c in attributes])
    return attribute_history(states, ["type", "id"], "snapshot_idx", "snapshot_date", attributes)


def relation_links(spark: SparkSession, folder: str) -> DataFrame:
    """(parent, child) of live relations that contain live relations."""
    live = current_rows(table(spark, folder, "osm_relations"), ["members"]).where("live")
    wanted = F.array_distinct(F.transform(F.filter("members", lambda m: m["type"] == 2), lambda m: m["ref"]))
    links = live.select(F.col("id").alias("parent"), F.explode(wanted).alias("child"))
    return links.join(live.select(F.col("id").alias("child")), "child", "left_semi")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth and path of every relation in a structure of relations."""
    return hierarchy(relation_links(spark, folder)).select("id", "root_id", "depth", "path")


def p3_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Number of descendants of every relation outside circles, from its nested-set range."""
    return hierarchy(relation_links(spark, folder), paths=False).where("pre is not null").select("id", (F.col("size") - 1).alias("descendants"))


def references(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference of a live way or relation row."""
    ways = table(spark, folder, "osm_ways").where(is_live(F.col("changetype"))).select("id", F.explode(F.array_distinct("refs")).alias("ref"))
    relations = table(spark, folder, "osm_relations").where(is_live(F.col("changetype"))).select("id", F.explode(F.array_distinct(F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref"))))).alias("m"))
    return ways.select(F.lit(1).alias("src_type"), F.col("id").alias("src_id"), F.lit(0).alias("ref_type"), F.col("ref").alias("ref_id")).unionByName(
        relations.select(F.lit(2).alias("src_type"), F.col("id").alias("src_id"), F.col("m.type").alias("ref_type"), F.col("m.ref").alias("ref_id"))
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """References to elements that are missing, deleted or arrive later."""
    rows = None
    for kind, name in KINDS.items():
        some = table(spark, folder, name).select(F.lit(kind).alias("kind"), "id", is_live(F.col("changetype")).alias("live"))
        rows = some if rows is None else rows.unionByName(some)
    late = table(spark, folder, "osm_changes").where("changetype in (3, 4, 5)").select(F.col("type").alias("kind"), "id")
    return orphan_references(references(spark, folder), rows.where("live"), rows.where("not live"), late)


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references by table, state and the month of the source row's timestamp (null: no time)."""
    times = None
    for kind in (1, 2):
        some = current_rows(table(spark, folder, KINDS[kind]), ["info"]).select(F.lit(kind).alias("src_type"), F.col("id").alias("src_id"), F.date_format(F.timestamp_seconds(F.col("info.timestamp")), "yyyy-MM").alias("period"))
        times = some if times is None else times.unionByName(some)
    return p5_found(spark, folder).join(times, ["src_type", "src_id"], "left").groupBy("src_type", "ref_type", "period", "state").agg(F.count(F.lit(1)).alias("orphans"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles that hold at least 2 % of all rows."""
    return keys_above_share(table(spark, folder, "qt_items"), "qt", "weight", 2).where("qt >= 0").select("qt")


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and total weight of every tile."""
    return salted_totals(table(spark, folder, "qt_items"), "qt", "weight").select("qt", "n", F.col("total").cast("bigint").alias("total"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Final version of the changed nodes that exist in the end."""
    changes = table(spark, folder, "osm_changes").where("type = 0")
    return final_state(changes, table(spark, folder, "osm_nodes")).select("id", "version")


def p7_table(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table of nodes once all changes are applied."""
    changes = table(spark, folder, "osm_changes").where("type = 0")
    return current_table(changes, table(spark, folder, "osm_nodes"), ["lon", "lat"])


def p7_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The same where a change leaves the columns that are null in it as they are."""
    named = lambda t: t.withColumn("user_id", F.col("info.user_id"))
    changes = named(table(spark, folder, "osm_changes").where("type = 0"))
    return patched_table(changes, named(table(spark, folder, "osm_nodes")), ["lon", "lat", "user_id"])


QUERIES = element_queries.QUERIES | {f.__name__: f for f in (p1_found, p1_regions, p2_found, p2_attributes, p3_found, p3_ranges, p5_found, p5_report, p6_found, p6_totals, p7_found, p7_table, p7_columns)}
SQL: dict[str, str] = element_oracle.SQL | oracle.SQL
