"""Histories with validity periods from repeated states of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An entity's states are ordered in chunks of so many order numbers.
CHUNK = 65_536


def islands(states: DataFrame, keys: list[str], order: str, attributes: list[str], time: str, folds: dict[str, Column] | None = None, *, chunk: int = CHUNK) -> DataFrame:
    """Runs of equal attributes over each entity's states, with the period of each.

    ``order``: bigint column that states are put in order by; states equal in it go by ``time`` and attributes, so the
    result never depends on row order. Result: keys, ``attributes``, ``valid_from`` (least time of the run), ``valid_to``
    (that of the entity's next run, -1 where there is none) and the aggregates ``folds`` over the run's distinct states.
    Rows with a null key, order or time are left out; a null attribute is a value like others.

    Gaps and islands: a lag comparison of the attribute hash marks changes, a running sum numbers the islands, the least
    time starts each and the next island's start ends it. Exact copies are folded before the shuffle. Where order numbers
    span more than ``chunk``, an entity's states are divided into chunks: each first state is compared with the last one
    of the chunk before, and numbers go on from those before, so no window holds more than a chunk's states.
    """
    folds = folds or {}
    named = list(dict.fromkeys([*keys, order, time, *attributes]))
    extra = [c for c in states.columns if c not in named and folds]
    known = states.where(" and ".join(f"`{c}` is not null" for c in [*keys, order, time])).select(*named, *extra).distinct()
    known = known.withColumn("_hash", F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in attributes]))
    along = [F.col(order), F.col(time), *[F.col(c) for c in attributes], F.col("_hash")]
    span = known.agg(F.min(order), F.max(order)).first()
    chunked = span[0] is not None and span[1] // chunk != span[0] // chunk
    group = list(keys)
    if chunked:
        known = known.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("bigint"))
        group.append("_chunk")
    window = Window.partitionBy(*group).orderBy(*along)
    before = F.lag("_hash").over(window)
    if chunked:
        ends = known.groupBy(*group).agg(F.max_by("_hash", F.struct(*[c.alias(f"_{i}") for i, c in enumerate(along)])).alias("_last"))
        ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_last")
        known = known.join(ends, group)
        before = F.coalesce(before, F.col("_before"))
    marked = known.withColumn("_change", F.when(before.isNull() | (before != F.col("_hash")), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_change").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    if chunked:
        sums = numbered.groupBy(*group).agg(F.sum("_change").alias("_n"))
        sums = sums.withColumn("_offset", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
        numbered = numbered.join(sums, group).withColumn("_island", F.col("_island") + F.col("_offset"))
    kept = [F.first(c).alias(c) for c in attributes if c not in keys]
    made = numbered.groupBy(*keys, "_island").agg(F.min(time).alias("valid_from"), *kept, *[f.alias(n) for n, f in folds.items()])
    if chunked:  # the next island by its number, so that a long history needs no window of its own
        following = made.select(*keys, (F.col("_island") - 1).alias("_island"), F.col("valid_from").alias("_next"))
        made = made.join(following, [*keys, "_island"], "left")
    else:
        made = made.withColumn("_next", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("_island")))
    return made.select(*keys, *[c for c in attributes if c not in keys], "valid_from", F.coalesce("_next", F.lit(-1).cast("bigint")).alias("valid_to"), *folds)


def version_history(states: DataFrame, keys: list[str], *, chunk: int = CHUNK) -> DataFrame:
    """Every version of every entity with the period in which it was valid.

    ``states``: the key columns, ``version`` bigint, ``time`` bigint, ``visible`` boolean; any number of rows per
    version, in any order (snapshots repeat, lag and restate). Result: keys, ``version``, ``valid_from`` (smallest
    time of the version), ``valid_to`` (that of the next higher version, -1 where there is none), ``visible`` (true
    if any row says so; null counts as false). Rows with a null key, version or time are left out. Further columns
    are ignored.

    These are the ``islands`` of equal versions over all states in version order: snapshots that lag behind others are put
    where they belong, and restated times of a version fall into its one island.
    """
    seen = states.select(*keys, "version", "time", F.coalesce(F.col("visible"), F.lit(False)).alias("visible"))
    return islands(seen, keys, "version", ["version"], "time", {"visible": F.max("visible")}, chunk=chunk).select(*keys, "version", "valid_from", "valid_to", "visible")


def attribute_history(states: DataFrame, keys: list[str], snapshot: str, time: str, attributes: list[str], *, chunk: int = CHUNK) -> DataFrame:
    """What each entity looked like from snapshot to snapshot: runs of equal ``attributes`` with their periods.

    Of several rows of an entity in one snapshot the greatest by ``attributes`` counts (name the version first), so copies and
    late rows fold. Result: keys, attributes, ``valid_from`` and ``valid_to`` by ``time``, and ``snapshots``, the number of
    snapshots in the run. A return to former values is a run of its own; absence from a snapshot ends none. Rows with a
    null key, snapshot or time are left out.
    """
    known = states.where(" and ".join(f"`{c}` is not null" for c in [*keys, snapshot, time]))
    one = known.groupBy(*keys, F.col(snapshot).cast("bigint").alias("_snapshot")).agg(F.max(F.struct(*attributes)).alias("_a"), F.min(time).alias("_time"))
    flat = one.select(*keys, "_snapshot", "_time", *[F.col(f"_a.{c}").alias(c) for c in attributes])
    return islands(flat, keys, "_snapshot", attributes, "_time", {"snapshots": F.count(F.lit(1))}, chunk=chunk)
