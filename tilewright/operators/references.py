"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.lineage import cut

#: Keys are handled in ranges of 2**CHUNK_BITS, so no window group holds more keys.
CHUNK_BITS = 16


def key_runs(keys: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(kind, chunk, start, end): distinct (kind, id) compressed into runs of consecutive ids.

    Runs end at multiples of 2**chunk_bits, so each range of ids is compressed by itself.
    """
    distinct = keys.where("kind is not null and id is not null").select("kind", "id").distinct()
    along = Window.partitionBy("kind", "chunk").orderBy("id")
    numbered = distinct.withColumn("chunk", F.shiftright("id", chunk_bits)).withColumn("island", F.col("id") - F.row_number().over(along))
    return numbered.groupBy("kind", "chunk", "island").agg(F.min("id").alias("start"), F.max("id").alias("end")).drop("island")


def keys_outside_runs(keys: DataFrame, runs: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Distinct (kind, id) of ``keys`` that no run contains.

    As-of match: each key takes the last run that starts at or before it; a key beyond that run's end is outside.
    """
    distinct = keys.where("kind is not null and id is not null").select("kind", "id").distinct()
    probes = distinct.select("kind", F.shiftright("id", chunk_bits).alias("chunk"), F.col("id").alias("at"), F.lit(1).alias("probe"), F.lit(None).cast("bigint").alias("end"))
    starts = runs.select("kind", "chunk", F.col("start").alias("at"), F.lit(0).alias("probe"), "end")
    along = Window.partitionBy("kind", "chunk").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    asof = starts.unionByName(probes).withColumn("reach", F.last("end", ignorenulls=True).over(along))
    return asof.where("probe = 1 and (reach is null or at > reach)").select("kind", F.col("at").alias("id"))


def orphan_references(refs: DataFrame, live: DataFrame, known: DataFrame, arriving: DataFrame) -> DataFrame:
    """Distinct references whose key is not in ``live``, with the state of the key.

    ``refs``: ``src_type, src_id, ref_type, ref_id``. The others: ``kind, id``. State: ``late`` if the key is in
    ``arriving``, else ``deleted`` if it is in ``known``, else ``missing``. References with a null part are left out;
    copied ones come out once; extra columns are ignored.
    """
    refs = refs.select("src_type", "src_id", "ref_type", "ref_id").dropna()
    # read three times below
    orphans = cut(keys_outside_runs(refs.select(F.col("ref_type").alias("kind"), F.col("ref_id").alias("id")), key_runs(live)), "orphans")
    marks = known.select("kind", "id", F.lit(1).alias("rank")).unionByName(arriving.select("kind", "id", F.lit(2).alias("rank")))
    marks = marks.join(orphans, ["kind", "id"], "left_semi")
    ranked = orphans.select("kind", "id", F.lit(0).alias("rank")).unionByName(marks).groupBy("kind", "id").agg(F.max("rank").alias("rank"))
    state = F.element_at(F.array(F.lit("missing"), F.lit("deleted"), F.lit("late")), F.col("rank") + 1)
    found = refs.join(ranked.select(F.col("kind").alias("ref_type"), F.col("id").alias("ref_id"), state.alias("state")), ["ref_type", "ref_id"])
    return found.select("src_type", "src_id", "ref_type", "ref_id", "state").distinct()
