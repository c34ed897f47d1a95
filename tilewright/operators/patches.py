"""Applying change feeds: patches that compose associatively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, MODIFY, CREATE = 1, 4, 5
#: A version below all others.
LOWEST = -(2**63)


def _patch(payload: list[str]) -> Column:
    """A change as a patch. Composition keeps the greater, which is associative, commutative and idempotent, so
    repeated and out-of-order changes compose to the same patch in any grouping."""
    return F.struct(F.col("info.version").alias("version"), F.col("file_idx").alias("rank"), F.col("changetype").alias("changetype"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)])


def _acting(changes: DataFrame, chunk_files: int) -> DataFrame:
    chunk = F.floor(F.coalesce(F.col("file_idx"), F.lit(-1)) / F.lit(chunk_files)).cast("bigint")
    return changes.where(F.col("changetype").isin(DELETE, MODIFY, CREATE) & F.col("id").isNotNull()).withColumn("_chunk", chunk)


def composed_patches(changes: DataFrame, payload: list[str] = (), *, chunk_files: int = 8) -> DataFrame:
    """(id, patch): all acting changes (Create, Modify, Delete) of each id composed into one.

    The higher version decides, then the higher file index, then the greater change type, then the greater payload;
    a null version or index is below every other. Composition is a tree: within map tasks, then by id and range of
    ``chunk_files`` file indexes, so that a hot id is divided too, then by id.
    """
    leaves = _acting(changes, chunk_files).select("id", "_chunk", _patch(list(payload)).alias("patch")).groupBy("id", "_chunk").agg(F.max("patch").alias("patch"))
    return leaves.groupBy("id").agg(F.max("patch").alias("patch"))


def _ground(base: DataFrame, payload: list[str]) -> DataFrame:
    """(id, ground): of each id the base row with the highest version."""
    ground = F.struct(F.col("info.version").alias("version"), F.coalesce(~F.col("changetype").isin(1, 2), F.lit(True)).alias("live"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)])
    return base.where("id is not null").groupBy("id").agg(F.max(ground).alias("ground"))


def _resolved(both: DataFrame, payload: list[str]) -> DataFrame:
    """What patches make of ground rows, where either may be missing: the elements that exist."""
    changed = F.col("patch").isNotNull() & (F.col("ground").isNull() | (F.coalesce("patch.version", F.lit(LOWEST)) >= F.coalesce("ground.version", F.lit(LOWEST))))
    exists = F.when(changed, F.col("patch.changetype") != DELETE).otherwise(F.col("ground.live"))
    pick = lambda field: F.when(changed, F.col(f"patch.{field}")).otherwise(F.col(f"ground.{field}"))
    return both.where(exists).select("id", pick("version").alias("version"), *[pick(f"_p{i}").alias(c) for i, c in enumerate(payload)])


def final_state(changes: DataFrame, base: DataFrame, payload: list[str] = ()) -> DataFrame:
    """(id, version, payload...) of the changed elements that exist once all changes are applied to the base rows.

    Both tables: ``id, changetype, info`` and the payload columns; ``changes`` also ``file_idx``. Of base rows the
    highest version counts. At equal version a change beats the base row. The element exists if the deciding row is
    a Create or Modify, or a live base row. Elements without an acting change are not part of the result; rows with
    a null id are left out.
    """
    payload = list(payload)
    patches = composed_patches(changes, payload)
    # only rows of changed ids are folded; the id's partitioning serves both joins
    stood = _ground(base.join(patches.select("id"), "id", "left_semi"), payload)
    return _resolved(patches.join(stood, "id", "left"), payload)


def current_table(changes: DataFrame, base: DataFrame, payload: list[str] = ()) -> DataFrame:
    """(id, version, payload...) of the whole table once all changes are applied: as ``final_state``, with the live base rows
    that no change names."""
    payload = list(payload)
    return _resolved(composed_patches(changes, payload).join(_ground(base, payload), "id", "full_outer"), payload)


def _order(rank: Column, changetype: Column) -> Column:
    return F.struct(F.coalesce("info.version", F.lit(LOWEST)).alias("version"), F.coalesce(rank, F.lit(LOWEST)).cast("bigint").alias("rank"), changetype.cast("int").alias("changetype"))


def column_patches(changes: DataFrame, columns: list[str], *, chunk_files: int = 8) -> DataFrame:
    """(id, last, reset, c0, c1, ...): changes that set only the columns that aren't null in them, composed into one for each id.

    A change is a function of a row: Modify sets its columns, Create and Delete also clear all others (``reset``). Composed,
    a column is that of the latest change that sets it, ``last`` the latest change, ``reset`` the latest that clears: each the
    greatest by (version, file index, change type), the value itself last, so composition is a maximum and any grouping
    of repeated and out-of-order changes gives the same. The tree is that of ``composed_patches``.
    """
    order = _order(F.col("file_idx"), F.col("changetype"))
    fields = {"last": order, "reset": F.when(F.col("changetype") != MODIFY, order)}
    fields |= {f"c{i}": F.when((F.col("changetype") != DELETE) & F.col(c).isNotNull(), F.struct(order.alias("order"), F.col(c).alias("value"))) for i, c in enumerate(columns)}
    leaves = _acting(changes, chunk_files).select("id", "_chunk", *[f.alias(n) for n, f in fields.items()]).groupBy("id", "_chunk").agg(*[F.max(n).alias(n) for n in fields])
    return leaves.groupBy("id").agg(*[F.max(n).alias(n) for n in fields])


def patched_table(changes: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """(id, version, columns...) of the whole table once changes that set only their non-null columns are applied.

    The base row of highest version counts as a Create before all changes of its version; changes of lower versions are
    older than it and change nothing. An element exists if the latest change is no Delete, or the live base row is later.
    Modifies after a Delete start from an empty row. Other rules as in ``final_state``.
    """
    both = column_patches(changes, columns).join(_ground(base, columns), "id", "full_outer")
    at = F.struct(F.coalesce("ground.version", F.lit(LOWEST)).alias("version"), F.lit(LOWEST).alias("rank"), F.lit(0).alias("changetype"))
    ground = F.when(F.col("ground").isNotNull(), at)
    patched = F.col("last").isNotNull() & (ground.isNull() | (F.col("last") > at))
    exists = F.when(patched, F.col("last.changetype") != DELETE).otherwise(F.col("ground.live"))
    # what was cleared last: by a change, by the base row (which sets all its columns), or never
    cleared = F.greatest("reset", ground)
    from_base = F.col("ground.live") & (F.col("reset").isNull() | (F.col("reset") < at))
    value = lambda i: F.when(F.col(f"c{i}").isNotNull() & (cleared.isNull() | (F.col(f"c{i}.order") >= cleared)), F.col(f"c{i}.value")).when(from_base, F.col(f"ground._p{i}"))
    version = F.when(patched, F.when(F.col("last.version") != LOWEST, F.col("last.version"))).otherwise(F.col("ground.version"))
    return both.where(exists).select("id", version.alias("version"), *[value(i).alias(c) for i, c in enumerate(columns)])
