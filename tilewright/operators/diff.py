"""Differences between two states of elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may differ, in the order in which it is looked for.
CHECKS = ("changetype", "version", "timestamp", "changeset", "user_id", "tags", "refs", "members", "lon", "lat", "quadtree")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(type, id, reason): ``only_left``, ``only_right``, ``same``, or the first of CHECKS that differs (null equals null).

    Only columns that both tables have are compared; info's fields one by one, tags in any order. Each table has one row per (type, id).
    """
    def view(df: DataFrame, side: str) -> DataFrame:
        fields = {c: F.col(f"info.{c}") if c in ("version", "timestamp", "changeset", "user_id") else F.array_sort(c) if c == "tags" else F.col(c) for c in CHECKS}
        names = [c for c in CHECKS if (c in left.columns and c in right.columns) or (c in ("version", "timestamp", "changeset", "user_id") and "info" in left.columns and "info" in right.columns)]
        return df.select("type", "id", F.struct(*[fields[c].alias(c) for c in names]).alias(side))

    a, b = view(left, "a"), view(right, "b")
    names = a.schema["a"].dataType.names
    both = a.join(b, ["type", "id"], "full_outer")
    reason = F.when(F.col("b").isNull(), "only_left").when(F.col("a").isNull(), "only_right")
    for c in names:
        reason = reason.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c)
    return both.select("type", "id", reason.otherwise("same").alias("reason"))


def difference_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    return compare(left, right).groupBy("type", "reason").agg(F.count(F.lit(1)).alias("n"))


def renamed_users(left: DataFrame, right: DataFrame) -> DataFrame:
    """(user_id, left_user, right_user, n) of elements whose user has another name on either side."""
    pick = lambda df, side: df.select("type", "id", F.col("info.user_id").alias("user_id"), F.col("info.user").alias(side))
    both = pick(left, "left_user").join(pick(right, "right_user"), ["type", "id", "user_id"])
    return both.where("not (left_user <=> right_user)").groupBy("user_id", "left_user", "right_user").agg(F.count(F.lit(1)).alias("n"))
