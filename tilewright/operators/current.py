"""The current row of each element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, REMOVE = 1, 2


def is_live(changetype: Column) -> Column:
    """True unless the change type is Delete or Remove; a null change type counts as Normal."""
    return F.coalesce(~changetype.isin(DELETE, REMOVE), F.lit(True))


def current_rows(df: DataFrame, payload: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row per element: that with the highest ``info.version``.

    Columns: the keys (default ``id``), ``version`` (null where no row has one), ``live``, then ``payload``.
    A null version sorts below every other. Rows that tie in version are copies; if they differ after all, the
    greatest by (live, payload) is taken, so the result never depends on row order. Rows with a null key are left
    out. Copies are folded before the shuffle. Columns not named are ignored.
    """
    keys = keys or ["id"]
    rank = F.struct(
        F.col("info.version").alias("_version"),
        is_live(F.col("changetype")).alias("_live"),
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)],
    )
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    best = df.where(known).groupBy(*keys).agg(F.max(rank).alias("_best"))
    return best.select(
        *keys,
        F.col("_best._version").alias("version"),
        F.col("_best._live").alias("live"),
        *[F.col(f"_best._p{i}").alias(c) for i, c in enumerate(payload)],
    )
