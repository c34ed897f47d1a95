"""Per-key aggregates of data in which a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch of frequent keys keeps for each task, and gives in the end.
TRACKED, MOST = 8192, 1024


def rows_and_heavy_keys(df: DataFrame, key: str, *, share: float = 0.005) -> tuple[int, list]:
    """Number of rows, and the keys that may hold at least ``share`` of them (null aside): at most MOST.

    One pass that reads only the key: a sketch of frequent keys is kept by each task and merged, so what comes to the driver
    doesn't grow with the data. The keys only decide what gets salted, never a result.
    """
    sketch = F.expr(f"approx_top_k(k, {MOST}, {TRACKED})")
    row = df.select(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).first()
    least = max(2.0, share * row["n"])
    return row["n"], [t["item"] for t in row["top"] or [] if t["item"] is not None and t["count"] >= least]


def heavy_keys(df: DataFrame, key: str, *, share: float = 0.005) -> list:
    return rows_and_heavy_keys(df, key, share=share)[1]


def salted_totals(df: DataFrame, key: str, value: str, *, salts: int = 32, heavy: list | None = None) -> DataFrame:
    """(key, n, total) for every key: its number of rows and the sum of ``value``.

    Null is a key of its own. Null values add nothing; a key with only null values has total null. The sum is a
    decimal(38,0), so it can't overflow. Copied rows count as often as they occur. Extra columns are ignored.

    Two stages: rows of heavy keys get a random salt, partial results are made per key and salt, and the partial
    results are merged per key. Each stage also folds rows before its shuffle.
    """
    if heavy is None:
        heavy = heavy_keys(df, key)
    salt = F.when(F.col(key).isin(heavy) | F.col(key).isNull() if heavy else F.col(key).isNull(), F.floor(F.rand(17) * salts).cast("int")).otherwise(0)
    parts = df.select(F.col(key).alias("k"), F.col(value).cast("decimal(38,0)").alias("v"), salt.alias("salt")).groupBy("k", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    merged = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return merged.select(F.col("k").alias(key), "n", F.col("total").cast("decimal(38,0)").alias("total"))


def keys_above_share(df: DataFrame, key: str, value: str, share_percent: int) -> DataFrame:
    """Totals of the keys that hold at least ``share_percent`` % of all rows of ``df`` as stored."""
    rows, heavy = rows_and_heavy_keys(df, key)
    return salted_totals(df, key, value, heavy=heavy).where(F.col("n") * 100 >= F.lit(rows) * share_percent)
