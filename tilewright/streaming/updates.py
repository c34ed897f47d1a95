"""Change files as a stream: one file a batch, each applied once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.overlay import newest_changes
from tilewright.plans.lineage import shared_dir
from tilewright.sources.snapshot import file_list, update_snapshot


def stream_changes(spark: SparkSession, path: str, schema: str, *, files_a_batch: int = 1) -> DataFrame:
    """Rows of Parquet change files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Hand all batches that are there to ``apply``, in order; a later run goes on after them."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keep_newest(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """The newest change of each (type, id) over all files of a folder, maintained by batch.

    Each batch is folded to its own newest rows and written under the batch's number, so a batch that runs again replaces
    itself; folding the batches' rows gives the result, in whatever order they came.
    """
    root = f"{shared_dir(spark)}/tilewright/stream-{uuid.uuid4().hex}"
    batches: list[int] = []

    def apply(batch: DataFrame, number: int) -> None:
        batches.append(number)
        newest_changes(batch).write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    run_available(stream_changes(spark, path, schema), f"{root}/state", apply)
    if not batches:  # a folder without files
        return spark.createDataFrame([], schema).select(*columns)
    return newest_changes(spark.read.parquet(f"{root}/rows").drop("batch")).select(*columns)


def follow(spark: SparkSession, path: str, schema: str, root: str, end_date_of: Callable[[int], int]) -> None:
    """Add a delta to the dataset in ``root`` for each new change file. A batch whose number the file list has already is left out."""

    def apply(batch: DataFrame, number: int) -> None:
        if not any(f.get("State") == number + 1 for f in file_list(root)):
            update_snapshot(batch.withColumn("file_idx", F.coalesce("file_idx", F.lit(0))), root, end_date_of(number), number + 1)

    run_available(stream_changes(spark, path, schema), f"{root}/stream", apply)
