"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_paths: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one where it is unset.

    On a cluster a machine-local folder would lose data with its executor, so an unset value is an error there.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        holder = tempfile.TemporaryDirectory(prefix="tilewright-")
        atexit.register(holder.cleanup)
        _own_dirs[app] = "file://" + holder.name
    return _own_dirs[app]


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result does not depend on any executor, its size is known to the planner, and ids given inside ``df``
    stay the same whenever it is read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = (weakref.ref(table), path)
    return table


def forget(table: DataFrame) -> None:
    """Delete a table that ``cut`` gave, once nothing that is still to be computed reads it."""
    known = _paths.pop(id(table), None)
    if known is None or known[0]() is not table:
        return
    jvm = table.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(known[1])
    path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def task_count(spark: SparkSession, rows: int, rows_a_task: int) -> int:
    """Number of partitions for a Python stage over ``rows`` rows: no fewer than the cores, no task above the given rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_a_task))
