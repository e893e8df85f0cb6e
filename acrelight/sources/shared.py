"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session whose master is local may lack the setting; it then gets a
    temporary folder, since its one machine is driver and executor at once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if getattr(context, "_acrelight_folder", None) is None:
        context._acrelight_folder = tempfile.mkdtemp(prefix="acrelight-")
    return context._acrelight_folder


def fresh_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/acrelight-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Paths that were staged within the ``stage_alone`` that runs, if one does.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The returned frame has no lineage: lost executors cost a re-read, not a
    recomputation, and every later use sees the same rows.
    """
    path = fresh_path(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The staged result of ``make``; tables that it staged on its way are removed, so none of them may be used elsewhere."""
    outer = _passing.get()
    token = _passing.set(own := [])
    try:
        result = stage(make())
    finally:
        _passing.reset(token)
    if outer is not None:
        outer.append(own[-1])
    for path in own[:-1]:
        at = result.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(result.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    return result


def clear_staged(spark: SparkSession) -> bool:
    """Remove all tables that this application has staged; frames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/acrelight-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
