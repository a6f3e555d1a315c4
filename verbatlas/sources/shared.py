"""Intermediate tables in the folder that the driver and every executor share."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="verbatlas-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a folder of our own on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.conf.get("spark.master", "") or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own_folder()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a later job re-reads the table instead of recomputing it, and a lost
    executor costs only the tasks that it ran. Columnar files also let later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/verbatlas/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a ``stash`` that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/verbatlas/" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
