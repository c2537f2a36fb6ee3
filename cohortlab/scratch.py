"""Intermediate tables that have to outlive the executors which made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` names it. Only a local session without that
    setting gets a folder of its own; on a cluster a missing setting is an
    error, because a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlab-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet and continue from the files.

    Unlike a cache it survives lost executors, and unlike an RDD checkpoint the
    readers keep column pruning and filter pushdown.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_path = path
    return stored


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from ``materialize`` that nothing reads any more.

    Shuffle files of jobs that are over go when the driver collects its garbage, which it is asked to do.
    """
    for table in tables:
        path, jvm = table.stored_path, table.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()
