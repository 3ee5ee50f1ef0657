"""Cutting lineage between the steps of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder of spark.checkpoint.dir; in a temporary one
    only where none is set and the session runs on this machine alone (tests)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-tidewatch-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one in spark.checkpoint.dir, for tables between two steps."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tidewatch-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/steps/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder; `discard` deletes it."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.written_to = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)
