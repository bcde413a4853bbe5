"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ASCII_SPACE = b" \t\n\x0b\x0c\r"


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A session in one process (tests) that names none gets a folder under /tmp; a cluster has to name one.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    folder = named or f"file:///tmp/cueloom-{os.getuid()}"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path for a table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/cueloom/{what}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``scratch_path`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from now on: ten thousand whole documents, Spark's
    default, are more than a Python worker should hold. A smaller setting is left as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
