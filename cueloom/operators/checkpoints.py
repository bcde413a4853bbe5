"""Intermediate tables of jobs that go round by round."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of ``spark.checkpoint.dir``, without its lineage, so that a lost
    executor costs one round. A session in one process that names no folder gets one under /tmp; a
    cluster has to name one that driver and executors share."""
    spark = df.sparkSession
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named or f"file:///tmp/cueloom-{os.getuid()}")
    return df.checkpoint(eager=True)
