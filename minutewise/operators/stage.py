"""Cutting the lineage of a table that several plans read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder in spark.checkpoint.dir.

    A folder of its own is made only if none is set and all runs on one machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that isn't there yet, below checkpoint_folder()."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The table, computed once and written to checkpoint_folder()."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
