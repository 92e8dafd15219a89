"""Intermediate tables in the folder that all executors share.

A staged table cuts lineage like a checkpoint, survives lost executors and,
being Parquet, still lets later reads prune columns.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="corpusloom-")


def staging_folder(spark: SparkSession) -> str | None:
    """The session's `spark.checkpoint.dir`; a local folder in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    return None


def fresh_path(spark: SparkSession, name: str) -> str:
    folder = staging_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back.  Without a folder that all executors
    share this is an error: what is derived from a row's place would differ
    between two evaluations of the rows."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
