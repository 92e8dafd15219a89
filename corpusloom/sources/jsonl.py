"""Datasets as JSON lines: messages, metadata, and a sample to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.schemas import METADATA, TRAINING_RECORD

SAMPLE_SIZE = 10


def read_jsonl(spark: SparkSession, path: str, schema=TRAINING_RECORD) -> DataFrame:
    """A malformed line is an error, as is usual for training data."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_messages(dataset: DataFrame, path: str, with_id: bool = True) -> None:
    columns = ["example_id"] if with_id else []
    dataset.select(*columns, "messages").write.json(path)


def write_metadata(dataset: DataFrame, path: str, with_id: bool = True) -> None:
    """Absent values are left out.  `example_id` ties a line to its messages."""
    columns = ["example_id"] if with_id else []
    dataset.select(*columns, "metadata.*").write.json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType([StructField("example_id", StringType()), *METADATA.fields])
    rows = read_jsonl(spark, path, schema)
    names = [f.name for f in METADATA.fields]
    return rows.select("example_id", F.struct(*names).alias("metadata"))


def rejoin_metadata(messages: DataFrame, metadata: DataFrame) -> DataFrame:
    """Put messages and metadata together again by their id."""
    return messages.join(metadata, "example_id")


def write_sample(dataset: DataFrame, path: str, order: list[str | Column],
                 n: int = SAMPLE_SIZE) -> None:
    """The first n records as one pretty-printed JSON array (n rows, one file)."""
    first = dataset.orderBy(*order).limit(n).select(F.struct("messages", "metadata").alias("r"))
    text = first.agg(F.to_json(F.collect_list("r"), {"pretty": "true"}).alias("value"))
    text.coalesce(1).write.text(path)
