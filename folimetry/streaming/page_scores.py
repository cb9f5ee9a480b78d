"""Arriving page scores in the same aggregates as at rest: an extension, nothing here is part of a batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folimetry.operators.statistics import run_means


def read_scores(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def stream_run_means(scores: DataFrame, keys: list[str], name: str, checkpoint: str) -> StreamingQuery:
    """Keep each run's mean score and pages up to date in a memory table."""
    writer = run_means(scores, keys).writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).start()
