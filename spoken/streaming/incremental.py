"""Incremental normalization of a growing folder of Parquet documents, each file once."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.pipeline import normalize


def normalize_new(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Takes what has come since the last call, writes it normalized, and returns. The checkpoint remembers files already taken."""
    schema = spark.read.parquet(source).schema
    stream = normalize(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
