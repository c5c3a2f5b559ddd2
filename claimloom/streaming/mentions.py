"""Citation mentions of spans as they arrive.

Mentions need one span only and keep no state, so the batch operator runs as it
is on a stream; spans delivered again within ``late`` are dropped by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.citations import mentions


def span_stream(spark: SparkSession, folder: str, late: str = "7 days") -> DataFrame:
    """Spans of the Parquet files that appear in ``folder``, once each."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return rows.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["span_id"])


def mention_stream(spark: SparkSession, folder: str, late: str = "7 days") -> DataFrame:
    return mentions(span_stream(spark, folder, late))
