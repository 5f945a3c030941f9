"""Streams: late results against current tickets, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.dag import accept_results


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event files of a folder as a stream with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Counts per window and group; rows later than the watermark are left out, state before it is dropped."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", lateness)
    out = rows.groupBy(F.window("_t", width).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n")


def current_results(results: DataFrame, tickets: DataFrame) -> DataFrame:
    """A stream of build results without late, foreign and stale ones: a stream-static semi-join on the current tickets."""
    return accept_results(results, tickets)
