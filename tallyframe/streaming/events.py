"""Streams of records: gates without state, dedup within a watermark, windowed counts of late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators.gates import Gate, first_reason


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """The files of a Parquet path as a stream; a path of a single file works too."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def gated(stream: DataFrame, gates: list[Gate]) -> DataFrame:
    """The stream with `reason`: null for rows that pass. No state, so it scales with its input alone."""
    return stream.withColumn("reason", first_reason(gates))


def dedup_within(stream: DataFrame, at: str, delay: str, text: str = "text") -> DataFrame:
    """The first row of each normalised text within the watermark's delay."""
    keyed = stream.withColumn("key", F.sha2(F.encode(T.normalize(F.col(text)), "UTF-8"), 256))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["key"])


def windowed_counts(stream: DataFrame, at: str, label: str, width: str, delay: str) -> DataFrame:
    """Rows by window and label, each window closed once the watermark has passed it."""
    counts = stream.withWatermark(at, delay).groupBy(F.window(at, width), label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), label, "n")
