"""The row-wise operators over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import importing, preflight


def arriving(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def preflight_stream(files: DataFrame) -> DataFrame:
    """Preflight records of a stream of files; the same functions as in batch, and stateless."""
    return preflight.records(importing.with_paths(files).filter("error is null"))


def first_arrivals(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first file of each path among those that arrive within the delay (columns bundle_id, path, arrived)."""
    return files.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["bundle_id", "path"])


def hourly_totals(recs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Files, bytes and high risks by hour of arrival."""
    hours = recs.withWatermark("arrived", delay).groupBy(F.window("arrived", "1 hour"), "bundle_id")
    return hours.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("risk_level") == "high").alias("high"))
