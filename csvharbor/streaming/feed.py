"""The audit log as a stream: running counts per action, severity and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def audit_stream(spark: SparkSession, directory: str, schema: T.StructType, max_files: int = 1_000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(directory)


def running_counts(stream: DataFrame, time: str, by: list[str], period: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Entries per period and group; a period is final once entries ``lateness`` newer have come."""
    late = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    counted = late.groupBy(F.window(time, period).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("period_start"), *by, "n")
