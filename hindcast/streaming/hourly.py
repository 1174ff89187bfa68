"""Events as a stream: hourly counts with a watermark, the rows an hourly panel grows by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows and mean value an hour and type; hours end when the watermark passes them."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return by.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("hour"), "event_type", "n", "mean_value")
