"""Results that grow while images arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import carve


def carve_stream(images: DataFrame, out: str, checkpoint: str, specs=carve.SPECS) -> StreamingQuery:
    """Carve images as they arrive and append the rows; a restart goes on from the checkpoint."""
    return carve.carve(images, specs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window and type; rows later than ``late`` are dropped by the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
