"""The incremental counterparts: scored rows as they arrive, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as a stream; event time is a timestamp with zone, as watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_means(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    """(start, key, n, mean) by tumbling windows; works on streams and on tables alike."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", window), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """(start, end, key, n): runs of events of a key with no gap as long as ``gap``."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process all that has arrived, to Parquet, and stop; the checkpoint lets a later call go on from there."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_complete(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process all that has arrived and stop; ``out`` holds the complete result after the last batch."""
    replace = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
