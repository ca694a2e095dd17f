"""Structured Streaming operators.

X01: completions arrive as files; duplicates from retries are dropped within a watermark
on the arrival time, accepted traces (P15) are appended to a parquet sink. The sink plus
the query checkpoint give exactly-once output across restarts and lost executors.

X02: a live monitor of mean value per event type and tumbling window; the watermark
bounds the state and drops rows later than the allowed delay. In append mode a window
is emitted once the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnsift.operators.filters import has_think

COMPLETION_EVENTS = T.StructType([
    T.StructField("completion_id", T.LongType()),
    T.StructField("contract_id", T.LongType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("arrived_at", T.TimestampType()),
])

MONITOR_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def accepted_traces_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """X01 transformation: watermark dedup on completion_id, then P15 acceptance."""
    return (stream.withWatermark("arrived_at", delay)
            .dropDuplicatesWithinWatermark(["completion_id"])
            .where(has_think("text")))


def run_append(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, delay: str = "1 hour") -> None:
    """Process every available file once (availableNow) into the parquet sink."""
    src = spark.readStream.schema(COMPLETION_EVENTS).json(source_dir)
    q = (accepted_traces_stream(src, delay).writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def monitor_stream(stream: DataFrame, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """X02 transformation: tumbling-window mean and count per event type under a watermark."""
    return (stream.withWatermark("ts", delay)
            .groupBy(F.window("ts", window).alias("w"), "event_type")
            .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "event_type", "mean_value", "n"))


def run_monitor(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                window: str = "1 day", delay: str = "2 days") -> None:
    """Emit closed windows (append mode) into the parquet sink."""
    src = spark.readStream.schema(MONITOR_EVENTS).parquet(source_dir)
    q = (monitor_stream(src, window, delay).writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
