"""X02, the live length and reward monitor: mean per run and window, and an alarm when it leaves its start behind.

Two chained stateful steps in append mode. A watermarked window aggregate closes the windows (late rows are dropped); its
few rows per run go to a keyed state that keeps the mean of the run's first window across batches and restarts, and gives a row for
every later window whose mean exceeds the factor times that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUN_EVENTS = "experiment string, stage string, ts timestamp, mean_length double, reward double"
ALARMS = "experiment string, stage string, window_start timestamp, mean_length double, mean_reward double, start_length double"


class StartKept(StatefulProcessor):
    """State of a run: the mean length of its first closed window."""

    def __init__(self, factor: float):
        self.factor = factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start = handle.getValueState("start", "mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        windows = pd.concat(list(rows)).sort_values("window_start")
        if not self.start.exists():
            self.start.update((float(windows["mean_length"].iloc[0]),))
        first = self.start.get()[0]
        over = windows[windows["mean_length"] > self.factor * first]
        yield pd.DataFrame({"experiment": key[0], "stage": key[1], "window_start": over["window_start"], "mean_length": over["mean_length"],
                            "mean_reward": over["mean_reward"], "start_length": first})

    def close(self) -> None:
        pass


def length_alarms(stream: DataFrame, window: str = "1 day", delay: str = "2 days", factor: float = 2.0) -> DataFrame:
    """Windows of a run whose mean length exceeds `factor` times that of the run's first window."""
    closed = (stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "experiment", "stage")
              .agg(F.avg("mean_length").alias("mean_length"), F.avg("reward").alias("mean_reward"))
              .select("experiment", "stage", F.col("w.start").alias("window_start"), "mean_length", "mean_reward"))
    return closed.groupBy("experiment", "stage").transformWithStateInPandas(StartKept(factor), ALARMS, "Append", "None")


def run_alarms(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, window: str = "1 day", delay: str = "2 days",
               factor: float = 2.0, files_per_batch: int = 1) -> None:
    """All files that are there, a few per batch, into a parquet sink; state and progress live in the checkpoint."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)  # keyed state needs it; a query keeps what it was started with
    try:
        src = spark.readStream.schema(RUN_EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
        q = length_alarms(src, window, delay, factor).writeStream.format("parquet").outputMode("append") \
            .option("path", sink_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
