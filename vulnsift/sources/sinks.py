"""Sinks and readers of built sets.

Sets are written once, partitioned by ``split`` so that reading the training split
prunes partitions; generated records are appended (no whole-file rewrite per record).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_split_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one directory per split."""
    df.write.mode(mode).partitionBy("split").json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Generated records appended as JSON (the streaming form is X01)."""
    df.write.mode("append").json(path)


def write_evaluation(metrics: DataFrame, per_answer: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Two tables, metrics and per-answer results."""
    metrics.write.mode(mode).parquet(f"{path.rstrip('/')}/metrics")
    per_answer.write.mode(mode).parquet(f"{path.rstrip('/')}/results")


def append_run_summary(summary: DataFrame, path: str) -> None:
    """Run summaries appended with a timestamp."""
    summary.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_train_split(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """A built set's training split (partition-pruned read)."""
    return spark.read.parquet(path).where(F.col("split") == split)
