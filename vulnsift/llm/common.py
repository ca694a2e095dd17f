"""Small helpers shared by the operators: shared-folder tables, Arrow batches, the train/held-out fold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsift.session import checkpoint_dir, read_table, ship_package

__all__ = ["keep_table", "read_table", "held_out", "rows_of", "text_slices", "ship_package"]


def keep_table(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet under the shared checkpoint folder and read it back: cuts the lineage,
    survives lost executors, and lets several later passes read the same rows. The shuffle files behind
    it are freed once the table is written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of each query run in here when that query ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Keep a small intermediate result on the executors' disks, until `release_held`. What a lost executor held is
    computed again from its lineage, which is that of deterministic operators on tables."""
    _HELD.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def release_held(spark: SparkSession) -> None:
    """Free what earlier calls held. Results that still refer to it stay right: it is computed again."""
    for df in _HELD:
        if df.sparkSession.sparkContext is spark.sparkContext:
            df.unpersist()
    _HELD.clear()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded(batch: pa.RecordBatch, column: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts in `column` take about `limit` bytes (a longer text comes alone). Arrow's
    free memory goes back to the system after each batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop
    pa.default_memory_pool().release_unused()


def rows_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """One Arrow batch from column lists in schema order."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def text_slices(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) of a batch of (id, text) in runs of about `limit` characters, to bound numpy temporaries.
    A single longer text comes alone; callers that allocate per character walk it in pieces."""
    for part in bounded(batch, 1, limit):
        yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def code_points(text: str) -> np.ndarray:
    """Code points of a text as uint32 (lone surrogates kept as they are)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    out = np.sort(values)
    return out[np.r_[True, out[1:] != out[:-1]]] if len(out) else out
