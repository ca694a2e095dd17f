"""A Bloom filter over pairs of 64-bit keys, built by Spark and of bounded size (J06 beyond the broadcast).

Every task sets bits in its own copy and emits the segments it touched; Spark ORs equal segments (`bitmap_or_agg`), and
only the finished bits, at most MOST_BITS whatever the input's size, go to the driver and out again. A key that
was put in is always found; others pass now and then, so what passes must still be joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for a key, the most of a whole filter (16 MB), and the bits of a segment (those of Spark's bitmaps).
BITS_A_KEY, MOST_BITS, SEGMENT = 16, 1 << 27, 1 << 15
PROBES = 4

_SEGMENTS = pa.schema([("segment", pa.int64()), ("bits", pa.binary())])


def places(k1: np.ndarray, k2: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bits (0..size-1, a power of two) that stand for each key."""
    shift = np.uint64(64 - (size.bit_length() - 1))
    a, b = k1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), k2.view(np.uint64) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b) * np.uint64(0xD6E8FEB86659FD93)) >> shift


def build(keys: DataFrame, n: int) -> np.ndarray:
    """Bits of a filter over the (k1, k2) rows of `keys`, of which there are about `n`."""
    size = SEGMENT
    while size < min(BITS_A_KEY * n, MOST_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for at in places(*(batch.column(i).to_numpy() for i in (0, 1)), size):
                bits[at] = True
        parts = np.packbits(bits.reshape(-1, SEGMENT), axis=1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([parts[i].tobytes() for i in used], pa.binary())], schema=_SEGMENTS)

    out = np.zeros((size // SEGMENT, SEGMENT // 8), np.uint8)
    parts = keys.select("k1", "k2").mapInArrow(run, "segment long, bits binary")
    for r in parts.groupBy("segment").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def holds(bits: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """True for every key that was put in, and for few others."""
    found = np.ones(len(k1), bool)
    for at in places(k1, k2, 8 * len(bits)):
        found &= (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return found
