"""Documents in compressed blocks, and how many documents hold each hash: shared by the two exact duplicate searches.

A block is one row with the texts of a few megabytes of documents. Hashes of a block leave it as one blob for each
bucket (a range of hash values), already counted within the block, so a hash that a third of all documents hold costs
one entry for each block. Each bucket answers every blob with one byte per entry: the class of the hash's document
frequency. The blobs never outnumber the hashes themselves, whatever the numbers of blocks and buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.common import keep_table, rows_of

#: Bytes of text in a block (a longer document is a block of its own).
BLOCK_BYTES = 4 << 20
#: Stands for a null id inside blocks.
NO_ID = -(1 << 63)

BLOCK = "block long, ids binary, sizes binary, body binary"
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])


@lru_cache(maxsize=4)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeeze(data: bytes, level: int = 1) -> bytes:
    return _compressor(level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _decompressor().decompress(data) if data else b""


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Ascending uint32 values as byte planes of their differences, compressed."""
    step = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return squeeze(step.view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint32)


def pack_blocks(rows: DataFrame, label: str) -> DataFrame:
    """Rows (doc_id, bytes of the text) as a kept table of blocks. Rows stay in their partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def block():
            sizes = np.array([len(t) for t in texts], dtype="<i8")
            return rows_of(_BLOCK, [[number], [np.array(ids, dtype="<i8").tobytes()], [sizes.tobytes()], [squeeze(b"".join(texts), 3)]])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and size + len(text) > BLOCK_BYTES:
                    yield block()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(NO_ID if doc is None else doc)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    return keep_table(rows.mapInArrow(run, BLOCK), label)


def open_block(ids: bytes, sizes: bytes, body: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a block."""
    data, ends = unsqueeze(body), np.cumsum(np.frombuffer(sizes, dtype="<i8"))
    starts = np.concatenate([[0], ends[:-1]])
    return np.frombuffer(ids, dtype="<i8"), [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def bucket_bits(blocks: DataFrame, per_bucket: int) -> int:
    """Bits of the bucket number: a bucket takes what about `per_bucket` blocks hold."""
    return max(5, (max(1, blocks.count() // per_bucket) - 1).bit_length())


def hash_keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits + 32 bits of 64-bit hashes: bucket number and a remainder of 32 bits."""
    return hashes >> np.uint64(32 - bits)


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """0 for hashes of one document; else one byte that grows with the number of documents."""
    return np.where(counts < 2, 0, np.minimum(255, 4 * np.log2(np.maximum(counts, 1)) - 3)).astype(np.uint8)


def document_classes(blocks: DataFrame, hashes_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """block, classes: for each block the frequency classes of its keys, as (bucket, blob) in bucket order; a blob holds one
    byte for each distinct key in ascending order. `hashes_of` gives the hashes of texts, distinct within each text. A fifth
    column of the blocks names the texts that count (positions)."""
    arrow = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, sizes, body, *chosen in zip(*(c.to_pylist() for c in batch.columns)):
                texts = open_block(ids, sizes, body)[1]
                keys, counts = np.unique(hash_keys(hashes_of([texts[i] for i in chosen[0]] if chosen else texts)[0], bits), return_counts=True)
                bucket = (keys >> np.uint64(32)).astype(np.int32)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
                rest, few = keys.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
                parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]))
                yield rows_of(arrow, [bucket[cuts], [block] * len(parts), [squeeze_sorted(rest[a:b]) for a, b in parts],
                                      [squeeze(few[a:b].tobytes()) for a, b in parts]])

    def answer(table: pa.Table) -> pa.Table:
        keys = [unsqueeze_sorted(k) for k in table["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(unsqueeze(c), dtype=np.uint8) for c in table["counts"].to_pylist()])
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        classes = frequency_class(np.bincount(where, weights=counts))[where]
        ends = np.cumsum([len(k) for k in keys])
        blobs = [squeeze(classes[e - len(k):e].tobytes()) for k, e in zip(keys, ends.tolist())]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "classes": pa.array(blobs, pa.binary())})

    sent = blocks.mapInArrow(emit, "bucket int, block long, keys binary, counts binary")
    back = sent.groupBy("bucket").applyInArrow(answer, "block long, bucket int, classes binary")
    return back.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "classes"))).alias("classes"))


def class_of(keys: np.ndarray, classes: list) -> np.ndarray:
    """Frequency class of the hash keys of a block, given the distinct sorted keys' blobs of `document_classes`."""
    answers = np.frombuffer(b"".join(unsqueeze(c["classes"]) for c in classes or []), dtype=np.uint8)
    order, out = np.argsort(keys), np.zeros(len(keys), dtype=np.uint8)
    if len(keys):
        ordered = keys[order]
        out[order] = answers[np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])]
    return out
