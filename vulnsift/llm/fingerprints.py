"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes marks boundaries; normalised chunking makes them harder to accept before
the average length and easier after it. A fingerprint is the set of chunk digests with their total lengths,
and likeness is the share of the shorter fingerprint's bytes whose chunks the other one holds too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.common import rows_of

#: Least, average and greatest chunk length in bytes; bits of the hash that must be zero before and after the average.
MIN_CHUNK, AVG_CHUNK, MAX_CHUNK, HARD_BITS, EASY_BITS = 16, 64, 256, 7, 4
REACH = 32          # bytes that a gear hash of 32 bits depends on
PIECE = 1 << 22     # bytes hashed at a time

GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of possible chunks (position after the byte) by the easy mask, and which of them pass the hard one.
    Long data is hashed in pieces that carry the bytes a hash depends on."""
    buf = np.frombuffer(data, dtype=np.uint8)
    easy, hard = [], []
    for a in range(0, len(buf), PIECE):
        lo = max(0, a - REACH)
        h = GEAR[buf[lo:a + PIECE]]
        step = 1
        while step < REACH:
            nxt = h.copy()
            nxt[step:] += h[:-step] << np.uint32(step)
            h, step = nxt, 2 * step
        h = h[a - lo:]
        at = np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0)
        easy.append(at + a + 1)
        hard.append(h[at] >> np.uint32(32 - HARD_BITS) == 0)
    return (np.concatenate(easy), np.concatenate(hard)) if easy else (np.zeros(0, np.int64), np.zeros(0, bool))


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks, the last one the end of the data."""
    ends, hard = boundaries(data)
    out, start, n = [], 0, len(data)
    for end, strong in zip(ends.tolist(), hard.tolist()):
        while end - start > MAX_CHUNK:
            start += MAX_CHUNK
            out.append(start)
        size = end - start
        if size >= MIN_CHUNK and (strong or size >= AVG_CHUNK):
            out.append(end)
            start = end
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunk_weights(text: str) -> dict[str, int]:
    """Digest of each distinct chunk -> bytes it covers in the text."""
    data, start, out = text.encode("utf-8", "surrogatepass"), 0, {}
    for end in chunk_ends(data):
        key = f"{xxhash.xxh3_64_intdigest(data[start:end]) >> 16:012x}"
        out[key] = out.get(key, 0) + end - start
        start = end
    return out


def fingerprint(weights: dict[str, int]) -> str:
    return ",".join(f"{k}:{w}" for k, w in sorted(weights.items()))


def weights_of(mark: str) -> dict[str, int]:
    return {k: int(w) for k, w in (x.split(":") for x in mark.split(","))} if mark else {}


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Weighted containment: shared bytes over the bytes of the shorter one. Two empty fingerprints are alike (1),
    an empty one and another are not (0)."""
    if not a or not b:
        return float(a == b)
    shared = sum(min(w, b[k]) for k, w in a.items() if k in b)
    return shared / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])
_SENT = pa.schema([("run", pa.int32()), ("lent", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("body", pa.binary())])

#: Runs of ids that are put in order one by one; a fixed number, so the list of their first ids stays small.
RUNS = 2048


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness: one row per document.

    The edit takes from the next document by ascending id (after the last: the first), so the documents must be
    put in order: they are dealt into runs of ids between quantiles of the id column and ordered within each. The
    first document of a run is also lent to the run before it. Texts travel compressed, once. Rows with equal ids
    follow each other by a hash of their text; a null id comes before all others; null texts are empty. An empty
    table gives no rows, a single document follows itself. Other columns are not read.
    """
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))
    null_id = -(1 << 63)
    # actual ids: the first of each run; `runs` of them at most, whatever the number of documents
    ids = rows.agg(F.min("doc_id").alias("least"),
                   F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], 20 * runs).alias("cuts")).first()
    if ids is None or ids["least"] is None:
        cuts = np.zeros(0, dtype=np.int64)
    else:
        cuts = np.array(sorted({ids["least"], *ids["cuts"]}), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to their run; the first id of a run also to the run before (of the first run: to the last)."""
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out: list[tuple] = []
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            run = np.searchsorted(cuts, ids, side="right") - 1
            for i, r, text in zip(ids.tolist(), run.tolist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8")
                row = (i, xxhash.xxh64_intdigest(data) - (1 << 63), zip_.compress(data))
                out.append((r, 0, *row))
                if i == cuts[r]:
                    out.append(((r - 1) % len(cuts), 1, *row))
            yield rows_of(_SENT, list(zip(*out)) if out else [[]] * len(_SENT))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by run, own ones in order and then lent ones: each own row with the one that comes after it."""
        unzip = zstandard.ZstdDecompressor()
        held = None  # run, id, text, weights of the row whose follower has not come yet
        for batch in batches:
            out = []
            for run, lent, doc, body in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if lent and (held is None or held[0] != run):
                    continue  # not the first of the lent rows, or a run without rows of its own
                text = unzip.decompress(body).decode("utf-8") if body else ""
                weights = chunk_weights(text)
                if held is not None:
                    _, before, old, own = held
                    new = edited(old, text)
                    marks = chunk_weights(new)
                    out.append((None if before == null_id else before, len(old), hashlib.sha256(new.encode("utf-8")).hexdigest(),
                                fingerprint(own), fingerprint(marks), likeness(own, marks), likeness(own, weights)))
                held = None if lent else (run, doc, text, weights)
            yield rows_of(_ARROW, list(zip(*out)) if out else [[]] * len(_ARROW))

    sent = rows.mapInArrow(deal, "run int, lent int, doc_id long, tie long, body binary")
    return sent.repartition("run").sortWithinPartitions("run", "lent", "doc_id", "tie").mapInArrow(follow, SCHEMA)
