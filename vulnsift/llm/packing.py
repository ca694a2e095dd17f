"""Packing: documents cut and packed into token windows by best-fit decreasing.

Every task packs the documents of its own input partition, so no row is shuffled and nothing passes
through the driver. A document longer than the window is first cut into full windows; what remains of
each document is placed, longest first, into the open window with the least room that still fits, found
with a segment tree indexed by remaining capacity.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vulnsift.llm.common import rows_of, text_slices

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_ARROW = pa.schema([(c, pa.int64()) for c in
                    ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

#: Documents whose remainders are packed together; a task with more packs them in such groups.
GROUP_DOCS = 50_000


class CapacityTree:
    """Segment tree over remaining capacities 0..window: a node counts the open windows below it."""

    def __init__(self, window: int):
        self.base = 1
        while self.base <= window:
            self.base *= 2
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        node = self.base + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the least capacity >= need, if any."""
        count, node = self.count, self.base + need
        while not count[node]:
            while node & 1:           # right child: nothing more to the right below its parent
                node >>= 1
            if not node:
                return None
            node += 1                 # the subtree just to the right
            while node < self.base and count[node]:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.base
        which = self.open[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, which


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window number and offset of each length (all in 1..window), and how many windows there are."""
    tree, n = CapacityTree(window), 0
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        found = tree.take(need)
        if found is None:
            capacity, which, n = window, n, n + 1
        else:
            capacity, which = found
        where[i], offset[i] = which, window - capacity
        if capacity > need:
            tree.add(capacity - need, which)
    return where, offset, n


#: The added tokens of byte_bpe_50k.json, which the rank file leaves out. They are one id wherever a text holds them.
ADDED = {"<|endoftext|>": 50256}

_ENCODERS: dict = {}


def encoder(vocabulary: str, pattern: str):
    """Byte-level BPE over a rank file, one per worker process. `pattern` splits texts into words."""
    import tiktoken

    if vocabulary not in _ENCODERS:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)
    return _ENCODERS[vocabulary]


def ids_of(text: str, enc, whole: str) -> np.ndarray:
    """Ids of a text. The pattern's engine gives up on very long runs of white space: such a text goes to the library and
    tokenizer file `whole` that the ranks stand for."""
    try:
        return enc.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        from tokenizers import Tokenizer

        if whole not in _ENCODERS:
            _ENCODERS[whole] = Tokenizer.from_file(whole)
        return np.array(_ENCODERS[whole].encode(text, add_special_tokens=False).ids, np.uint32)


def pack(docs: DataFrame, vocabulary: str, pattern: str, whole: str, window: int = 1024, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document: where it starts in the document's ids, where it lies in which sequence.

    `vocabulary` is the rank file, `whole` the tokenizer file with the same ids.
    A document's ids are its text's token ids and then `end_id`; a null or empty text is the end id alone. An added
    token written out in a text is that token's id.
    Full windows are cut from the front; the remainder is packed by best-fit decreasing with those of the
    same input partition. Sequence ids are the partition number times 2^32 plus a running number, so a rerun
    task gives the same rows. Repeated rows and rows with a null id are packed like any other row (the id
    stays null); an empty table gives no rows. Other columns of `docs` are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        first = TaskContext.get().partitionId() << 32
        used = 0
        full: list[tuple] = []
        rest: list[tuple] = []

        def finish() -> pa.RecordBatch:
            nonlocal used, full, rest
            where, offset, n = best_fit_decreasing([r[2] for r in rest], window)
            rows = full + [(*r, first + used + w, o) for r, w, o in zip(rest, where, offset)]
            used, full, rest = used + n, [], []
            return rows_of(_ARROW, list(zip(*rows)) if rows else [[]] * len(_ARROW))

        for batch in batches:
            for doc, text in (pair for part in text_slices(batch) for pair in zip(*part)):
                ids = np.append(ids_of(text, enc, whole), np.uint32(end_id)).astype("<u4", copy=False)
                total = len(ids)
                for start in range(0, total, window):
                    part = ids[start:start + window]
                    piece = (doc, start, len(part), zlib.crc32(part), total)
                    if len(part) == window:
                        full.append((*piece, first + used, 0))
                        used += 1
                    else:
                        rest.append(piece)
                if len(rest) >= GROUP_DOCS or len(full) >= GROUP_DOCS:
                    yield finish()
        yield finish()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, SCHEMA)
