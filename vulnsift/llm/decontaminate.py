"""Benchmark decontamination: q-gram counting in diagonal bands, then banded alignment.

Texts are compared lower-cased with white space runs as one blank. A passage within e edits of an item of m
characters shares at least m - q + 1 - q*e q-grams with it, and the diagonals (place in the text less place in the
item) of these lie within 2e + 1 of each other. So the shared q-grams are counted in overlapping bands of
diagonals, regions that reach the bound are kept, and each is verified by an alignment that fills only its band.
Documents stay where they lie; the items are the query set, sent in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.common import bounded, code_points, rows_of, text_slices

#: Edits allowed as a share of an item's characters, and q for items long enough for it, longest first.
EDIT_SHARE, Q_LONG, Q_SHORT = 0.1, 8, 4
#: Items of fewer characters are found verbatim only: with edits they would match ordinary prose.
MIN_ITEM = 32
#: Characters of items sent with one pass over the documents, and characters of a document walked at a time.
BLOCK_CHARS, PIECE = 4_000_000, 1_000_000
TABLE_BITS = 22

SCHEMA = "doc_id long, item_id long, start long, end long, distance long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64())])


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text, lower case, white space runs as one blank; and the original place of each."""
    low = text.lower()
    if len(low) != len(text):  # a character that grows when lower-cased keeps its first part only
        low = "".join(c.lower()[0] for c in text)
    codes = code_points(low)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0)
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    out = codes[at].copy()
    out[space[at]] = 32
    return out, at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    h, step = codes * np.uint32(0x9E3779B1), 1
    while step < q:  # q is a power of two: each step joins two neighbours
        h = (h[:-step] ^ (h[:-step] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + (h[step:] ^ (h[step:] >> np.uint32(13)))
        step *= 2
    return (h[:n] ^ (h[:n] >> np.uint32(16))) * np.uint32(0xC2B2AE35)


@dataclass
class Index:
    """Postings of the items' q-grams for one q: sorted hashes, item and place of each, and a table to pass by."""

    q: int
    items: list            # (item_id, codes, edits)
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    least: np.ndarray      # shared q-grams that a region needs, by item
    width: np.ndarray      # 2e + 1, by item
    overlap: int           # of pieces: twice the longest item and its edits


@dataclass
class Short:
    """Items of under MIN_ITEM characters and one length, found verbatim on word borders."""

    length: int
    items: dict            # characters -> item_ids
    hashes: np.ndarray     # sorted


def _windows(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters from each place on, for any n."""
    h = np.zeros(len(codes) - n + 1, dtype=np.uint32)
    for i in range(n):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[i:len(codes) - n + 1 + i]
    return h


def _word(c: int) -> bool:
    return c == 95 or chr(c).isalnum()


def short_matches(short: Short, codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(item_id, place) of the items in `codes`, with no word going on at either end."""
    n = short.length
    if len(codes) < n:
        return
    h = _windows(codes, n)
    near = short.hashes[np.minimum(np.searchsorted(short.hashes, h), len(short.hashes) - 1)]
    for p in np.flatnonzero(near == h).tolist():
        part = codes[p:p + n]
        ids = short.items.get(part.tobytes())
        if ids and not (p > 0 and _word(int(part[0])) and _word(int(codes[p - 1]))) \
                and not (p + n < len(codes) and _word(int(part[-1])) and _word(int(codes[p + n]))):
            for i in ids:
                yield i, p


def build(items: list[tuple[int, str]]) -> list[Index | Short]:
    groups: dict[int, list] = {}
    small: dict[int, dict] = {}
    for item_id, text in items:
        codes = normalised((text or "").strip())[0]
        if len(codes) >= MIN_ITEM:
            e = int(EDIT_SHARE * len(codes))
            q = next(q for q in (Q_LONG, Q_SHORT, 1) if q == 1 or len(codes) - q + 1 - q * e > q)
            groups.setdefault(q, []).append((item_id, codes, e))
        elif len(codes):
            small.setdefault(len(codes), {}).setdefault(codes.tobytes(), []).append(item_id)
    out = [Short(n, found, np.sort(np.concatenate([_windows(np.frombuffer(k, dtype=np.uint32), n) for k in found])))
           for n, found in small.items()]
    for q, found in groups.items():
        hashes = [grams(c, q) for _, c, _ in found]
        h = np.concatenate(hashes)
        item = np.repeat(np.arange(len(found)), [len(x) for x in hashes])
        place = np.concatenate([np.arange(len(x)) for x in hashes])
        order = np.argsort(h, kind="stable")
        table = np.zeros(1 << TABLE_BITS, dtype=bool)
        table[h >> np.uint32(32 - TABLE_BITS)] = True
        least = np.array([len(c) - q + 1 - q * e for _, c, e in found])
        out.append(Index(q, found, h[order], item[order], place[order], table, least, np.array([2 * e + 1 for *_, e in found]),
                         2 * max(len(c) + 2 * e for _, c, e in found)))
    return out


def regions(index: Index, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, first diagonal, last diagonal) of the bands whose shared q-grams reach the bound; bands that overlap
    and reach it are joined."""
    h = grams(codes, index.q)
    pos = np.flatnonzero(index.table[h >> np.uint32(32 - TABLE_BITS)])
    if not len(pos):
        return []
    lo = np.searchsorted(index.hashes, h[pos], side="left")
    n = np.searchsorted(index.hashes, h[pos], side="right") - lo
    pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
    if not len(pos):
        return []
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos, item = np.repeat(pos, n), index.item[at]
    diagonal = pos - index.place[at] + (1 << 24)  # kept positive
    # a band covers two strips of 2e + 1 diagonals, so any 2e + 1 neighbours lie within one; a place of the item counts
    # once in a strip
    strip = item.astype(np.int64) << 32 | diagonal // index.width[item]
    order = np.lexsort((index.place[at], strip))
    strip, place = strip[order], index.place[at][order]
    fresh = np.r_[True, (strip[1:] != strip[:-1]) | (place[1:] != place[:-1])]
    strips, count = np.unique(strip[fresh], return_counts=True)
    follows = np.r_[strips[1:] == strips[:-1] + 1, False]
    both = count + np.where(follows, np.r_[count[1:], 0], 0)
    out = []
    for strip, total in zip(strips[both >= index.least[strips >> 32]].tolist(), both[both >= index.least[strips >> 32]].tolist()):
        i, b = strip >> 32, strip & 0xFFFFFFFF
        w = int(index.width[i])
        first, last = b * w - (1 << 24), (b + 2) * w - (1 << 24)
        if out and out[-1][0] == i and first <= out[-1][2]:
            out[-1] = (i, out[-1][1], last)
        else:
            out.append((i, first, last))
    return out


def _last_row(item: np.ndarray, text: np.ndarray, first: int, last: int, anchored: bool) -> np.ndarray:
    """Edit distance of the whole item with a part of the text that ends on each diagonal of first..last, filling only
    these diagonals. The part starts anywhere, or at the text's start if `anchored`. Places beyond the text hold a
    character that equals no other: passing over one costs as much as leaving the item's character out."""
    width = last - first + 1
    around = np.full(width + len(item), 0xFFFFFFFF, dtype=np.uint32)  # the text from place `first` on
    lo, hi = max(first, 0), min(first + len(around), len(text))
    if lo < hi:
        around[lo - first:hi - first] = text[lo:hi]
    steps = np.arange(width, dtype=np.int32)
    cost = np.abs(steps + first) if anchored else np.zeros(width, dtype=np.int32)
    for i, c in enumerate(item):
        new = cost + (around[i:i + width] != c)
        np.minimum(new[:-1], cost[1:] + 1, out=new[:-1])     # the item's character is left out
        cost = np.minimum.accumulate(new - steps) + steps    # characters of the text are passed over
    return cost


def align(item: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best alignment of the whole item with a part of the text on the diagonals
    first..last, if its distance is at most `most`; of equal distances the earliest end, then the latest start."""
    first, last = max(first, -len(item)), min(last, len(text))
    if first > last:
        return None
    cost = _last_row(item, text, first, last, False)
    best = int(cost.min())
    if best > most:
        return None
    end = min(len(text), max(0, int(np.argmin(cost)) + first + len(item)))
    back = _last_row(item[::-1], text[:end][::-1], -best, best, True)
    length = int(np.flatnonzero(back == best)[0]) - best + len(item)
    return best, max(0, end - length), end


def verbatim(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int] | None:
    """The alignment without edits, if there is one: a copy needs no table."""
    whole, part = text.tobytes(), item.tobytes()
    at = whole.find(part)
    while at >= 0 and at % 4:
        at = whole.find(part, at + 1)
    return (0, at // 4, at // 4 + len(item)) if at >= 0 else None


def matches(indexes: list[Index | Short], texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, item_id, start, end, distance) of the items found in texts, in code points of the text.

    The texts are searched as one run with a separator after each, in pieces that overlap by the longest item and its
    edits; a region is aligned within each text that it touches, and a passage seen from two pieces is given once."""
    codes, at = normalised("".join(t + "\x00" for t in texts))
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])  # of the texts, before normalising
    begin = np.searchsorted(at, starts)                                       # and in `codes`
    found: dict[tuple, int] = {}
    for index in indexes:
        if isinstance(index, Short):
            for a in range(0, len(codes), PIECE):
                lo = max(0, a - 1)  # the character before shows the border
                for item_id, p in short_matches(index, codes[lo:a + PIECE + index.length]):
                    if a <= lo + p < a + PIECE:
                        k = int(np.searchsorted(begin, lo + p, side="right")) - 1
                        found[k, item_id, int(at[lo + p] - starts[k]), int(at[lo + p + index.length - 1] + 1 - starts[k])] = 0
            continue
        for a in range(0, max(len(codes), 1), PIECE):
            for i, first, last in regions(index, codes[a:a + PIECE + index.overlap]):
                item_id, item, edits = index.items[i]
                lo, hi = max(0, a + first - edits), min(len(codes), a + last + len(item) + edits)
                for k in range(int(np.searchsorted(begin, lo, side="right")) - 1, int(np.searchsorted(begin, hi, side="left"))):
                    from_, to = max(lo, int(begin[k])), min(hi, int(begin[k + 1]) - 1)
                    if to - from_ < len(item) - edits:
                        continue
                    part = codes[from_:to]
                    got = verbatim(item, part) or align(item, part, a + first - from_, a + last - from_, edits)
                    if got:
                        s, e = from_ + got[1], from_ + got[2]
                        key = (k, item_id, int(at[s] - starts[k]), int(at[e - 1] + 1 - starts[k]))
                        found[key] = min(got[0], found.get(key, got[0]))
    return sorted((*k, v) for k, v in found.items())


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, one at a time on the driver."""
    block, chars = [], 0
    rows = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].alias("text")) \
        .where(F.col("text").isNotNull()).distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"])
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per benchmark item found in a document: doc_id, item_id, start, end (code points of the text, end exclusive),
    distance (edits, at most EDIT_SHARE of the item's characters).

    Of a region with several alignments the best one is given. Null or empty texts and items find nothing; items of
    under MIN_ITEM characters are found verbatim on word borders. Repeated rows give repeated results; null ids stay null; an empty table on either side
    gives no rows; other columns are not read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where(F.length(docs[text_col]) > 0)
    spark = docs.sparkSession

    def search(block: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(build(block))  # of bounded size: BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, texts in text_slices(batch, PIECE):
                    out = [(ids[k], *m) for k, *m in matches(sent.value, texts)]
                    if out:
                        yield rows_of(_ARROW, list(zip(*out)))

        return rows.mapInArrow(run, SCHEMA)

    found = [search(b) for b in _blocks(benchmark, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


KEPT = "doc_id long, text string, lang string, source string, n_chars long"
_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def without_items(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source, n_chars) that hold no benchmark item, block of items by block of
    items: what one block leaves, the next one searches. Null and empty texts stay; rows with equal or null ids are
    judged one by one."""
    cast = ("long", "string", "string", "string", "long")
    rows = docs.select([docs[f.name].cast(t).alias(f.name) for f, t in zip(_KEPT, cast)])

    def clean(rows: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(build(block))  # of bounded size: BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (p for batch in batches for p in bounded(batch, 1, PIECE)):
                keep = np.ones(part.num_rows, dtype=bool)
                for k, *_ in matches(sent.value, [t or "" for t in part.column(1).to_pylist()]):
                    keep[k] = False
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in part.columns], schema=_KEPT)

        return rows.mapInArrow(run, KEPT)

    for block in _blocks(benchmark, item_col, item_text_col):
        rows = clean(rows, block)
    return rows
