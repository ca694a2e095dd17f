"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights.

Documents are tokenised where they lie and cut into pieces of at most one sequence. All that the packing needs of them is
how many pieces there are of each length, at most `capacity` numbers however large the input is. Over these the driver
solves the configuration program (a column is a multiset of lengths that fits into one sequence; every length must be
covered as often as it occurs): each round prices the columns by a knapsack dynamic program under the present weights, takes
columns within a tolerance of the best price, as many of each as a round's share of the pieces allows, and multiplies the
weight of each length by how far it fell behind. The weights of any round bound the optimum from below, so the gap is known.
Rounding takes whole copies of the columns and packs what is left with columns priced in the same way on what is left.

A column with its copies owns a run of ranks of each length. A piece's rank among the pieces of its length is its number
inside its task plus what the tasks before hold, so the pieces find their places without being sorted or gathered.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.llm.common import bounded, keep_table, rows_of

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, doc_tokens long"
_PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())])

#: Entries of a worker's cache and the longest word that goes into it; characters of a text that are split at a time.
CACHED, LONGEST, STRIDE = 1_000_000, 48, 1 << 20
_BREAK = re.compile("[ \n]")
# How the tokenizer file splits lower-cased text of ASCII and Latin letters that have no other form, and what is not such
# text (control 1 marks the ends of words here, <| may begin an added token).
_SPACE, _LETTER = r" \t\n\r\f\x0b", r"a-z\x{df}-\x{f6}\x{f8}-\x{ff}"
PART = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_SPACE}0-9{_LETTER}]+"
OTHER = r"[^\x00-\x7f\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]|\x01|<\|"


class WordIds:
    """Token ids of texts by a tokenizer file whose words never cross a blank or a line feed. Texts are split by Arrow, plain ones as
    the file does it, others at blanks and line feeds; each different word of a batch is looked up once, and only words
    never seen before are encoded by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.mark, = self._ids("~")  # a word of its own, with one id that no word without it has
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encode([text], add_special_tokens=False)[0].ids, "<u4")

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word, as little-endian bytes: all in one text with a mark between them, but for words that hold it themselves."""
        plain = [w for w in words if "~" not in w]
        ids = self._ids(" ~ ".join(plain))
        cuts, data = 4 * np.flatnonzero(ids == self.mark), ids.tobytes()
        out = {w: data[a:b] for w, a, b in zip(plain, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)])}
        return out | {w: self._ids(w).tobytes() for w in words if "~" in w}

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all lists of words in one array, and where each list's begin (and the last one's end)."""
        places = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(places[0], places[-1] - places[0]).dictionary_encode()
        every = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, every))
        unknown = [i for i, b in enumerate(ids) if b is None]
        new = self._encoded([every[i] for i in unknown])
        for i in unknown:
            ids[i] = new[every[i]]
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
        self.known.update((w, b) for w, b in new.items() if len(w) <= LONGEST)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        count = sizes[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(begin[which] - ends[:-1], count) + np.arange(ends[-1])
        return np.frombuffer(b"".join(ids), "<u4")[at], ends[places - places[0]]

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        other = pc.match_substring_regex(texts, OTHER)
        if pc.any(other).as_py():
            plain = other.to_numpy(zero_copy_only=False) == 0
            found = [np.split(flat, ends[1:-1]) for flat, ends in (
                self._plain(texts.filter(pa.array(plain))), self._looked_up(pc.split_pattern(pc.replace_substring(
                    texts.filter(other), "\n", " "), " ")))]
            takes = [iter(f) for f in found]
            each = [next(takes[0 if p else 1]) for p in plain]
            return np.concatenate(each), np.cumsum([0, *map(len, each)])
        return self._plain(texts)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # white space stays at the start of the word after it, which has the same ids: a match without groups is cheaper to find
        marked = pc.replace_substring_regex(pc.utf8_lower(texts), PART, "\\0\x01")
        return self._looked_up(pc.split_pattern(marked, "\x01"))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) in one array, and where each text's begin. Texts of more than STRIDE characters are walked in
        pieces that end at a blank or line feed."""
        if not len(texts) or pc.max(pc.binary_length(texts)).as_py() <= 4 * STRIDE:
            return self._split(texts)
        found, ends = [], [0]
        for text in texts.to_pylist():
            at, size = 0, 0
            while at < len(text):
                cut = _BREAK.search(text, at + STRIDE)
                found.append(self._split(pa.array([text[at:cut.start() if cut else len(text)]], pa.string()))[0])
                at, size = cut.end() if cut else len(text), size + len(found[-1])
            ends.append(ends[-1] + size)
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.array(ends)


_ENCODERS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: documents of more than `capacity` ids are cut every `capacity` ids. `part` and `nth` number the
    pieces of each length inside a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = WordIds(vocabulary)
        encoder = _ENCODERS[vocabulary]
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        last = np.array([end_id], "<u4").tobytes()
        for part in (p for batch in batches for p in bounded(batch, 1, 8 * STRIDE)):
            rows = []
            flat, ends = encoder.of(pc.fill_null(part.column(1), ""))
            for doc, a, b in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                total = b - a + 1
                for number, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    crc = zlib.crc32(flat[a + start:min(b, a + start + length)])
                    crc = zlib.crc32(last, crc) if start + length == total else crc
                    rows.append((doc, number, start, length, crc, total, task, seen[length]))
                    seen[length] += 1
            yield rows_of(_ARROW, list(zip(*rows)))

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, SCHEMA)


@dataclass
class Plan:
    """Who lies where: run i gives the pieces of length[i] with ranks from rank[i] on, times[i] to a sequence, to the sequences from
    first[i] on, at offset[i] and after. Runs are sorted by (length, rank); `at` finds those of a length."""

    length: np.ndarray
    rank: np.ndarray
    times: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int
    bound: float

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank among the pieces of that length."""
        low = np.searchsorted(self.length, length, "left")
        high = np.searchsorted(self.length, length, "right")
        while (open_ := high - low > 1).any():   # the last run of the length that starts at or before the rank
            mid = (low + high) // 2
            after = open_ & (self.rank[np.minimum(mid, len(self.rank) - 1)] <= rank)
            low, high = np.where(after, mid, low), np.where(open_ & ~after, mid, high)
        into = rank - self.rank[low]
        return self.first[low] + into // self.times[low], self.offset[low] + into % self.times[low] * length


def best_values(weight: np.ndarray, capacity: int) -> np.ndarray:
    """best[c]: the greatest weight of a multiset of lengths that fits into c (weight[l] <= 0: not to be had)."""
    best = np.zeros(capacity + 1)
    lengths = np.flatnonzero(weight > 0)
    values, lengths = weight[lengths], lengths.astype(np.int64)
    dense = np.where(weight > 0, weight, -np.inf)[1:]
    least = int(lengths[0]) if len(lengths) else capacity + 1
    for c in range(least, capacity + 1):
        if 4 * len(lengths) < c:
            k = np.searchsorted(lengths, c, "right")
            best[c] = max(best[c - 1], (values[:k] + best[c - lengths[:k]]).max())
        else:
            best[c] = max(best[c - 1], (dense[:c] + best[c - 1::-1]).max())
    return best


def column_through(first: int, weight: np.ndarray, best: np.ndarray, left: np.ndarray, capacity: int, slack: float) -> list[tuple[int, int]]:
    """A column with one piece of length `first`, filled up with lengths that `left` still has: at each step, of the lengths that
    lose at most `slack` against the best price of the room, that of which most is left; a length is taken as often as fits well."""
    column, room, used = [(first, 1)], capacity - first, {first: 1}
    while room > 0:
        price = weight[1:room + 1] + best[room - 1::-1]
        have = left[1:room + 1].copy()
        for size, n in used.items():
            if size <= room:
                have[size - 1] -= n
        price[have < 1] = -np.inf
        top = price.max()
        if not np.isfinite(top):
            break
        near = np.flatnonzero(price >= top - slack)
        size = int(near[np.argmax(have[near] * (near + 1.0))]) + 1
        column.append((size, 1))
        used[size] = used.get(size, 0) + 1
        room -= size
    return sorted(used.items())


def solve(counts: dict[int, int], capacity: int, rounds: int = 8, rate: float = 1.0, near: float = 1e-2) -> tuple[list, np.ndarray, float]:
    """Columns with their fractional copies, the last weights, and a lower bound of the program.

    Every round may cover 1/rounds of each length by columns within `near` of the best price. Lengths that these cover less
    often than that grow heavier. A round that covers all but a hundredth of the pieces' total length has found columns
    for the whole program: they are taken `rounds` times and the search ends.
    """
    sizes = np.arange(capacity + 1)
    demand = np.zeros(capacity + 1)
    for size, n in counts.items():
        demand[size] = n
    present = demand > 0
    weight = np.where(present, sizes / capacity, 0.0)
    columns: dict[tuple, float] = {}
    bound, share = 0.0, demand / rounds
    for _ in range(rounds):
        best = best_values(weight, capacity)
        bound = max(bound, float(demand @ weight) / best[capacity])
        left, found = share.copy(), {}
        for size in np.flatnonzero(present)[::-1]:
            while left[size] > 1e-9 * share[size]:
                column = tuple(column_through(int(size), weight, best, np.floor(left / left[size] + 1e-9), capacity, near / 10 * best[capacity]))
                if sum(weight[s] * n for s, n in column) < (1 - near) * best[capacity]:
                    break
                copies = min(left[s] / n for s, n in column)
                found[column] = found.get(column, 0.0) + copies
                for s, n in column:
                    left[s] -= copies * n
        if left @ sizes <= 0.01 * (share @ sizes):
            return [(c, n * rounds) for c, n in found.items()], weight, bound
        for column, copies in found.items():
            columns[column] = columns.get(column, 0.0) + copies
        weight = weight * np.exp(rate * np.divide(left, share, out=np.zeros_like(left), where=present))
        weight *= sizes[present].sum() / capacity / weight.sum()
    return list(columns.items()), weight, bound


def fullest(room: int, left: np.ndarray) -> list[tuple[int, int]]:
    """Lengths of what is left, none more often than it is left, that fill as much of `room` as can be: sums that can be reached
    are the bits of a number, to which the lengths are added from the longest on until the room is full."""
    reached, before, parts = 1, [], []
    within = (1 << (room + 1)) - 1
    for size in np.flatnonzero(left[:room + 1] >= 1)[::-1].tolist():
        n, copies = min(int(left[size]), room // size), 1
        while n:
            copies = min(copies, n)
            more = (reached | reached << size * copies) & within
            if more != reached:
                before.append(reached)
                parts.append((size, copies))
                reached = more
            n, copies = n - copies, 2 * copies
        if reached >> room & 1:
            break
    at, column = reached.bit_length() - 1, {}
    for known, (size, copies) in zip(before[::-1], parts[::-1]):
        if not known >> at & 1:
            column[size] = column.get(size, 0) + copies
            at -= size * copies
    return sorted(column.items())


def round_up(counts: dict[int, int], columns: list, weight: np.ndarray | None, capacity: int, patience: int = 256) -> list[tuple[tuple, int]]:
    """Whole copies of columns that hold every piece exactly once: those of the program that leave no room, then, from the longest
    length left on, columns with it, priced by `weight` on what is left (anew after each `patience` of them), or, where these leave room or
    without a weight, the fullest."""
    left = np.zeros(capacity + 1)
    for size, n in counts.items():
        left[size] = n
    out: dict[tuple, int] = {}

    def take(column: tuple, copies: int) -> None:
        out[column] = out.get(column, 0) + copies
        for s, n in column:
            left[s] -= copies * n

    for column, copies in sorted(columns, key=lambda c: (-c[1], c[0])):
        if sum(s * n for s, n in column) == capacity and (whole := int(min(copies + 1e-6, min(left[s] // n for s, n in column)))):
            take(column, whole)
    since = 0
    for size in range(capacity, 0, -1):
        while left[size] >= 1:
            column = None
            if weight is not None:
                if since % patience == 0:
                    best = best_values(np.where(left > 0, weight, 0.0), capacity)
                column, since = tuple(column_through(size, weight, best, left, capacity, 1e-9)), since + 1
            if column is None or sum(s * n for s, n in column) < capacity:
                rest = left.copy()
                rest[size] -= 1
                full = dict(fullest(capacity - size, rest))
                full[size] = full.get(size, 0) + 1
                if column is None or sum(s * n for s, n in full.items()) > sum(s * n for s, n in column):
                    column = tuple(sorted(full.items()))
            take(column, int(min(left[s] // n for s, n in column)))
    return list(out.items())


def plan(counts: dict[int, int], capacity: int, rounds: int = 8) -> Plan:
    """The packing of a histogram: how many pieces there are of each length."""
    counts = {s: n for s, n in counts.items() if n}
    columns, weight, bound = solve(counts, capacity, rounds) if counts else ([], None, 0.0)
    rounded = [round_up(counts, columns, w, capacity) for w in (weight, None)]
    runs, given, first = [], dict.fromkeys(counts, 0), 0
    for column, copies in min(rounded, key=lambda r: sum(n for _, n in r)):
        offset = 0
        for size, n in column:
            runs.append((size, given[size], n, first, offset))
            given[size] += n * copies
            offset += n * size
        first += copies
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(table[:, i]) for i in range(5)), sequences=first, bound=bound)


def pack_tightly(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, rounds: int = 8,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document, with the sequence that holds it and its offset there.

    A document's ids are its text's token ids and then `end_id`; a null or empty text is the end id alone. Only documents
    of more than `capacity` ids are cut, every `capacity` ids. Sequences are numbered from 0 and gapless, their pieces too.
    Repeated rows and rows with a null id are packed like any other row (the id stays null); an empty table gives no rows;
    other columns of `docs` are not read. The driver sees one number per length (at most `capacity`), and sends out the plan: a
    row per column of the program and length in it, which grows with `capacity` and `rounds`, not with the input.
    """
    spark = docs.sparkSession
    cut = keep_table(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "bestfit-pieces")
    held = keep_table(cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "bestfit-lengths")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = spark.sparkContext.broadcast(plan(counts, capacity, rounds))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(held.select("part", "length", before.alias("before")), ["part", "length"]) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            sequence, offset = layout.value.place(col["length"].to_numpy(), col["rank"].to_numpy())
            col |= {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
            yield pa.RecordBatch.from_arrays([col[f.name] for f in _PLACED], schema=_PLACED)

    return ranked.mapInArrow(place, PLACED)
