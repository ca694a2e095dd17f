"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every hashed word has a fixed sparse random index vector. A word's vector is the sum, over all its
occurrences in all documents, of the index vectors of the words up to two places before and after it: a
count that Spark adds up from per-task partial sums. A document is the mean and the spread of its words'
unit vectors. The network (numpy) learns from a bounded sample of labelled rows; a temperature fitted on
rows kept apart calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.common import held_out, rows_of, text_slices

#: Hash space of words, length of the vectors, nonzero entries of an index vector, context words on each side.
WORDS, DIM, NONZERO, REACH = 65536, 48, 4, 2

WORD = re.compile(r"\w+|[^\w\s]+")

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def index_vectors() -> np.ndarray:
    """The fixed ternary index vector of every word number."""
    rng = np.random.default_rng(12345)
    out = np.zeros((WORDS, DIM), dtype=np.int8)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = np.repeat([1, -1], NONZERO // 2)
    return out


class Numbers(dict):
    """Word -> word number. Forgets everything when it has grown large, so memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return n


def word_numbers(texts: list[str], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in one array, and how many each text has."""
    found = [WORD.findall(t) for t in texts]
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    flat = np.fromiter((numbers[w] for f in found for w in f), dtype=np.uint16, count=int(sizes.sum()))
    return flat, sizes


def contexts(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Add to `total` (word x DIM) the index vectors of the neighbours of every word, within its text."""
    if not len(flat):
        return
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    for a in range(0, len(flat), 1 << 19):
        lo, hi = max(0, a - REACH), min(len(flat), a + (1 << 19) + REACH)
        words, owner = flat[lo:hi], doc[lo:hi]
        vectors = index[words]
        near = np.zeros(vectors.shape, dtype=np.int8)
        for step in range(1, REACH + 1):
            same = (owner[step:] == owner[:-step])[:, None]
            near[step:] += vectors[:-step] * same
            near[:-step] += vectors[step:] * same
        words, near = words[a - lo:a - lo + (1 << 19)], near[a - lo:a - lo + (1 << 19)]
        order = np.argsort(words, kind="stable")
        words = words[order]
        starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        total[words[starts]] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all word numbers, summed over the whole of `docs`. Tasks emit one row for each word
    number they saw; Spark adds them. WORDS rows reach the driver, whatever the input's size."""
    names = [f"d{i}" for i in range(DIM)]
    arrow = pa.schema([("word", pa.int32()), *((n, pa.int64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, numbers = index_vectors(), Numbers()
        total = np.zeros((WORDS, DIM), dtype=np.int64)
        for batch in batches:
            for _, texts in text_slices(batch):
                contexts(*word_numbers(texts, numbers), index, total)
        seen = np.flatnonzero(total.any(axis=1))
        yield rows_of(arrow, [seen.astype(np.int32), *total[seen].T])

    parts = docs.select(F.lit(0).alias("none"), docs[text_col]) \
        .mapInArrow(run, "word int, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((WORDS, DIM), dtype=np.float64)
    added = parts.groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    for i, n in enumerate(names):
        out[added["word"].to_numpy(), i] = added[n].to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray, numbers: Numbers) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text; zeros where there are no words."""
    flat, sizes = word_numbers(texts, numbers)
    out = np.zeros((len(texts), 2 * DIM), dtype=np.float64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(texts)):
        if sizes[i]:
            used, counts = np.unique(flat[begin[i]:begin[i + 1]], return_counts=True)
            share = counts / sizes[i]
            v = vectors[used]
            mean = share @ v
            out[i, :DIM] = mean
            out[i, DIM:] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
    return out


@dataclass
class Network:
    """Two layers: tanh hidden units, one logit; inputs are standardised, the logit divided by the temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 300, decay: float = 1e-3) -> Network:
    """Adam on the class-balanced cross entropy of four fifths of the rows, the temperature on the last fifth.
    Rows come in a fixed order, so the result is the same on every run. One class only: its share is the score."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else 0.99 if y[0] else 0.01
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(7)
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart[:] = False
    tx, ty = x[~apart], y[~apart].astype(float)
    shift, scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
    z = (tx - shift) / scale
    weight = np.where(ty == 1, 0.5 / ty.mean(), 0.5 / (1 - ty.mean()))
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(ty))
        for a in range(0, len(order), 256):
            i = order[a:a + 256]
            h = np.tanh(z[i] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50)))
            g = (out - ty[i]) * weight[i] / len(i)
            gh = np.outer(g, p[2]) * (1 - h * h)
            step += 1
            for k, grad in enumerate((z[i].T @ gh + decay * p[0], gh.sum(axis=0), h.T @ g + decay * p[2], np.array([g.sum()]))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] = p[k] - 3e-3 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]))
    if apart.any():
        logit, truth = net.logit(x[apart]), y[apart].astype(float)
        losses = {t: np.mean(np.logaddexp(0, logit / t) - truth * logit / t) for t in np.geomspace(0.25, 8, 41)}
        net.temperature = float(min(losses, key=losses.get))
    return net


def labelled(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> list:
    """At most `most` (text, label) rows outside the held-out fold: the labelled ids that hash lowest, each with one of its texts."""
    ids = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    label = {r[0]: r[1] for r in chosen.collect()}
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [(r["text"] or "", label[r["doc_id"]]) for r in found]


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Quality of every document: doc_id, held_out, score (probability of label 1), predicted (score >= 0.5).

    Word vectors gather counts from all documents; the network learns from at most `max_labelled` labelled rows
    outside the held-out fold (a document with several labels: the highest). Texts without words, null and
    empty ones, are scored as the zero vector. Without labels every score is 0.5. Repeated rows and null ids
    are scored like any row; an empty table gives no rows; other columns are not read.
    """
    vectors = word_vectors(docs, text_col)
    taught = labelled(docs, labels, max_labelled, id_col, text_col, label_col)
    numbers = Numbers()
    x = np.concatenate([np.zeros((0, 2 * DIM)), *(pooled([t], vectors, numbers) for t, _ in taught)])
    model = docs.sparkSession.sparkContext.broadcast((vectors, train(x, np.array([y for _, y in taught], dtype=int))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, net = model.value
        seen = Numbers()
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(net.probability(pooled(texts, vec, seen)) for _, texts in text_slices(batch))])
            yield rows_of(_ARROW, [batch.column(0), batch.column(2), score, (score >= 0.5).astype(np.int32)])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, SCHEMA)
