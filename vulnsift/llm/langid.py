"""Language identification with blended-spectrum string kernels.

The kernel of two texts adds, for n = 1, 2, 3, the cosine of their sets of character n-grams (presence, not
counts). A Nystrom map over a few landmark texts turns it into features, and kernel ridge regression is
solved once for all languages against the rest. Fitting uses a bounded sample; scoring is a chain of matrix
products over batches of documents where they lie, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.llm.common import bounded, code_points, held_out, rows_of

#: Hash space of the 1-, 2- and 3-grams.
SPECTRUM = (256, 2048, 6144)
#: Characters walked at a time, and documents in one matrix.
PIECE, ROWS = 1_000_000, 256

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def presence(texts: list[str]) -> np.ndarray:
    """Rows of n-gram presence, each spectrum block scaled to unit length. Texts are lower-cased whole;
    long ones are walked in pieces that overlap by two characters, which leaves the set unchanged."""
    out = np.zeros((len(texts), sum(SPECTRUM)), dtype=np.float32)
    flat, width = out.reshape(-1), out.shape[1]
    # texts run together with two zero characters between; n-grams over a border are left out
    parts, owner, size = [], [], 0

    def flush():
        nonlocal parts, owner, size
        if not parts:
            return
        codes = np.concatenate(parts)
        row = np.repeat(np.array(owner, dtype=np.int64) * width, [len(p) for p in parts])
        c1 = codes * np.uint32(0x9E3779B1)
        ok = codes != 0
        flat[row[ok] + (c1[ok] >> np.uint32(24))] = 1
        ok2 = ok[:-1] & ok[1:]
        c2 = (c1[:-1] ^ (codes[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
        flat[row[:-1][ok2] + (c2[ok2] >> np.uint32(21)) + SPECTRUM[0]] = 1
        ok3 = ok2[:-1] & ok[2:]
        c3 = (c2[:-1] ^ (codes[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
        h3 = ((c3[ok3] >> np.uint32(8)).astype(np.int64) * SPECTRUM[2]) >> 24
        flat[row[:-2][ok3] + h3 + (SPECTRUM[0] + SPECTRUM[1])] = 1
        parts, owner, size = [], [], 0

    gap = np.zeros(2, dtype=np.uint32)
    for i, t in enumerate(texts):
        codes = code_points(t.lower())
        for a in range(0, len(codes), PIECE):
            piece = codes[a:a + PIECE + 2]
            parts += [piece, gap]
            owner += [i, i]
            size += len(piece)
            if size >= PIECE:
                flush()
    flush()
    at = 0
    for n in SPECTRUM:
        block = out[:, at:at + n]
        norm = np.sqrt(block.sum(axis=1, keepdims=True))
        block /= np.where(norm > 0, norm, 1)
        at += n
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # landmark presence rows
    weights: np.ndarray    # Nystrom map times ridge solution: landmarks x languages
    sharpness: float

    def margins(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([presence(texts[i:i + ROWS]) @ self.landmarks.T @ self.weights
                               for i in range(0, len(texts), ROWS)])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        if at and self.languages:
            m = self.margins([texts[i] for i in at]) * self.sharpness
            e = np.exp(m - m.max(axis=1, keepdims=True))
            e /= e.sum(axis=1, keepdims=True)
            best = e.argmax(axis=1)
            for i, b, p in zip(at, best, e[np.arange(len(at)), best]):
                pred[i], score[i] = self.languages[b], float(p)
        return pred, score


def sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc_id, text, lang): at most `per_language` labelled ids of each language outside the held-out fold, those that hash
    lowest, each with one of its texts. Ranks are taken over ids alone; texts of the chosen ids, which the parameter bounds, are
    read in a second pass."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # a threshold by language, one number for each, leaves about twice as many ids as are wanted before anything is shuffled
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    few = rows.select("lang", "doc_id").join(F.broadcast(counts), "lang") \
        .where(place.cast("double") < F.lit(2.0 * per_language * (1 << 40)) / F.col("n")).select("lang", "doc_id").distinct()
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    ids = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("lang", "doc_id")
    return rows.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit(rows: list[tuple[str, str]], n_landmarks: int = 128, ridge: float = 1e-2, sharpness: float = 6.0) -> Model:
    """Model from (text, language) rows; rows without a letter teach nothing. No rows: every text is `und`."""
    rows = [(t, y) for t, y in rows if has_letter(t)]
    languages = sorted({y for _, y in rows})
    if not rows:
        return Model([], np.zeros((0, sum(SPECTRUM)), np.float32), np.zeros((0, 0), np.float32), sharpness)
    x = np.concatenate([presence([t for t, _ in rows[i:i + ROWS]]) for i in range(0, len(rows), ROWS)])
    by = {y: [i for i, r in enumerate(rows) if r[1] == y] for y in languages}
    per = max(1, n_landmarks // len(languages))
    marks = x[[i for y in languages for i in by[y][:per]]]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    nystrom = vector[:, keep] / np.sqrt(value[keep])
    phi = (x @ marks.T).astype(np.float64) @ nystrom
    target = np.array([[1.0 if y == c else -1.0 for c in languages] for _, y in rows])
    share = np.array([len(rows) / (len(languages) * len(by[y])) for _, y in rows])[:, None]  # languages weigh alike
    solved = np.linalg.solve(phi.T @ (phi * share) + ridge * len(rows) / phi.shape[1] * np.eye(phi.shape[1]), phi.T @ (target * share))
    return Model(languages, marks, (nystrom @ solved).astype(np.float32), sharpness)


def _fitted(docs: DataFrame, per_language: int, n_landmarks: int, id_col: str, text_col: str, lang_col: str):
    """Broadcast of the model fitted on the sample."""
    taught = [(r["text"], r["lang"]) for r in sample(docs, per_language, id_col, text_col, lang_col)
              .orderBy(F.xxhash64("doc_id"), "doc_id", "lang").collect()]
    return docs.sparkSession.sparkContext.broadcast(fit(taught, n_landmarks))


def identify(docs: DataFrame, per_language: int = 500, n_landmarks: int = 128, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score (probability of lang_pred).

    `und` with score 0 for a text that is null or has no letter, and for all texts if no row can teach.
    The model learns from at most `per_language` rows of each language outside the held-out fold, however many languages
    there are; it is broadcast with the tasks and has n_landmarks rows, or one a language, whatever the input's size. Repeated rows and null ids are
    scored like any row; an empty table gives no rows; other columns are not read.
    """
    model = _fitted(docs, per_language, n_landmarks, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in bounded(batch, 1):
                pred, score = m.predict(part.column(1).to_pylist())
                yield rows_of(_ARROW, [part.column(0), part.column(2), pred, score])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, SCHEMA)


KEPT = "doc_id long, text string, lang string, source string, n_chars long"
_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def keep_identified(docs: DataFrame, per_language: int = 500, n_landmarks: int = 128) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source, n_chars) whose language is known, with `lang` the predicted one.

    `und` goes: a null text, a text without a letter, and every text if no row can teach. Learning and the model's size
    are those of `identify`. Rows with equal or null ids are judged one by one.
    """
    model = _fitted(docs, per_language, n_landmarks, "doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in bounded(batch, 1):
                pred = pa.array(m.predict(part.column(1).to_pylist())[0], pa.string())
                columns = [part.column(0), part.column(1), pred, part.column(3), part.column(4)]
                keep = pa.compute.not_equal(pred, "und")
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], schema=_KEPT)

    cast = ("long", "string", "string", "string", "long")
    return docs.select([docs[f.name].cast(t).alias(f.name) for f, t in zip(_KEPT, cast)]).mapInArrow(run, KEPT)
