"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Rows become blocks of integers. Each step multiplies the centred rows X by a direction (u = Xv - b u_before) and, in the same pass,
the result by their transpose (X'u); only sums of one or a few numbers per dimension leave a task, and Spark adds them up. The
vectors u have one entry per row; they are never stored: u = Xp for a direction p that the driver keeps, so a lost executor loses
nothing but the task it ran. Both sequences are fully reorthogonalised, the u by their inner products with all earlier ones,
which the same pass sums. The singular values of the small bidiagonal matrix are the deviations, its right singular
vectors turn the directions into components. All dimensions are stepped through, so equal eigenvalues are not missed; where a
sequence ends early (X'u or Xv vanish), it goes on with a new direction across from all earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.common import keep_table

#: How a component of a vector becomes an integer.
SCALE, SHIFT = 1024, 100_000
#: Beyond this a component's integer does not fit into a long with room to spare: such rows take no part.
LARGEST = 2.0 ** 61
ROWS = 4096

_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("d", pa.int32()), ("n", pa.int64()), ("x", pa.binary()),
                     ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])
BLOCKS = "ids array<long>, d int, n long, x binary, high array<long>, low array<long>"
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "deviation_text string")
_ARROW = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                    ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
                    ("deviation_text", pa.string())])


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length in a batch, without rows that are null or hold a null, non-finite or
    far too large entry."""
    lists = column.cast(pa.list_(pa.float64()))
    flat = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    offsets = lists.offsets.to_numpy()
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), offsets[1:] - offsets[:-1], -1)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        matrix = flat[offsets[rows][:, None] + np.arange(d)]
        whole = (np.abs(matrix) * SCALE < LARGEST).all(axis=1)  # false for NaN and infinities
        yield rows[whole], matrix[whole]


def blocks(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row per few thousand vectors of one length: ids, integers (narrowest type) and their exact sums in two halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, matrix in _vectors(batch.column(1)):
                for at in range(0, len(rows), ROWS):
                    x = np.floor(matrix[at:at + ROWS] * SCALE).astype(np.int64) + SHIFT
                    narrow = x.astype(np.int32) if np.abs(x).max() < 2 ** 31 else x
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids.take(pa.array(rows[at:at + ROWS])).to_pylist()], _BLOCKS[0].type), pa.array([x.shape[1]], pa.int32()),
                        pa.array([len(x)], pa.int64()), pa.array([narrow.tobytes()], pa.binary()),
                        pa.array([(x >> 32).sum(axis=0).tolist()], _BLOCKS[4].type),
                        pa.array([(x & 0xFFFFFFFF).sum(axis=0).tolist()], _BLOCKS[5].type)], schema=_BLOCKS)

    return vectors.select(vectors[id_col].cast("long"), vectors[vector_col].cast("array<double>")).mapInArrow(run, BLOCKS)


def _integers(data: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * d else np.int64).reshape(n, d)


class Centre:
    """The exact mean of each dimension, as a whole and a fractional part, so that centring loses no digits."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)^2 of each row, exact."""
        off = x - self.whole                       # n*x - S = n*off - (S mod n)
        rest = [s % self.n for s in self.sums]
        if (int(np.abs(off).max(initial=0)) + 1) * self.n < 2 ** 31 / max(1, len(rest)) ** 0.5:
            whole = off * self.n - np.array(rest, np.int64)
            return (whole * whole).sum(axis=1).tolist()
        whole = off.astype(object) * self.n - np.array(rest, object)
        return (whole * whole).sum(axis=1).tolist()


def summed(table: DataFrame, d: int, centre: Centre, directions: np.ndarray, width: int, measure) -> np.ndarray:
    """Sum over all blocks of `measure(centred rows, their products with the directions)`, `width` numbers, added up by Spark."""
    shared = table.sparkSession.sparkContext.broadcast((centre, directions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, wanted = shared.value
        total = np.zeros(width)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                y = middle.rows(_integers(data.as_py(), n, d))
                total += measure(y, y @ wanted)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = table.select("n", "x").mapInArrow(run, "v array<double>")
    rows = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    shared.destroy()
    out = np.zeros(width)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _across(v: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """v without its parts along the orthonormal columns of `earlier` (twice, against rounding)."""
    for _ in range(2):
        v = v - earlier @ (earlier.T @ v)
    return v


def _measure(y: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For products u with the new direction first and the earlier ones after: u'u, X'u, and u with each earlier one."""
    return np.concatenate([[u[:, 0] @ u[:, 0]], y.T @ u[:, 0], u[:, 1:].T @ u[:, 0]])


def bidiagonalise(table: DataFrame, d: int, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): X V = U B with orthonormal V and U, B upper bidiagonal, X the centred rows. All d steps are taken."""
    rng = np.random.default_rng(0)
    V, P, XU = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    B = np.zeros((d, d))
    v = rng.standard_normal(d)
    v /= np.linalg.norm(v)
    beta, largest = 0.0, 0.0
    for j in range(d):
        V = np.c_[V, v]
        p = v - beta * P[:, -1] if beta else v
        sums = summed(table, d, centre, np.c_[p, P], 1 + d + P.shape[1], _measure)
        along = sums[1 + d:]                                # what rounding left along earlier u
        p, back = p - P @ along, sums[1:1 + d] - XU @ along
        alpha = float(np.sqrt(max(0.0, sums[0] - along @ along)))
        largest = max(largest, alpha, beta)
        w = None
        if alpha > 1e-13 * largest and alpha > 0:
            B[j, j] = alpha
            P, XU = np.c_[P, p / alpha], np.c_[XU, back / alpha]
            w = _across(back / alpha - alpha * v, V)
            beta = float(np.linalg.norm(w))
        else:                                               # Xv lies among the earlier u: no new one
            P, XU = np.c_[P, np.zeros(d)], np.c_[XU, np.zeros(d)]
            beta = 0.0
        if j + 1 < d:
            if w is not None and beta > 1e-13 * largest:
                B[j, j + 1] = beta
            else:
                w, beta = _across(rng.standard_normal(d), V), 0.0
            v = w / np.linalg.norm(w)
            v = _across(v, V)
            v /= np.linalg.norm(v)
    return V, B


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component (from 1, by falling eigenvalue, up to `components` or the vectors' length): the vector's
    whitened coordinate, its exact squared deviation, the component's share of the trace, and the largest error of the whitened
    rows' covariance against the identity.

    Rows take no part whose vector is null, empty, holds a null or non-finite entry or one beyond 2^61 / 1024 in size, or is not of
    the commonest length (of equally common ones the longest). Repeated rows and null ids count like any row; an empty table
    gives no rows; other columns are not read. A component without variance (as with a single row) has whitened null and is
    left out of identity_error; where the trace is 0, explained is null. A deviation beyond a long is null; `deviation_text` has
    it in full.
    """
    spark = vectors.sparkSession
    table = keep_table(blocks(vectors, id_col, vector_col), "whitening")
    lengths = table.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], SCHEMA)
    d, n = lengths[0]["d"], lengths[0]["n"]
    table = table.where(F.col("d") == d)

    def total(name: str) -> Column:
        return F.sum(F.col(name).cast("decimal(38,0)")).alias(name)

    halves = table.select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "s")) \
        .groupBy("i").agg(total("s.high").alias("high"), total("s.low").alias("low")).orderBy("i").collect()
    centre = Centre(n, [(int(r["high"]) << 32) + int(r["low"]) for r in halves])

    V, B = bidiagonalise(table, d, centre)
    _, sigma, right = np.linalg.svd(B)
    k = min(components, d)
    axes, values = V @ right[:k].T, sigma ** 2 / n
    trace = float(values.sum())
    live = np.sqrt(values[:k]) > 1e-12 * np.sqrt(values[0]) if trace > 0 else np.zeros(k, bool)
    scaled = axes / np.where(live, np.sqrt(values[:k]), 1.0)

    sums = summed(table, d, centre, scaled, k + k * k, lambda y, w: np.concatenate([w.sum(axis=0), (w.T @ w).ravel()]))
    mean, second = sums[:k] / n, sums[k:].reshape(k, k) / n
    error = np.abs(second - np.outer(mean, mean) - np.eye(k))[np.ix_(live, live)]
    identity_error = float(error.max()) if live.any() else None
    explained = [float(e) / trace if trace > 0 else None for e in values[:k]]
    shared = spark.sparkContext.broadcast((centre, scaled, live))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, wanted, alive = shared.value
        for batch in batches:
            for ids, rows, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                x = _integers(data.as_py(), rows, d)
                deviations = middle.deviations(x)
                white = middle.rows(x) @ wanted
                fits = [v if v < 2 ** 63 else None for v in deviations]
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, n), pa.int64()), pa.array([v for v in fits for _ in range(k)], pa.int64()),
                    pa.array(white.ravel(), pa.float64(), mask=np.tile(~alive, rows)), pa.array(explained * rows, pa.float64()),
                    pa.array([identity_error] * (rows * k), pa.float64()),
                    pa.array([str(v) for v in deviations for _ in range(k)], pa.string())], schema=_ARROW)

    return table.select("ids", "n", "x").mapInArrow(run, SCHEMA)
