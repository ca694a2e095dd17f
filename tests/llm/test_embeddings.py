"""Hard negatives and whitening against plain loops and a dense eigen-decomposition."""

import math

import numpy as np
import pytest

from vulnsift.llm import hard_negatives as H
from vulnsift.llm import whitening as W
from vulnsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>"


def plain_negatives(rows):
    """The contract, row by row, in Python integers."""
    keep = [(i, (la + 1) % 10 if i % 7 == 0 else la, [math.floor(256 * float(np.float32(c))) for c in v]) for i, la, v in rows
            if i is not None and la is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (i, la, v) in enumerate(keep):
        if i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m, lb) for m, (j, lb, w) in enumerate(keep) if m != n))
        for s, j, _, lb in [x for x in scored if x[3] == la][:5]:
            near = [(t, k) for t, k, _, lc in scored if lc != la and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(near, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in H.mine(df).collect())


def grid(n, d=6, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)), [float(x) for x in np.float32(rng.integers(-4, 5, d) / 8)]) for i in range(n)]


def test_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    assert sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, SF).collect()) == plain_negatives(map(tuple, rows))


@pytest.mark.parametrize("tree_rows", [64, 100000])
def test_many_ties_over_trees(spark, monkeypatch, tree_rows):
    """Few distinct scores; several trees exchange their k-th best, or one tree holds all."""
    monkeypatch.setattr(H, "TREE_ROWS", tree_rows)
    rows = grid(700) + [(10_000 + i, 1, [0.5] * 6) for i in range(200)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain_negatives(rows)


def test_odd_embeddings(spark):
    rows = grid(250, 4, 2) + [(300, None, [0.1] * 4), (400, 1, None), (500, 1, [0.1, None, 0.2, 0.3]), (600, 1, [0.1, float("nan"), 0.0, 0.0]),
                              (700, 2, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, [0.5] * 4), (800, 1, []), (800, 3, [0.25] * 4), (800, 3, [0.25] * 4),
                              (-100, 2, [-0.5, 0.25, 0.5, 0.75]), (901, 2, [0.5] * 3)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", rank string, score double")
    assert mined(df) == plain_negatives([r for r in rows if r[2] is None or len(r[2]) != 3])
    assert mined(df.limit(0)) == []
    assert mined(spark.createDataFrame([(0, 1, [1.0, 2.0])], SCHEMA)) == []


def test_scores_beyond_exact_doubles(spark):
    rows = [(i, i % 2, [float(np.float32(3e6 + 977 * i)), float(np.float32(-2e6 + i)), float(np.float32(1e9 + 4096 * i))]) for i in range(1, 40)]
    rows += [(100, 0, [1e6, 2e6, 3e8]), (200, 1, [7e6, -1e6, 2e8])]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain_negatives(rows)


def test_boxes_bound_products():
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((500, 7)) * 50)
    x = x[H.tiled(x)]
    kind, data = H._packed(x)
    tree = H.Tree({"kind": kind, "x": data, "d": 7, "ids": np.arange(500).tobytes(), "labels": np.zeros(500, "i8").tobytes()})
    q = np.floor(rng.standard_normal((20, 7)) * 50)
    low, high, leaf_low, leaf_high = tree.bounds(q)
    products = q @ x.T
    for leaf in range(leaf_low.shape[1]):
        inside = products[:, leaf * H.LEAF:(leaf + 1) * H.LEAF]
        assert (leaf_low[:, leaf] <= inside.min(axis=1)).all() and (inside.max(axis=1) <= leaf_high[:, leaf]).all()
    assert (low.min(axis=1) <= products.min(axis=1)).all() and (high.max(axis=1) >= products.max(axis=1)).all()


def check_whitening(got, rows, tolerance=1e-8):
    """Against numpy's eigenvectors; deviations in Python integers. Columns may differ in sign."""
    keep = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in keep]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    want = {}
    for (i, _), r in zip(keep, x):
        want.setdefault(i, []).append(sum((n * a - s) ** 2 for a, s in zip(r, sums)))
    seen = {}
    for r in got:
        seen.setdefault((r.vec_id, r.component), []).append(r.deviation)
    k = min(8, d)
    assert {key: sorted(v) for key, v in seen.items()} == {(i, c): sorted(v) for i, v in want.items() for c in range(1, k + 1)}
    y = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    for c in range(k):
        mine = {r.vec_id: r.whitened for r in got if r.component == c + 1}
        share = next(r.explained for r in got if r.component == c + 1)
        assert abs(share - e[c] / (y * y).sum() * n) <= 1e-9
        a, b = np.array([mine[i] for i, _ in keep]), (y @ q)[:, c] / math.sqrt(e[c])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tolerance
    assert 0 <= got[0].identity_error < 1e-9 and {r.n for r in got} == {n}


def test_whitening_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(QUERIES["op13_whitening"](spark, SF).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(5) * [1, 2, 3, 4, 5]]) for i in range(40)]
    rows += [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf")] * 5), (1, rows[1][1]), (94, [])]
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, component string, n double").repartition(3)
    check_whitening(W.whiten(df).collect(), rows)
    assert W.whiten(df.limit(0)).collect() == []


def test_whitening_without_full_rank(spark):
    """Three dimensions of variance in six, an exact double eigenvalue among them, and a single row."""
    rows = [(i, [a, b, a, 0.25, c, 0.0]) for i, (a, b, c) in enumerate([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    got = W.whiten(df).collect()
    assert len(got) == 36
    live = {c: np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == c]) for c in (1, 2, 3)}
    m = np.array([live[c] for c in (1, 2, 3)])
    assert np.allclose(m @ m.T / 6, np.eye(3)) and all(r.whitened is None for r in got if r.component > 3)
    assert [round(next(r.explained for r in got if r.component == c), 6) for c in (1, 2, 3, 4)] == [0.5, 0.25, 0.25, 0.0]
    one = W.whiten(df.limit(1)).collect()
    assert len(one) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained is None for r in one)


def test_deviations_beyond_a_long():
    centre = W.Centre(10**7, [10**12 + 3] * 2)
    x = np.array([[2 ** 40, -2 ** 40], [100_000, 100_001]])
    want = [sum((10**7 * int(v) - 10**12 - 3) ** 2 for v in r) for r in x]
    assert centre.deviations(x) == want and want[0] > 2 ** 63
