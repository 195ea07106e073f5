"""The operators on embeddings against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedscope.llm import hard_negatives, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "g", "kind", "x", "norm", "angles", "scores", "n", "width", "ids", "at", "v", "anchor", "number", "k", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def odd_rows(seed, n=400, dims=6, labels=4):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        label = int(rng.integers(labels))
        v = [float(x) for x in rng.standard_normal(dims).round(2) + (label == 1)]
        rows.append([int(rng.integers(0, 300)) if k % 9 else k * 100, v, label])
    rows += [[700, [0.0] * dims, 2], [800, [1.0, 2.0], 1], [900, [], 1], [None, [1.0] * dims, 1], [None, [1.0] * dims, 2]]  # zero, short, empty, no id
    rows += [[1000, None, 1], [1100, [1.0, None] + [0.0] * (dims - 2), 1], [1200, [math.nan] * dims, 1], [1300, [math.inf] + [0.0] * (dims - 1), 2], [1400, [1.0] * dims, None]]
    rows += [list(rows[3]) for _ in range(40)] + [list(rows[0])] * 2  # copies, an anchor among them
    return rows


def usable(rows, scale):
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    for i, v, label in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            yield i, [math.floor(scale * float(np.float32(c))) for c in v] + [0] * (width - len(v)), label


def brute_negatives(rows):
    live = [(i, x, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, x, label in usable(rows, 256) if label is not None]
    out = []
    for at, (i, x, label) in enumerate(live):
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), j is None, j or 0, other == label) for k, (j, y, other) in enumerate(live) if k != at))
        for s, no_id, j, _ in [r for r in scored if r[3]][:5]:
            for rank, (t, none, m, _) in enumerate([r for r in scored if not r[3] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5], 1):
                out.append((i, None if no_id else j, rank, None if none else m, -s, -t))
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_GROUP", 40)  # several groups
    rows = odd_rows(seed)
    got = sorted(repr(tuple(r)) for r in hard_negatives.mine(table(spark, rows)).collect())
    assert got == brute_negatives(rows)


def test_hard_negatives_of_little(spark):
    assert hard_negatives.mine(table(spark, [])).collect() == []
    assert hard_negatives.mine(table(spark, [[100, None, 1], [200, [math.nan], 2]])).collect() == []
    assert hard_negatives.mine(table(spark, [[100, [1.0], 1]])).collect() == []
    two = hard_negatives.mine(table(spark, [[100, [1.0, 0.0], 1], [1, [1.0, 0.0], 1], [2, [0.9, 0.0], 2]])).collect()
    assert [tuple(r) for r in two] == [(100, 1, 1, 2, 65536, 230 * 256)]


def test_score_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (300, 12)) * rng.integers(0, 2, (300, 1))
    x[21] = range(12)
    x[50:80] = x[20:50] * 3  # same and opposite directions, where angles lose most
    x[80:110] = -x[20:50]
    refs = np.linalg.qr(rng.standard_normal((12, 5)))[0]
    refs[:, 0] = x[21] / np.linalg.norm(x[21])
    norm = np.linalg.norm(x, axis=1)
    angles = np.arccos(np.clip((x @ refs) / np.where(norm > 0, norm, 1)[:, None], -1, 1)).astype(np.float32)
    b = pa.record_batch([pa.array(range(300), pa.int64()), pa.array([None] * 300, pa.int64()), pa.array([1] * 300, pa.int64()), vectors.blobs(x.astype(np.int64)), pa.array(norm), vectors.blobs(angles), pa.array([[]] * 300, pa.list_(pa.int64()))], names=["row", "vec_id", "label", "x", "norm", "angles", "scores"])
    rows = hard_negatives.Rows([b], 12, 5)
    low, high = hard_negatives.score_bounds(rows, rows)
    s = x @ x.T
    assert (low <= s).all() and (s <= high).all()
    assert (high - low)[21].max() < 3 + 1e-3 * norm[21] * norm.max()  # beside a reference they are the score itself
    some = rng.random(s.shape) < 0.01
    assert (hard_negatives.exact_scores(rows, rows, some) == s[some]).all()
    assert (hard_negatives.exact_scores(rows, rows, s == s) == s.ravel()).all()


def test_large_scores_are_exact():
    x = np.array([[3, 2**31 + 1], [2**30, 5]], np.int64)
    b = pa.record_batch([pa.array([0, 1], pa.int64()), pa.array([0, 1], pa.int64()), pa.array([1, 1], pa.int64()), vectors.blobs(x), pa.array([1.0, 1.0]), vectors.blobs(np.zeros((2, 1), np.float32)), pa.array([[]] * 2, pa.list_(pa.int64()))], names=["row", "vec_id", "label", "x", "norm", "angles", "scores"])
    rows = hard_negatives.Rows([b], 2, 1)
    want = [sum(int(u) * int(v) for u, v in zip(p, q, strict=True)) for p in x for q in x]
    assert hard_negatives.exact_scores(rows, rows, np.ones((2, 2), bool)).tolist() == want


def brute_whitening(rows):
    live = list(usable([(i, v, 0) for i, v, _ in rows], 1024))
    x = np.array([r[1] for r in live], object) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    c = np.array([[float(n * a - t) / n for a, t in zip(r, s, strict=True)] for r in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    return [r[0] for r in live], n, deviation, c, e[::-1], u[:, ::-1]


def check_whitening(spark, rows, most=8):
    got = whitening.whitened(table(spark, rows)).toPandas()
    ids, n, deviation, c, e, u = brute_whitening(rows)
    k = min(most, len(e))
    assert len(got) == n * k and set(got.n) == {n}
    z = np.where(e[:k] > 1e-9 * e[0], c @ u[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300)), np.nan)
    key = lambda i: -1.0 if i is None or i != i else float(i)
    for j in range(k):
        part = got[got.component == j + 1]
        assert sorted((key(i), int(d)) for i, d in zip(part.vec_id, part.deviation, strict=True)) == sorted((key(i), d) for i, d in zip(ids, deviation, strict=True))
        assert np.allclose(part.explained, max(e[j], 0) / e.sum(), rtol=1e-9, atol=1e-12)
        if np.isnan(z[:, j]).all():
            assert part.whitened.isna().all()
            continue
        gap = min(abs(e[j] - e[i]) for i in range(len(e)) if i != j) / e[0]
        if gap > 1e-6:
            mine = np.array([v for _, v in sorted(zip(map(key, part.vec_id), part.whitened, strict=True))])
            want = [np.array([v for _, v in sorted(zip(map(key, ids), sign * z[:, j], strict=True))]) for sign in (1, -1)]
            assert min(np.abs(mine - w).max() for w in want) < 1e-13 / gap + 1e-10
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


def test_whitening_by_direct_eigenvectors(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(spark, rows)
    check_whitening(spark, odd_rows(4, dims=12))


def test_whitening_of_low_rank(spark):
    rng = np.random.default_rng(5)
    flat = np.zeros((60, 10))
    flat[:, :3] = rng.standard_normal((60, 3)).round(2)
    check_whitening(spark, [[k, [float(c) for c in v], 1] for k, v in enumerate(flat)])
    check_whitening(spark, [[k, [float(c), -float(c)], 1] for k, c in enumerate(rng.standard_normal(9).round(2))])


def test_whitening_of_little(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [[1, None, 1], [2, [math.nan], 1], [3, [], 1]])).collect() == []
    one = whitening.whitened(table(spark, [[7, [0.5, 1.0, 2.0], None]])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(7, k, 1, 0, None, 0.0) for k in (1, 2, 3)]


@pytest.mark.parametrize("kind", ["clustered", "equal", "spread"])
def test_jacobi_davidson(kind):
    rng = np.random.default_rng(6)
    d = 150
    e = {"clustered": np.r_[[5.0, 4.999, 4.998, 4.0], np.linspace(3.9, 1, d - 4)], "equal": np.r_[[3.0] * 5, [2.0] * 6, np.linspace(1, 0, d - 11)], "spread": np.logspace(6, -6, d)}[kind]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    passes = []
    values, u = whitening.leading(lambda w: (passes.append(w.shape[1]), v @ w)[1], d, 8)
    assert np.abs(values - e[:8]).max() < 1e-13 * e[0]
    assert np.abs(u.T @ u - np.eye(8)).max() < 1e-13
    assert np.linalg.norm(v @ u - u * values, axis=0).max() < 1e-12 * e[0]
    assert len(passes) < 300


def test_deviations_that_do_not_fit():
    x = np.array([[2**40, 0], [1, 1]], np.int64)
    got = whitening._deviations(x, 2, x.sum(axis=0))
    assert got == [None, None]
    assert whitening._deviations(x[1:], 1, x[1:].sum(axis=0)) == [0]
