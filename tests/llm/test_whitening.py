"""Whitening against plain numpy and against whole-number arithmetic."""

import duckdb
import numpy as np
import pytest
from pulseloom.llm import whitening as wh

SF = "/root/testdata/sf0.001"


def brute(vectors):
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s).astype(float) / n
    values, rows = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)
    return x, n, s, values[order], rows.T[order]


def check(rows, vectors, ids, k=4):
    x, n, s, values, axes = brute(vectors)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * k
    signs = [None] * k
    for i, v in zip(ids, x):
        mean_off = np.array([(n * a - b) / n for a, b in zip(v, s)])
        for c in range(k):
            r = got[i, c + 1]
            assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(v, s))
            want = mean_off @ axes[c] / values[c] ** 0.5
            if signs[c] is None and abs(want) > 1e-3:
                signs[c] = np.sign(want * r["whitened"])
            assert abs(want * (signs[c] or 1) - r["whitened"]) < 1e-8 * (1 + abs(want)) or abs(want) <= 1e-3
            assert abs(r["explained"] - values[c] / values.sum()) < 1e-12
            assert r["identity_error"] < 1e-10


def test_query_against_numpy(spark):
    rows = wh.op12_whitening(spark, SF).collect()
    table = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    check(rows, [v for _, v in table], [i for i, _ in table])


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, deviation string, whitened int, b int")


def run(spark, rows, k=4):
    df = frame(spark, [(i, v, "x", 1, 2) for i, v in rows])
    model = wh.fit(df, components=k)
    return model, wh.whiten(df, model).collect()


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(40, 5)) + 1000]
    rows = [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (None, good[4])]
    bad = [(90, None), (91, [1.0, None, 2.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    model, out = run(spark, rows + bad)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in out) == sorted((i is None, i or 0) for i, _ in rows)
    assert model.n == 40 and out[0]["b"] == 2
    x, n, s, values, axes = brute(good)
    assert np.allclose(model.values, values[:4], rtol=1e-12) and model.identity_error < 1e-9
    assert {r["deviation"] for r in out if r["vec_id"] == 3} == {sum((n * a - b) ** 2 for a, b in zip(x[3], s))}


def test_no_variance_and_nothing(spark):
    model, out = run(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])
    assert model.n == 1 and [r["whitened"] for r in out] == [[], []] and [r["deviation"] for r in out] == [0, 0]
    model, out = run(spark, [(1, None)])
    assert model is None and out == []
    model, out = run(spark, [(1, []), (2, [1.0])])
    assert model.n == 2 and len(out) == 2 and abs(model.values[0] - 128**2) < 1e-6


def test_huge_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e15, 2.0])]
    model, out = run(spark, rows)
    assert model.n == 3 and {r["vec_id"]: r["deviation"] for r in out} == {1: None, 2: None, 3: None}
    assert np.isfinite(model.values).all()


@pytest.mark.parametrize("seed", range(6))
def test_slicing_against_numpy(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 40))
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    e = np.sort(rng.exponential(size=d) * 10.0 ** rng.integers(-3, 4, d))[::-1]
    if seed % 2 and d > 3:
        e[1] = e[0]  # a double eigenvalue
        e[3] = e[2] * (1 - 1e-9)  # and a close pair
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    for s in rng.uniform(0, e[0], 8):
        assert wh.count_above(a, s) == int((np.linalg.eigvalsh(a) > s).sum())
    values, rows = wh.leading(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][: len(values)]
    assert len(values) == min(4, d) and np.allclose(values, want, atol=1e-12 * e[0])
    assert np.allclose(rows @ rows.T, np.eye(len(values)), atol=1e-9)
    assert np.abs(a @ rows.T - rows.T * values).max() < 1e-12 * e[0] * d


def test_count_of_indefinite_with_zero_diagonal():
    a = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    assert wh.count_above(a, 0.0) == 1 and wh.count_above(a, -0.5) == 2 and wh.count_above(a, 2.0) == 0
