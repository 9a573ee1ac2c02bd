from __future__ import annotations

import numpy as np
import pytest

from tidegauge.llm import queries, whitening


def brute(rows):
    """{vec_id: (deviation, whitened 4)} and shares, from numpy's own eigenvectors."""
    x = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in rows}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=np.float64)
    n, total = len(fit), [int(t) for t in fit.sum(axis=0)]
    y = fit - np.array(total) / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:4]
    values, vectors = values[order], vectors[:, order]
    out = {}
    for i, v in x.items():
        deviation = sum((n * a - t) ** 2 for a, t in zip(v, total))
        out[i] = deviation, (np.array(v) - np.array(total) / n) @ vectors / np.sqrt(values)
    return n, out, values / np.trace(cov)


def check(found, rows):
    n, wanted, shares = brute(rows)
    by: dict = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(wanted)
    signs = None
    for i, (deviation, whitened) in wanted.items():
        mine = [by[i][c] for c in range(1, len(shares) + 1)]
        assert {r["n"] for r in mine} == {n} and {r["deviation"] for r in mine} == {deviation}
        got = np.array([r["whitened"] for r in mine])
        if signs is None and np.all(np.abs(whitened) > 1e-6):
            signs = np.sign(got * whitened)
        assert np.allclose(np.abs(got), np.abs(whitened), atol=1e-9, rtol=1e-9)
        if signs is not None:
            assert np.allclose(got * signs, whitened, atol=1e-9, rtol=1e-9)
        assert np.allclose([r["explained"] for r in mine], shares, rtol=1e-9)
        assert mine[0]["identity_error"] < 1e-9


def test_against_eigh_with_bad_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((9, 9)) * np.array([3, 2, 1.5, 1, 0.6, 0.4, 0.2, 0.1, 0.05])
    rows = [(i, [float(c) for c in np.float32(rng.standard_normal(9) @ mix.T)]) for i in range(300)]
    rows += [(i + 1000, v) for i, v in rows[:40]]
    bad = [(5000, None), (5001, [1.0] * 8 + [None]), (5002, [float("nan")] * 9), (5003, [float("inf")] * 9), (5004, [1.0] * 3)]
    schema = "vec_id long, embedding array<float>, x int, component string, size int"
    df = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows + bad], schema)
    check(whitening.whiten(df).collect(), rows)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.QUERIES["op13_whitening"](spark, sf).collect(), rows)


def test_few_or_no_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, None)])).collect() == []
    assert whitening.whiten(make([(1, [])])).collect() == []
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect() == []
    two = whitening.whiten(make([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (None, [3.0, 2.0])])).collect()
    assert sorted(round(abs(r["whitened"]), 9) for r in two) == [1, 1, 1] and {r["component"] for r in two} == {1}
    assert {r["n"] for r in two} == {2} and sorted((r["vec_id"] or 0) for r in two) == [0, 0, 1]


def test_equal_eigenvalues_and_small_gaps():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    for spectrum in ([5, 5, 5, 5, 5, 1, 0, 0, 0, 0, 0, 0], [1e6, 3, 2, 1 + 1e-3, 1, 0.5, 0, 0, 0, 0, 0, 0],
                     list(range(12, 0, -1)), [1, 1e-3, 1e-6, 1e-9, 0, 0, 0, 0, 0, 0, 0, 0]):
        matrix = (q * np.array(spectrum, dtype=float)) @ q.T
        matrix = (matrix + matrix.T) / 2
        values, vectors = whitening.leading(matrix, 4)
        assert np.allclose(values, spectrum[:4], rtol=1e-6, atol=1e-9 * spectrum[0])
        assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-10)
        assert np.linalg.norm(matrix @ vectors.T - vectors.T * values) <= 1e-11 * spectrum[0]


def test_inertia_counts_and_missing_eigenvectors():
    rng = np.random.default_rng(2)
    matrix = rng.standard_normal((20, 20))
    matrix = matrix @ matrix.T
    values = np.linalg.eigvalsh(matrix)
    parts = whitening.tridiagonal(matrix)
    for shift in (0.0, 1.0, 10.0, 40.0):
        assert whitening.count_above(*parts, shift) == int((values > shift).sum())
    with pytest.raises(ArithmeticError):
        whitening.feast(matrix, values[-3] - 0.01, values[-1] + 1, 5)


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 40, 0], [3, 4]], dtype=np.int64)
    assert whitening._deviations(x, 5, (10, 10)) == [None, 25 + 100]
