"""Whitening: exact sums, covariance against fractions, components against numpy."""

import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq

from lontar.llm import whitening

ROWS = "vec_id long, embedding array<float>, label int, n string, vector string, component string"


def made(spark, rows, parts=3, **more):
    given = spark.createDataFrame([(i, v, 0, "n", "v", "c") for i, v in rows], ROWS).repartition(parts)
    return whitening.whitened(given, **more).collect()


def brute(vectors):
    """Exact sums and covariance, then numpy's eigenvectors."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in np.asarray(vectors, np.float32)]
    n, d = len(x), len(x[0])
    total = [sum(r[k] for r in x) for k in range(d)]
    apart = [[n * c - s for c, s in zip(r, total, strict=True)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in apart), n**3)) for j in range(d)] for i in range(d)])
    return n, cov, [sum(c * c for c in r) for r in apart], np.array(apart, float) / n


def test_against_fractions(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(200, 10)) * np.geomspace(1, 0.2, 10)).astype(np.float32).tolist()
    bad = [(900, None), (901, [1.0] * 9 + [None]), (902, [float("nan")] * 10), (903, [float("inf")] + [0.0] * 9), (904, []), (905, [1.0] * 4), (906, [1e30] * 10)]
    got = made(spark, [*enumerate(vectors), *bad])
    n, cov, deviation, apart = brute(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 200 * 8 and {r.n for r in got} == {n}
    for r in got:
        k = r.component - 1
        want = abs(apart[r.vec_id] @ axes[:, k]) / math.sqrt(values[k])
        assert r.deviation == deviation[r.vec_id] and abs(abs(r.whitened) - want) < 1e-10
        assert abs(r.explained - values[k] / values.sum()) < 1e-12 and r.identity_error < 1e-10


def test_few_dimensions_constant_entries_repeated_and_no_rows(spark):
    got = made(spark, [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, -1.0]), (2, [0.5, 0.25])])
    assert {r.component for r in got} == {1} and len(got) == 4 and got[0].explained == 1.0
    assert made(spark, [(1, [0.5, 1.0])]) == [] and made(spark, [(1, [0.5, 1.0])] * 3) == [] and made(spark, [(1, None)]) == [] and made(spark, []) == []
    assert {r.component for r in made(spark, [(i, [i * 0.1, i * i * 0.01, (i % 3) * 0.2]) for i in range(20)], components=2)} == {1, 2}


def test_sums_keep_what_doubles_lose():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(3000, 3)) * 2.0**40).round()
    mean = whitening._mean(whitening.summed(x, np.zeros_like(x)), len(x))
    parts = list(whitening.products(x, mean))
    high, low = whitening.summed(np.stack([p[0] for p in parts]), np.stack([p[1] for p in parts]))
    total = [sum(map(int, x[:, k])) for k in range(3)]
    for at, (i, j) in enumerate(zip(*np.triu_indices(3), strict=True)):
        want = Fraction(sum((len(x) * int(r[i]) - total[i]) * (len(x) * int(r[j]) - total[j]) for r in x), len(x) ** 2)
        size = sum(abs((len(x) * int(r[i]) - total[i]) * (len(x) * int(r[j]) - total[j])) for r in x) / len(x) ** 2
        assert abs(Fraction(float(high[at])) + Fraction(float(low[at])) - want) <= Fraction(size) * Fraction(1, 2**96)


def test_large_deviations():
    x = np.array([[2.0**50, 3.0], [-(2.0**50), 4.0]])
    assert whitening._deviation(x, 2, [0, 7]) == [None, None]
    assert whitening._deviation(np.array([[2.0**31], [0.0]]), 1, [0]) == [2**62, 0]


def test_parts_are_merged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FANIN", 2)
    rows = [(i, [math.sin(i), math.cos(3 * i), i % 7 / 7]) for i in range(300)]
    one, many = ({(r.vec_id, r.component): r for r in made(spark, rows, parts)} for parts in (1, 11))
    assert all(abs(r.whitened - many[k].whitened) < 1e-12 and r.deviation == many[k].deviation for k, r in one.items())


def test_query(spark, sf):
    got = whitening.op12_whitening(spark, sf).collect()
    vectors = pq.read_table(f"{sf}/embeddings.parquet")["embedding"].to_pylist()
    n, cov, deviation, apart = brute(vectors)
    values = np.linalg.eigvalsh(cov)[::-1]
    assert len(got) == 8 * n and sum(r.deviation for r in got) == 8 * sum(deviation)
    z = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(n, 8)
    assert np.abs(z.T @ z / n - np.eye(8)).max() < 1e-10 and all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 for r in got[:8])
