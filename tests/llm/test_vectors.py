import math

import numpy as np
import pytest

from lontar.llm import search, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.93):
    good = [i for i, (v, x, label) in enumerate(rows) if v is not None and label is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, i in enumerate(good):
        for j in good[:a]:
            x, y = np.asarray(rows[i][1], np.float32).astype(float), np.asarray(rows[j][1], np.float32).astype(float)
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0]) if r[0] is not None else None
    return sorted([(r[0], links[i], low[find(i)]) for i, r in enumerate(rows)], key=str)


def clustered(rng, n, dims):
    centres = rng.standard_normal((12, dims))
    return [(int(i), (centres[rng.integers(12)] + rng.standard_normal(dims) * rng.choice([0.05, 0.2, 0.5])).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("dims", [2, 16])
def test_against_all_pairs(spark, dims, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 8)
    rows = clustered(np.random.default_rng(dims), 300, dims)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(20)]
    got = vectors.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), interval=16).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_edges(spark):
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, float("nan")], 0), (4, [1.0, None], 0), (5, [1.0, 0.0], None), (6, [1.0, 0.0], 0), (7, [2.0, 0.0], 0), (None, [1.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [], 0), (10, [float("inf"), 1.0], 0), (7, [2.0, 0.0], 0), (11, [3e38, 0.0], 0)]
    got = vectors.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert by[6] == (3, 6) and by[7] == (3, 6) and by[11] == (3, 6) and by[8] == (0, 8)
    assert all(by[i] == (0, i) for i in (1, 2, 3, 4, 5, 9, 10)) and by[None] == (0, None)
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 24)).astype(np.float32)
    x[:2000] /= np.linalg.norm(x[:2000], axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    got = search.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 4000, 20))
    d, hit = x.astype(np.float64), 0
    for q, own in by.items():
        assert [r.rank for r in own] == list(range(1, 21)) and all(r.vec_id != q for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - d[q] @ d[r.vec_id]) < 1e-9 for r in own)
        s = d @ d[q]
        s[q] = -np.inf
        hit += len({r.vec_id for r in own} & set(np.argsort(-s)[:20].tolist()))
    assert hit / (20 * len(by)) >= 0.9


def test_probing_finds_every_code_in_radius():
    """Pigeonhole: a code within parts * (radius + 1) - 1 bits agrees within the radius in at least one substring."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((800, 16))
    x[400:] = x[:400] + 0.3 * rng.standard_normal((400, 16))
    codes = search.Codes.learned(x, np.linalg.norm(x, axis=1).max(), 800)
    codes.length, codes.parts = 12, 5
    index = search.MultiIndex(codes, x)
    held, asked = (codes.bits(v)[:, :60] for v in (codes.lengthened(x), codes.asked(x)))
    for radius in (0, 1, 2):
        marks = index.fetched(codes.values(codes.asked(x[:50])), radius)
        apart = (asked[:50, None, :] ^ held[None, :, :]).reshape(50, 800, 5, 12).sum(axis=3)
        assert (marks == (apart.min(axis=2) <= radius)).all()
        assert marks[apart.sum(axis=2) <= 5 * (radius + 1) - 1].all()


def test_clusters_are_searched_by_a_small_share():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 32))[rng.integers(0, 200, 8000)] + 0.3 * rng.standard_normal((8000, 32))
    block = search.Block(x, np.arange(8000), search.Codes.learned(x[:6000], np.linalg.norm(x, axis=1).max(), 8000), 20)
    hit, asked = 0, np.arange(0, 8000, 40)
    got = {}
    for q, v, _ in block.answer(x[asked], asked):
        got.setdefault(q, set()).add(v)
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert block.seen < 0.2 * block.asked * 8000 and hit >= 0.9 * 20 * len(asked)


def test_search_query(spark, sf):
    x = {r.vec_id: np.asarray(r.embedding, np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got, hit = {}, 0
    for r in search.op8_multi_index(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12
    assert set(got) == {i for i in x if i % 20 == 0}
    for q, found in got.items():
        assert [k for k, _ in sorted(found)] == list(range(1, 21))
        hit += len({v for _, v in found} & set(sorted((i for i in x if i != q), key=lambda i: (-(x[q] @ x[i]), i))[:20]))
    assert hit >= 0.9 * 20 * len(got)


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0], 0, "x"), (1, [1.0, 0.0], 0, "x"), (2, [1.0, 0.0], 0, "x"), (20, [0.0, 0.0], 0, "x"), (3, None, 0, "x"), (4, [1.0, None], 0, "x"), (None, [1.0, 0.0], 0, "x"), (1, [1.0, 0.0], 0, "x")]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in search.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert search.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
