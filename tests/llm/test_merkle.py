"""Merkle manifests: against a plain build in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from lontar.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, digest string, at int, `group` string, n int, proof int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root over nodes, and for each the steps (before, after) up to it."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(steps)):
            run = at[i] // 16 * 16
            steps[i].append(("".join(nodes[run : at[i]]), "".join(nodes[at[i] + 1 : run + 16])))
            at[i] //= 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def brute(rows):
    by = defaultdict(list)
    for d, s, lang, n, t in rows:
        low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        by[s].append((d is not None, d or 0, leaf(d, s, lang, n, t), leaf(d, s, lang, n, low if hit else t), d))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    root, up = tree([s for s, _ in subs])
    out = []
    for s, (sub, steps), high in zip(sources, subs, up, strict=True):
        for (_, _, own, altered, d), low in zip(sorted(by[s], key=lambda x: x[:3]), steps, strict=True):
            found = altered
            for before, after in [*low, *high]:
                found = h(before, found, after)
            out.append((d, own, sub, root, h(*(b + a for b, a in [*low, *high])), found, found == root))
    return sorted(out, key=str)


def made(spark, rows):
    got = merkle.proved_documents(spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], DOCS))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


ODD = [(1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "abd"), (None, "a", None, None, "No Id"), (None, None, None, None, None), (-7, None, "", 0, ""), (9, "é", "en", 2, "É:-"), (10, "", "en", 1, "X" * 200_000)]


def test_odd_rows(spark):
    assert made(spark, ODD) == brute(ODD)
    assert made(spark, []) == []


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17], [300], [257, 1, 15, 33]])
def test_levels(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(rng.randrange(10**6), f"s{i}", "en", rng.randrange(99), "Text " * rng.randrange(4)) for i, n in enumerate(sizes) for _ in range(n)]
    got = made(spark, rows)
    assert got == brute(rows)


def test_many_sources_and_repeated_rows(spark):
    rows = [(i, f"s{i % 40}", "en", 1, f"Doc {i}") for i in range(200)] + [(5, "s3", "en", 1, "Same")] * 100
    assert made(spark, rows) == brute(rows)


def test_stored_levels_prove_a_document(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", "en", 1, f"Doc {i}") for i in range(100)]
    got = merkle.proved_documents(spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], DOCS), str(tmp_path / "m")).collect()
    stored = spark.read.parquet(str(tmp_path / "m/top/level=0")).first()
    assert {r.root for r in got} == {stored.digest} and len(spark.read.parquet(str(tmp_path / "m/sources/level=0")).collect()) == 3 + 5


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = merkle.op11_merkle(spark, folder).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(merkle.ORACLE).df()[list(got.columns)]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist() and 0 < (~got.verified).sum() < len(got) / 4
