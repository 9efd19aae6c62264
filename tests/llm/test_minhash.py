import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lontar.llm import minhash
from lontar.llm.cluster import cut
from lontar.llm.words import bag

SCHEMA = "doc_id long, text string, lang string, key long, component long"


def brute(rows):
    """Classes by comparing all texts."""
    def shingled(text):
        w = (text or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    texts = sorted({(d, t or "") for d, t in rows if d is not None})
    bags = [shingled(t) for _, t in texts]
    parent = {d: d for d, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            index[s].append(i)
    pairs = {(i, j) for v in index.values() for i in v for j in v if i < j}
    for i in range(len(texts)):
        for j in range(i):
            if texts[i][1] == texts[j][1]:
                pairs.add((j, i))
    for i, j in pairs:
        both = sum((bags[i] & bags[j]).values())
        if texts[i][1] == texts[j][1] or both >= 0.8 * sum((bags[i] | bags[j]).values()):
            a, b = sorted((find(texts[i][0]), find(texts[j][0])))
            parent[b] = a
    return {d: find(d) for d in parent}


def result(spark, given, **kw):
    df = spark.createDataFrame([(d, t, None, 1, 2) for d, t in given], SCHEMA)
    return sorted([tuple(r) for r in minhash.near_duplicates(df, **kw).collect()], key=str)


def test_small_cases(spark):
    long = " ".join(f"w{i}" for i in range(200))
    near = long.replace("w100 ", "other ")
    rows = [(5, long), (3, near), (9, long), (1, "a b"), (2, "a  b"), (4, ""), (6, None), (7, "unlike anything else at all here"), (None, long), (8, " ".join(["x"] * 50)), (10, " ".join(["x"] * 20)), (7, "unlike anything else at all here")]
    got = result(spark, rows)
    want = brute(rows)
    assert len(got) == len(rows)
    for doc, component, kept in got:
        if doc is None:
            assert component is None and kept
        else:
            assert component == want[doc] and kept == (doc == component)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for d in range(60):
        words = list(base)
        for p in rng.choice(120, 2, replace=False):
            words[p] = f"edit{d}_{p}"
        rows.append((d, " ".join(words)))
    rows.append((60, " ".join(base)))
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 10)
    assert {d: c for d, c, _ in result(spark, rows)} == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_contract_and_lose_no_link(spark, monkeypatch, seed):
    """Chains and clusters of texts in one candidate group, in blocks of five."""
    rng = np.random.default_rng(seed)
    rows, base = [], [f"v{i}" for i in range(80)]
    for d in range(90):
        words = list(base)
        for p in range(0, int(rng.choice([0, 1, 2, 3])) * 3, 3):
            words[(p + 7 * (d % 4)) % 80] = f"edit{d % 12}_{p}"
        rows.append((d, " ".join(words)))
        if d % 9 == 0:
            base[int(rng.integers(80))] = f"moved{d}"
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 5)
    assert {d: c for d, c, _ in result(spark, rows, bands=100, rows=2)} == brute(rows)


def test_signatures_estimate_weighted_jaccard():
    a, b = "x " * 9 + "y " * 5 + "z q r", "x " * 5 + "y " * 8 + "z s t"
    sig = minhash.sign([bag(a, 1), bag(b, 1)], 4096)
    assert abs((sig[0] == sig[1]).mean() - (5 + 5 + 1) / (9 + 8 + 1 + 1 + 1 + 1 + 1)) < 0.03


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in minhash.op1_minhash(spark, sf).collect()}
    assert got == brute(rows)


def test_one_rule_for_groups_of_every_size(spark, monkeypatch):
    """Few bands miss many pairs; which ones must not depend on how a group is cut up."""
    rng = np.random.default_rng(8)
    rows, base = [], [f"v{i}" for i in range(60)]
    for d in range(70):
        words = list(base)
        for p in rng.choice(60, int(rng.integers(0, 3)), replace=False):
            words[p] = f"edit{d}_{p}"
        rows.append((d, " ".join(words)))
    found = []
    for texts, most in ((400, 40), (5, 40), (5, 0), (7, 3)):
        monkeypatch.setattr(minhash, "BLOCK_TEXTS", texts)
        monkeypatch.setattr(minhash, "MOST_BLOCKS", most)
        found.append(result(spark, rows, bands=6, rows=6))
    assert all(f == found[0] for f in found) and 1 < len({c for _, c, _ in found[0]}) < 70
    assert {d: c for d, c, _ in found[0]} != brute(rows)


def test_steps_leave_no_shuffle_files(spark):
    """What a step shuffled goes when the step is kept, so that disks don't hold the shuffles of all steps."""
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    before, rows = held(), spark.range(1000).repartition(3)
    got = cut(rows.groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # files are removed beside the query
        left = {f for f in held() - before if f.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.1)
    assert not left and sorted(r["count"] for r in got.collect()) == [142] * 1 + [143] * 6
    assert cut(rows.groupBy().count()).first()[0] == 1000
