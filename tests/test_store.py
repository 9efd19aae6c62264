"""Stores in buckets, readiness from changes, stores with many writers."""

import os
import random

from pyspark.sql import functions as F

from lontar.operators import readiness, store


def drawn(rng, name):
    texts = ["", "Text", "Giá $5", "ข้อความ", "{n} items", "a (s)"]
    values = {c: {r: rng.choice(texts) for r in ("neutral", "formal", "casual") if rng.random() < 0.5} for c in ("en", "vi", "th") if rng.random() < 0.8}
    return ("p", name, None, values, [c for c in ("vi", "th") if rng.random() < 0.3], rng.random() < 0.1)


def shown(frame):
    return sorted(((r.project_id, r.name, r["values"], sorted(r.draft or []), r.regulated) for r in frame.collect()), key=lambda r: r[:2])


def stamps(folder):
    return {d: max(os.stat(os.path.join(folder, d, f)).st_mtime_ns for f in os.listdir(os.path.join(folder, d))) for d in os.listdir(folder) if d.startswith("bucket=")}


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    rng = random.Random(2)
    rows = [drawn(rng, f"k{i}") for i in range(600)]
    keys = spark.createDataFrame(rows, store.KEYS)
    held = store.Buckets(spark, str(tmp_path / "keys"), buckets=40)
    held.create(keys)
    assert shown(held.table()) == shown(keys)
    before = stamps(tmp_path / "keys")
    entries = spark.createDataFrame([("k5", "new"), ("k77", "new"), ("fresh", "new")], "name string, value string")
    want = store.import_entries(keys, entries, "p", "vi").drop("action").select(*keys.columns)
    want = spark.createDataFrame(want.collect(), keys.schema)
    rewritten = store.import_into(held, entries, "p", "vi")
    after = stamps(tmp_path / "keys")
    assert 1 <= len(rewritten) <= 3 and {d for d in after if after[d] != before.get(d)} == {f"bucket={b}" for b in rewritten}
    assert shown(held.table()) == shown(want)
    gone = spark.createDataFrame([("p", "k9"), ("p", "nope")], "project_id string, name string")
    assert len(held.upsert(keys.limit(0), gone)) == 1
    assert shown(held.table()) == shown(store.delete_keys(want, gone)) and held.upsert(keys.limit(0)) == []
    last = [(r.project_id, r.name) for r in held.table().select("project_id", "name").collect()]
    held.upsert(keys.limit(0), spark.createDataFrame(last, "project_id string, name string"))
    assert held.table().count() == 0  # also where whole buckets are deleted


def test_readiness_from_changes(spark):
    rng = random.Random(3)
    locales = ["en", "vi", "th"]
    rows = {f"k{i}": drawn(rng, f"k{i}") for i in range(80)}
    frame = lambda names, table: spark.createDataFrame([table[n] for n in names if n in table], store.KEYS)
    counts = readiness.store_counts(frame(rows, rows), locales)
    for step in range(2):
        new = dict(rows)
        touched = rng.sample(sorted(rows), 6) + [f"new{step}"]
        for name in touched:
            if rng.random() < 0.3:
                new.pop(name, None)
            else:
                new[name] = drawn(rng, name)
        moved = readiness.moved_counts(counts, frame(touched, rows), frame(touched, new), locales)
        full = readiness.store_counts(frame(new, new), locales)
        pick = lambda f: sorted(tuple(r) for r in f.select("locale", *readiness._COUNTS).collect())
        assert pick(moved) == pick(full)
        score = lambda f: sorted((r.locale, r.score, r.grade) for r in readiness.score_readiness(f).collect())
        assert score(moved) == score(full)
        rows, counts = new, spark.createDataFrame(moved.collect(), moved.schema)


def test_versions_are_claimed_and_whole(spark, tmp_path):
    held = store.FolderStore(spark, str(tmp_path))
    assert not held.exists("t")
    held.put("t", spark.range(1))
    os.makedirs(tmp_path / "t/store_version=1")  # another writer is still at work
    (tmp_path / "t/_claimed-1").touch()
    assert held.table("t").count() == 1
    held.put("t", spark.range(3))
    assert held.table("t").count() == 3 and sorted(held._versions("t", "store_version=")) == [0, 2]
