"""Files of many projects at once, and the data sources that read and write them."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lontar.operators import export, store
from lontar.plans import file_queries
from lontar.sources import bundle_files


def tree(pairs):
    """Keys set one after the other, by name, in nested tables; a text in the way of a branch stops the walk there."""
    root = {}
    for name, value in sorted(pairs):
        *ways, last = name.split(".")
        node = root
        for way in ways:
            if isinstance(node.get(way), str):
                break
            node = node.setdefault(way, {})
        node[last] = value
    return root


def keys_frame(spark, rows):
    """rows: (project, name, {locale: text})."""
    return spark.createDataFrame([(p, n, None, {c: {"neutral": t} for c, t in texts.items()}, [], False) for p, n, texts in rows], store.KEYS)


def files_of(parts):
    rows = {}
    for r in parts.collect():
        rows.setdefault(r.file, []).append((r.pos, r.text))
    return {name: "".join(t for _, t in sorted(own)) for name, own in rows.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nested_json_of_drawn_keys(spark, seed):
    """Conflicts of texts and branches, chains of them too, odd letters and escapes, in several projects."""
    rng = random.Random(seed)
    names = sorted({(f"p{rng.randrange(3)}", ".".join(rng.choice(["a", "b", "c", "a-x", "é", "", 'q"'][: rng.choice([3, 7])]) for _ in range(rng.randint(1, 4)))) for _ in range(90)})
    rows = [(p, n, {"en": f"{p} {n} \"x\" \\ \n é", "vi": "v" + n if rng.random() < 0.5 else ""}) for p, n in names]
    got = files_of(export.export_parts("json", keys_frame(spark, rows).repartition(5), ["en", "vi"]))
    for code in ("en", "vi"):
        for p in {p for p, _, _ in rows}:
            pairs = [(n, t[code]) for q, n, t in rows if q == p and t[code]]
            body = got.pop(f"{p}/{code}.json", "{}")
            want = tree(pairs)
            assert json.loads(body) == want
            assert body == json.dumps(json.loads(body), indent=2, ensure_ascii=False)
    assert not got


def test_flat_files_of_many_projects(spark):
    rows = [(p, f"k{i:02}", {"en": f"text {i}"}) for p in ("p", "q") for i in range(30)] + [("none", "k", {})]
    keys = keys_frame(spark, rows)
    csv = files_of(export.export_parts("csv", keys, ["en", "vi"]))
    assert csv["p/translations-neutral.csv"].split("\n") == ["key,description,en,vi", *(f"k{i:02},,text {i}," for i in range(30))]
    assert csv["none/translations-neutral.csv"] == "key,description,en,vi\nk,,,"
    android = files_of(export.export_parts("android", keys, ["en"]))
    assert set(android) == {"p/strings-en.xml", "q/strings-en.xml"} and android["q/strings-en.xml"].count("<string ") == 30 and android["q/strings-en.xml"].endswith("</string>\n</resources>\n")
    ios = files_of(export.export_parts("ios", keys, ["en"]))
    assert ios["p/Localizable-en.strings"].count("\n") == 30 and ios["p/Localizable-en.strings"].endswith(";\n")
    empty = {f: export.export_keys(f, keys.limit(0), ["en"]).first().body for f in export.FORMATS}
    assert empty == {"json": "{}", "csv": "key,description,en", "android": export.EMPTY["android"], "ios": "\n"}


def test_bundles_are_written_and_read(spark, tmp_path, monkeypatch):
    rows = [(f"p{i % 7}", f"a.b{i % 3}.k{i:03}", {"en": f"text {i}", "th": f"ข้อความ {i}"}) for i in range(300)]
    keys = keys_frame(spark, rows).repartition(6)
    folder = str(tmp_path / "out")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    export.write_exports(export.export_parts("json", keys, ["en", "th"]), folder)
    assert sorted(os.listdir(folder)) == [f"p{i}" for i in range(7)] and not [d for d in os.listdir(folder) if d.startswith("_")]
    monkeypatch.setattr(bundle_files, "BYTES", 2000)
    got = bundle_files.read_bundle_files(spark, folder)
    assert sorted((r.project, r.key, r.locale, r.value) for r in got.collect()) == sorted((p, n, c, t) for p, n, texts in rows for c, t in texts.items())
    assert got.select("project").distinct().count() == 7
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    (tmp_path / "out/p1/vi.json").write_text('{"x.y": "flat", "x": {"y": "deep"}, "n": {"one": "1", "other": "2"}}')
    more = [(r.key, r.plural, r.value) for r in bundle_files.read_bundle_files(spark, folder).where("locale = 'vi'").orderBy("key", "plural").collect()]
    assert more == [("n", "one", "1"), ("n", "other", "2"), ("x.y", None, "flat")]
    (tmp_path / "out/p1/bad.json").write_text("{")
    with pytest.raises(Exception, match="p1/bad.json"):
        bundle_files.read_bundle_files(spark, folder).collect()


def test_keys_are_dealt_out_and_never_broadcast(spark, sf, tmp_path, monkeypatch):
    """However large or small the file of the parts is, a task has some of them and none has all."""
    monkeypatch.setattr(file_queries, "PARTS", 10)
    keys = file_queries._part_keys(spark, sf)
    held = [r.n for r in keys.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == spark.read.parquet(f"{sf}/part.parquet").count() and max(held) < 40
    clash = spark.createDataFrame([("p", "en", "a", "1"), ("p", "en", "a.b", "2"), ("p", "en", "x", "4")], "project_id string, locale string, name string, value string")
    folder = tmp_path / "flat"
    (folder / "p").mkdir(parents=True)
    (folder / "p/vi.json").write_text('{"x.y": "flat", "x": {"y": "deep", "z": "own"}, "y": "top"}')
    read = bundle_files.read_bundle_files(spark, str(folder))
    places = export.placed(clash)
    for frame in (places, read):
        frame.collect()
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.name, tuple(r.path)) for r in places.collect()) == [("a", ("a",)), ("a.b", ("b",)), ("x", ("x",))]
    assert sorted((r.key, r.value) for r in read.collect()) == [("x.y", "flat"), ("x.z", "own"), ("y", "top")]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    bundle_files.register(spark)
    fails = F.when(F.col("id") == 90, F.raise_error(F.lit("no"))).otherwise("x\n").cast("string")
    rows = spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").select(F.concat(F.lit("f"), (F.col("id") % 100 / 10).cast("int").cast("string")).alias("file"), F.col("id").cast("string").alias("pos"), fails.alias("text"))
    (tmp_path / "w").mkdir()  # the write may fail before any task makes it
    with pytest.raises(Exception):
        rows.write.format("lontar_files").mode("append").save(str(tmp_path / "w"))
    seen = lambda: [f for f in os.listdir(tmp_path / "w") if not f.startswith("_pending-")]  # noqa: E731  other tasks may be killed later
    assert seen() == [] and bundle_files.BundleReader({"path": str(tmp_path / "w")}).partitions()[0].paths == []
    whole = rows.withColumn("text", F.lit("x\n"))
    whole.write.format("lontar_files").mode("append").save(str(tmp_path / "w"))
    assert {f: (tmp_path / "w" / f).read_text() for f in seen()} == {f"f{i}": "x\n" * 10 for i in range(10)}
    whole.where("file = 'f1'").write.format("lontar_files").mode("overwrite").save(str(tmp_path / "w"))
    assert seen() == ["f1"]
    apart = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("a", "2", "x")], "file string, pos string, text string").coalesce(1)
    with pytest.raises(Exception, match="not together"):
        apart.write.format("lontar_files").mode("append").save(str(tmp_path / "w"))
