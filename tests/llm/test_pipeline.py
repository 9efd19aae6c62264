"""Each stage of the pipeline on its own input, and all of them together."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from lontar.llm import lines, minhash, packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage took and gave, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, []
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, SF)
        rows = made.collect()
        out.append((name, docs.collect(), rows))
        if name != pipeline.STAGES[-1][0]:
            assert made.columns == columns
            docs = spark.createDataFrame(rows, made.schema)
    return {name: (before, after) for name, before, after in out}


def test_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "source mix", "best-fit packing"]


def test_classifier_keeps_clean_documents(spark, stages):
    before, after = stages["quality classifier"]
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d, r in labels.items() if r.quality and not r.toxic]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean) and {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert sum(d in kept for d, r in labels.items() if not r.quality) <= 0.2 * sum(not r.quality for r in labels.values())


def test_lines_go(spark, stages):
    before, after = stages["line dedup"]
    from test_tables import brute_lines

    want = {d: t for d, n, gone, t in brute_lines([(r.doc_id, r.text, r.source) for r in before]) if gone < n or not gone}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_one_of_each_class_stays(spark, stages):
    from test_minhash import brute

    before, after = stages["near dedup"]
    classes = brute([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {d for d, c in classes.items() if d == c}


def test_one_row_of_each_class_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(7, a, 0), (7, a, 1), (None, a, 2), (None, b, 3), (None, b + " end", 4), (9, a, 5), (9, c, 6), (8, d, 7), (8, d, 8), (6, d, 9), (None, d, 10), (None, None, 11), (None, "", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    after = pipeline.near_dedup(spark, docs, SF)
    got = after.collect()
    assert after.columns == docs.columns and {tuple(r) for r in got} <= set(rows)
    assert sorted((r.doc_id or 0, (r.text or "-")[0]) for r in got) == [(0, "-"), (0, "b"), (6, "d"), (7, "a"), (9, "c")]


def test_mix_takes_effect(spark, stages):
    from test_tables import brute_targets

    before, after = stages["source mix"]
    words = lambda t: len((t or "").split())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    for r in after:
        taken[r.source] += words(r.text)
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert max(Counter(r.doc_id for r in after).values()) <= 3 and {r.text for r in after} <= {r.text for r in before}


def test_packing_holds_every_token(stages):
    before, after = stages["best-fit packing"]
    encoder = packing.Encoder(packing.tokenizer_path())
    tokens = Counter()
    for r in before:
        tokens[r.doc_id] += len(encoder.encode(r.text or "")) // 4 + 1
    got = Counter()
    for r in after:
        got[r.doc_id] += r.length
    assert got == tokens
    load = Counter()
    for r in after:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= packing.LENGTH


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", "a", 10), (3, "long " * 20_000, "en", "b", 100_000), (4, "twice", "en", "b", 5), (4, "twice", "en", "b", 5)]


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and an empty table pass through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("odd", ODD), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        made = pipeline.run(spark, folder).collect()
        assert bool(made) == bool(data)
    assert lines.SHORTEST == 40 and minhash.THRESHOLD == 0.8


CLASHING = ["expected_grade", "p_keep", "n_lines", "n_dropped", "__row", "__doc", "__gone", "__h1", "__copies", "component_id", "node", "id", "first", "size", "copies", "row"]


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES[:-1]], ids=[n for n, _ in pipeline.STAGES[:-1]])
def test_stages_on_odd_rows_and_clashing_names(spark, tmp_path, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(*r, *CLASHING) for r in ODD], schema)
    got = stage(spark, docs, str(tmp_path))
    rows = got.collect()
    assert got.columns == docs.columns and all(list(r)[5:] == CLASHING for r in rows)
    texts = Counter(r.text or "" for r in rows)
    given = Counter(r[1] or "" for r in ODD)
    if stage in (pipeline.quality_classifier, pipeline.line_dedup):
        assert texts == given
    elif stage is pipeline.near_dedup:
        assert texts == dict.fromkeys(given, 1) and {r.doc_id for r in rows if not r.text} == {1}
    else:
        assert all(n <= 3 * given[t] for t, n in texts.items())
    assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
