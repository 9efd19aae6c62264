"""Messages, rules, scores, stores, files, evaluation and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lontar import streaming
from lontar.operators import evaluate, export, lint, messages, readiness, store
from lontar.sources import bundles

EN = {"title": "Hello", "cart": {"items": {"one": "{count} item", "other": "{count} items"}, "note": {"formal": "Sir", "casual": "Hey"}}, "flat.key": "flat"}
TH = {"title": "สวัสดี", "cart": {"items": "{count} ชิ้น"}, "flat": {"key": "nested"}}


@pytest.fixture
def table(spark, tmp_path):
    for name, body in (("en", EN), ("th", TH)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, ensure_ascii=False))
    (tmp_path / "notes.txt").write_text("not a bundle")
    return bundles.read_bundles(spark, str(tmp_path))


def test_bundles(spark, table):
    assert {(r.locale, r.key, r.register, r.plural) for r in table.collect()} == {
        ("en", "title", None, None), ("en", "cart.items", None, "one"), ("en", "cart.items", None, "other"), ("en", "cart.note", "formal", None), ("en", "cart.note", "casual", None), ("en", "flat.key", None, None),
        ("th", "title", None, None), ("th", "cart.items", None, None), ("th", "flat.key", None, None),
    }
    plain = bundles.flatten_bundles(spark.createDataFrame([("x", json.dumps({"a": {"formal": "f", "n": [1]}, "b.c": "1", "b": {"c": "2"}}))], "locale string, body string"), message_rule=False)
    assert {(r.key, r.value) for r in plain.collect()} == {("a.formal", "f"), ("b.c", "1")}
    with pytest.raises(Exception, match="bundle zz is not valid JSON"):
        bundles.flatten_bundles(spark.createDataFrame([("zz", "{")], "locale string, body string")).collect()


def test_resolving(spark, table):
    asked = spark.createDataFrame([(1, "th", "cart.items", 1.0, {"count": "one"}), (2, "lo", "cart.note", None, None), (3, "en", "cart.items", 1.0, None), (4, "en", "gone", None, None)], "request_id int, locale string, key string, count double, params map<string,string>")
    got = {r.request_id: (r.text, r.matched_locale, r.missing) for r in messages.resolve_messages(asked, table).collect()}
    assert got == {1: ("one ชิ้น", "th", False), 2: ("Sir", "en", False), 3: ("1 item", "en", False), 4: ("gone", None, True)}
    assert {r.request_id for r in messages.has_message(asked, table).collect()} == {1, 2, 3}
    assert [r.key for r in messages.missing_keys(table, "th").collect()] == ["cart.note"]
    (r,) = messages.coverage(table).collect()
    assert (r.locale, r.total, r.translated, r.missing) == ("th", 4, 3, ["cart.note"])


def test_interpolation_does_not_look_into_values(spark):
    values = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("x$1"))
    assert spark.range(1).select(messages.interpolate(F.lit("{a}{b} {c} { }"), values).alias("v")).first().v == "{b}x$1 {c} { }"


def long(spark, rows):
    return spark.createDataFrame([(c, k, None, None, v, 0) for c, k, v in rows], "locale string, key string, register string, plural string, value string, ord int")


@pytest.mark.parametrize(
    ("locale", "value", "rule"),
    [
        ("vi", "  ", "empty-value"), ("my", "ေက်ာင္း", "zawgyi-encoding"), ("vi", "Tiếng", "vietnamese-nfc"), ("th", "ขอบคุณครับ ", "gendered-particle"), ("id", "file(S)", "hardcoded-plural"),
        ("vi", "{count}  mèo", "missing-classifier"), ("th", "ก" * 41, "no-break-opportunity"), ("vi", "Trả €5", "hardcoded-currency"), ("fil", "5 {count} libro(s)", None), ("tet", "$5", None), ("xx", "", None), ("th", "ก" * 40, None),
    ],
)
def test_rules(spark, locale, value, rule):
    assert [r.rule for r in lint.lint(long(spark, [(locale, "k", value)]), None).collect()] == ([rule] if rule else [])


def test_rules_look_for_what_patterns_hold_before_they_try_them(spark):
    texts = [("id", "Buku(S) ada"), ("id", "Buku(eS)"), ("id", "Buku( s)(ess)"), ("id", "5 €"), ("en", "5 £"), ("id", "$"), ("vi", "{count}  x"), ("vi", "{count} "), ("th", "ไปค่ะ\u00a0"), ("th", "คะไป"), ("th", "𝒂" * 21), ("th", "ก" * 40), ("vi", "ca\u0301 đẹp"), ("vi", "cá – “đẹp”"), ("vi", "\u212b")]
    rows = long(spark, [(code, str(i), text) for i, (code, text) in enumerate(texts)])
    found = lint.lint(rows, None)
    assert sorted((int(r.key), r.rule) for r in found.collect()) == [(0, "hardcoded-plural"), (1, "hardcoded-plural"), (3, "hardcoded-currency"), (5, "hardcoded-currency"), (6, "missing-classifier"), (8, "gendered-particle"), (10, "no-break-opportunity"), (12, "vietnamese-nfc"), (14, "vietnamese-nfc")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "[$€£]" not in plan and "Contains(value#" in plan and all(f", {part})" in plan for part in ("ค", "(", "{count}", "$", "€", "£"))


def test_counts_of_issues(spark):
    found = lint.lint(long(spark, [("en", "a", "Pay {x}"), ("en", "b", "Long text"), ("vi", "a", "Trả {y}"), ("vi", "b", "Long text"), ("th", "a", "จ่าย {x}")]))
    assert {(r.locale, r.errors, r.warnings) for r in lint.issue_counts(found).collect()} == {("vi", 2, 1), ("th", 1, 0)}


def test_readiness(spark):
    counts = spark.createDataFrame([("th", 20, 20, 60, 20, 0, 0), ("vi", 5, 500, 9000, -3, 0, 0), ("lo", 10, 10, 30, 0, 4, 0), ("km", 10, 10, 30, 0, 0, 4)], "locale string, total_keys int, translated_keys int, filled_register_slots int, draft_keys int, errors int, warnings int")
    got = {r.locale: r for r in readiness.score_readiness(counts).collect()}
    assert (got["th"].score, got["th"].grade, got["th"].top_drag) == (85, "B", "reviewed") and (got["vi"].score, got["vi"].top_drag) == (100, None)
    assert [f.score for f in got["lo"].facets][2] == pytest.approx(0.6) and [f.score for f in got["km"].facets][2] == pytest.approx(0.84)
    assert got["vi"].translated_keys == 5 and got["vi"].filled_slots == 15 and got["vi"].draft_keys == 0
    project = readiness.project_readiness(readiness.score_readiness(counts), 88).first()
    assert project.blocking == ["th"] and project.locales[0] == "th" and project.grade == "A"


def test_readiness_of_bundles_and_stores(spark, table):
    r = readiness.readiness_from_bundles(table).first()
    assert (r.locale, r.total_keys, r.translated_keys) == ("th", 4, 3)
    keys = spark.createDataFrame([("p", "a", None, {"en": {"neutral": "A"}, "th": {"neutral": "ก", "formal": ""}}, ["th"], False), ("p", "b", None, {"en": {"neutral": "B"}, "th": {"formal": " "}}, [], False), ("p", "c", None, {"en": {"neutral": "C"}}, ["th"], True)], store.KEYS)
    c = readiness.store_counts(keys, ["en", "th"]).first()
    assert (c.total_keys, c.translated_keys, c.filled_register_slots, c.draft_keys) == (3, 2, 1, 2)


KEYS = [("p", "cart.title", "The title", {"en": {"neutral": "Your cart's items"}, "vi": {"neutral": ""}}, [], False), ("p", "pay", None, {"en": {"formal": 'Pay "5%" & go, now'}}, ["en"], True), ("q", "x", None, {"en": {"neutral": "X"}}, [], False)]


def test_store(spark):
    keys = spark.createDataFrame(KEYS, store.KEYS)
    new = spark.createDataFrame([("pay", "no"), ("cart.title", "Giỏ"), ("new.key", "Mới")], "name string, value string")
    done = store.import_entries(keys, new, "p", "vi", source="ai")
    got = {r.name: r for r in done.collect()}
    assert {n: r.action for n, r in got.items()} == {"pay": "skipped", "cart.title": "updated", "new.key": "created", "x": "kept"}
    assert got["cart.title"]["values"]["vi"]["neutral"] == "Giỏ" and got["cart.title"].draft == ["vi"] and got["cart.title"]["values"]["en"]["neutral"]
    assert tuple(store.import_summary(done).first()) == (1, 1, 1)
    with pytest.raises(ValueError, match="limit"):
        store.import_entries(keys, new, "p", "vi", limit=4)
    assert {r.key: (r.value, r.matched_locale) for r in messages.bundle(keys.where("project_id = 'p'"), "vi").collect()} == {"cart.title": ("Your cart's items", "en"), "pay": ('Pay "5%" & go, now', "en")}
    assert [r.key for r in messages.bundle(keys.where("project_id = 'p'"), "en").collect()] == ["cart.title"]
    assert [r.name for r in store.list_keys(keys, "p").collect()] == ["cart.title", "pay"]
    assert store.create_keys(keys, keys.limit(1)).count() == 3 and store.delete_keys(keys, keys.where("name = 'pay'")).count() == 2
    members = spark.createDataFrame([("owner", [], "vi"), ("viewer", [], "vi"), ("translator", ["th"], "vi"), ("translator", [], "vi")], "role string, locales array<string>, locale string")
    assert [r.can_edit for r in store.can_edit(members).collect()] == [True, False, False, True]


def test_edits(spark):
    values = spark.createDataFrame([("k", "vi", "neutral", "cũ")], "key string, locale string, register string, value string")
    edits = spark.createDataFrame([("k", "vi", "neutral", "mới", 1, "u", "human"), ("k", "vi", "neutral", "nữa", 2, "u", "human"), ("r", "vi", "neutral", "x", 3, "u", "ai")], "key string, locale string, register string, value string, at int, user string, source string")
    now, log = store.apply_edits(values, edits, spark.createDataFrame([("r",)], "key string"))
    assert {r.key: r.value for r in now.collect()} == {"k": "nữa"}
    assert [(r.before, r.after) for r in log.orderBy("at").collect()] == [("cũ", "mới"), ("mới", "nữa")]
    assert [r.after for r in store.newest_revisions(log, "k", 1).collect()] == ["nữa"]
    memory = spark.createDataFrame([("a", "en", "neutral", "A"), ("a", "vi", "neutral", "Á"), ("b", "en", "neutral", "B")], "key string, locale string, register string, value string")
    assert [tuple(r) for r in store.translation_memory(memory, "en", "vi").collect()] == [("a", "A", "Á")]
    prompt = spark.range(1).select(store.draft_prompt(F.lit("Hi {name}"), "en", "th", "formal", glossary={"cart": "ตะกร้า"}).alias("p")).first().p
    assert "English" in prompt and "Thai / ไทย" in prompt and "N + number + CL" in prompt and "ตัว" not in prompt.split("CL for people")[0] and "คน" in prompt
    assert "cart => ตะกร้า" in prompt and prompt.endswith("- text: Hi {name}") and "formal (one of" in prompt and "no spaces or invisible breaks" in prompt


def test_files(spark):
    keys = spark.createDataFrame(KEYS, store.KEYS).where("project_id = 'p'")
    body = lambda kind: export.export_keys(kind, keys, ["en", "vi"]).first()
    assert body("csv").body == 'key,description,en,vi\ncart.title,The title,Your cart\'s items,\npay,,"Pay ""5%"" & go, now",'
    assert '<string name="cart_title">Your cart\\\'s items</string>' in body("android").body and "5%%" in body("android").body and "&amp;" in body("android").body
    assert body("ios").body.startswith('/* The title */\n"cart.title" = "Your cart\'s items";\n"pay" = "Pay \\"5%\\" & go, now";')
    assert json.loads(body("json").body) == {"cart": {"title": "Your cart's items"}, "pay": 'Pay "5%" & go, now'} and body("json").filename == "en.json"
    assert export.font_link(["th", "en", "vi", "nope"]).count("family=") == 3 and "direction: rtl" in export.font_css(["ms-Arab"])


def test_evaluation(spark):
    pairs = spark.createDataFrame([("th", "a", 1), ("th", "a", 3), ("en", "b", 2)], "locale string, text_id string, at int")
    gold = spark.createDataFrame([("th", "a", 1), ("th", "a", 2), ("en", "b", 2)], "locale string, text_id string, at int")
    got = {r.locale: (r.precision, r.recall, r.f1) for r in evaluate.boundary_scores(pairs, gold).collect()}
    assert got == {"th": (0.5, 0.5, 0.5), "en": (1.0, 1.0, 1.0)} and evaluate.macro(evaluate.boundary_scores(pairs, gold)).first().f1 == 0.75
    cuts = spark.createDataFrame([(1, "เก", [1]), (2, "กา", [0, 1, 2]), (3, "ab", [1]), (4, None, [1]), (5, "กา", None)], "text_id int, text string, offsets array<int>")
    assert {(r.text_id, r.reason) for r in evaluate.legality(cuts).collect()} == {(1, "orphaned-leading-vowel"), (2, "orphaned-trailing-vowel")}
    text, offsets = bundles.annotated(F.lit("ab|c|de"))
    assert tuple(spark.range(1).select(text, offsets).first()) == ("abcde", [2, 3])


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("k", "vi", "Trả $5"), ("k", "th", "ดี"), ("k", "xx", "")], "key string, locale string, after string").withColumn("at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streaming.lint_stream(stream).writeStream.format("memory").queryName("findings").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.locale, r.rule) for r in spark.table("findings").collect()] == [("vi", "hardcoded-currency")]
    assert streaming.finding_counts(streaming.lint_stream(stream)).isStreaming


def test_sql_names(spark):
    from lontar.functions import sql
    from lontar.functions.clusters import Lexicon

    names = sql.register(spark, {"th": Lexicon.of(["ฉัน", "รัก"])}, locales=("vi", "zh-Hans-SG"))
    assert len(names) == len(set(names)) == 6 + len(sql.COLUMNS) + 10
    row = spark.sql("select lontar_words('ฉันรัก', 'th') as w, lontar_truncate_text('hello world', 'en', 6) as s, lontar_resolve_locale('VI_vn') as l, lontar_graphemes('เกา', 'th') as g").first()
    assert (row.w, row.s, row.l, row.g) == (["ฉัน", "รัก"], "hello…", "vi", ["เกา"])
    row = spark.sql("select lontar_format_count(2D, 'mèo', 'vi', 'animal') as c, lontar_money_vi(1500000D) as m, lontar_with_politeness('Hello?', 'th', 'male') as p, lontar_plural_category(1D, 'en') as k, lontar_is_zawgyi('ေက်ာင္း') as z, lontar_illegal_cuts('กา') as i, lontar_number_zh_hans_sg(1234.5D) as n, lontar_date_vi(timestamp_ntz'2026-08-18 15:04:05') as d, lontar_fallback_chain('ms-BN') as f").first()
    assert (row.c, row.m, row.p, row.k, row.z, row.i, row.n) == ("2 con mèo", "1.500.000\xa0₫", "Hello ครับ?", "one", True, 1, "1,234.5") and "2026" in row.d and row.f[-1] == "en"
    plan = spark.sql("select lontar_fold_letters('Đà') as x")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_scaffold(tmp_path):
    from lontar.sources.scaffold import scaffold

    assert set(scaffold(str(tmp_path), "th")) == {"th.json", "en.json", "config.json"} and scaffold(str(tmp_path), "th") == []


def test_translator(spark):
    from lontar.operators.translator import Translator

    held = [("en", "hi", None, None, "Hello {n}", 0), ("vi", "hi", "formal", None, "Chào quý khách {n}", 0), ("vi", "hi", "casual", None, "Chào bạn {n}", 1), ("en", "bye", None, None, "Bye", 0)]
    long = spark.createDataFrame(held, "locale string, key string, register string, plural string, value string, ord int")
    asked = spark.createDataFrame([(1, "hi", {"n": 1234.5}), (2, "bye", None), (3, "none", None)], "request_id int, key string, numbers map<string,double>")
    vi = Translator(long, "VI_vn", "formal")
    text = lambda t: {r.request_id: r.text for r in t.translate(asked).collect()}
    assert vi.locale == "vi" and vi.direction == "ltr"
    assert text(vi) == {1: "Chào quý khách 1.234,5", 2: "Bye", 3: "none"}
    assert text(vi.with_register("casual"))[1] == "Chào bạn 1.234,5" and text(vi.with_locale("th"))[1] == "Hello 1,234.5"
    assert {r.request_id for r in vi.has(asked).collect()} == {1, 2} and [r.key for r in vi.missing_keys().collect()] == ["bye"]
    row = spark.range(1).select(vi.number(F.lit(1234.5)).alias("n"), vi.currency(F.lit(5000)).alias("c"), vi.count(F.lit(2), F.lit("mèo"), category=F.lit("animal")).alias("k"), vi.pronoun().alias("p"), vi.particle().alias("q")).first()
    assert row.n == "1.234,5" and row.c.startswith("5.000") and row.k == "2 con mèo" and row.p
    with pytest.raises(ValueError):
        Translator(long, "xx")


@pytest.mark.parametrize("kind", ["session", "folder"])
def test_stores(spark, tmp_path, kind):
    held = store.open_store(spark, str(tmp_path) if kind == "folder" else None)
    assert not held.exists("keys")
    for n in (3, 5):
        held.put("keys", spark.range(n).select(F.lit("p").alias("project_id"), F.col("id").cast("string").alias("name")))
    assert held.exists("keys") and store.count_keys(held.table("keys"), "p") == 5 and store.count_keys(held.table("keys"), "q") == 0
