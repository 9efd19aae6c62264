"""Functions on the literal cases that their behaviour is pinned by."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lontar import registry as R
from lontar.functions import clusters as C
from lontar.functions import dates, digits, grammar, numbers, scripts, segment, text
from lontar.functions import locale as L

import plain


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def each(spark, rows, make):
    """make(column) for each of the texts, in order."""
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r["v"] for r in frame.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_registry():
    assert len(R.LOCALES) == 29 and len(R.COUNTRIES) == 12
    assert all(v.fallback[0] == c and v.fallback[-1] == "en" for c, v in R.LOCALES.items())
    assert all(set(v.locales) <= set(R.LOCALES) for v in R.COUNTRIES.values())
    assert R.unspaced_locales() == ["th", "my", "shn", "km", "lo", "zh-Hans-SG"] and R.locales_for_script("Hans") == ["zh-Hans-SG"]
    assert R.locales_for_country("th") == ["th", "en"] and R.chain("nope") == ("en",)
    assert R.classifier("jv", "animal") == "ekor" and R.classifier("shn", "person") == "ယောက်" and R.classifier("fil", "thing") is None


def test_dimensions(spark):
    assert R.dim_locale(spark).count() == 29 and R.dim_country(spark).count() == 12
    assert R.dim_fallback(spark).where("locale = 'ms-SG'").count() == 4
    assert R.dim_classifier(spark).where("locale = 'lo' and category = 'book'").first().classifier == "ຫົວ"


def test_resolving(spark):
    tags = ["VI-vn", "th_TH", "ms-Arab-BN", "xx-YY", "", None, "  EN ", "zh-hans-sg-x", "id-x-gaul"]
    assert each(spark, tags, L.resolve_locale) == [R.resolve(t).code if R.resolve(t) else None for t in tags]
    assert each(spark, ["vi", "nope"], L.is_supported) == [True, False]
    assert value(spark, L.parse_accept_language(F.lit("en;q=0.5,vi,th;q=0.8"))) == ["vi", "th", "en"]
    asked = lambda *tags: F.array(*map(F.lit, tags))
    assert value(spark, L.negotiate(asked("jv"), asked("id", "en"))) == "id"
    assert value(spark, L.negotiate(asked("lo"), asked("th", "en"))) == "th"
    assert value(spark, L.negotiate(asked("fr"), asked("id", "en"))) == "en"
    assert value(spark, L.first_day_of_week(F.lit("th"))) == 0 and value(spark, L.first_day_of_week(F.lit("zz"))) == 1
    assert tuple(value(spark, L.html_attributes(F.lit("ms-arab")))) == ("ms-Arab", "rtl")
    with pytest.raises(Exception, match="unknown locale"):
        value(spark, L.get_locale(F.lit("xx")))


def test_digits(spark):
    assert value(spark, digits.to_native_digits(F.lit("2569"), "th")) == "๒๕๖๙" and value(spark, digits.to_native_digits(F.lit("123"), "vi")) == "123"
    every = "".join(R.LOCALES[c].native_digits for c in ("th", "lo", "km", "my", "shn", "jv-Java"))
    assert value(spark, digits.to_latin_digits(F.lit(every))) == "0123456789" * 6
    parse = lambda t, group, point: value(spark, digits.parse_number(F.lit(t), F.lit(group), F.lit(point)))
    assert parse("1.500.000", ".", ",") == 1500000 and parse("1,234.5", ",", ".") == 1234.5 and parse("๑,๒๓๔.๕", ",", ".") == 1234.5
    assert parse("1.5.2", ",", ".") == 1.5 and parse("-3,5 ₫", ".", ",") == -3.5 and parse("none", ",", ".") is None


def test_numbers(spark):
    def shown(function, amount, locale, **options):
        return value(spark, function(spark, F.lit(amount), locale, **options))

    assert shown(numbers.format_number, 1234567.8915, "en") == "1,234,567.892" and shown(numbers.format_number, 1234.5, "vi") == "1.234,5"
    assert shown(numbers.format_currency, 1500000.0, "vi") == "1.500.000\xa0₫" and shown(numbers.format_currency, -2.5, "en") == "-$2.50"
    assert shown(numbers.format_currency, 1234.5, "th", native_digits=True) == "฿๑,๒๓๔.๕๐"
    assert shown(numbers.format_percent, 0.256, "en") == "26%" and shown(numbers.format_compact, 1234567.0, "en") == "1.2M"
    assert shown(numbers.format_number, 0.5, "en", most=0) == "1" and shown(numbers.format_number, -0.0004, "en") == "0"
    rows = numbers.with_money(spark.createDataFrame([("vi", 1500000.0), ("en", -2.5), ("th", 12.0), ("xx", 1.0)], "locale string, amount double"), "amount")
    assert {r.locale: r.money for r in rows.collect()} == {"vi": "1.500.000\xa0₫", "en": "-$2.50", "th": "฿12.00", "xx": None}


def test_dates(spark):
    at = F.lit("2026-08-18 15:04:05").cast("timestamp_ntz")
    assert value(spark, dates.format_date(spark, at, "en")) == "Aug 18, 2026"
    assert "2569" in value(spark, dates.format_date(spark, at, "th", style="long")) and "สิงหาคม" in value(spark, dates.format_date(spark, at, "th", style="long"))
    assert value(spark, dates.format_time(spark, at, "en")).replace(" ", " ") == "3:04 PM"
    now = F.lit("2026-08-18 15:04:05").cast("timestamp")
    ago = lambda s, c="en": value(spark, dates.format_relative_time(spark, now - F.expr(f"interval {s}"), now, c))
    assert ago("1 day") == "yesterday" and ago("3 hours") == "3 hours ago" and ago("-2 minutes") == "in 2 minutes" and ago("800 days") == "2 years ago"
    assert value(spark, dates.relative_value(F.lit(-150_000).cast("long"))) == -2


def test_counting(spark):
    phrase = lambda n, noun, code, kind=None: value(spark, grammar.format_count(F.lit(n), F.lit(noun), F.lit(code), None if kind is None else F.lit(kind)))
    assert phrase(2, "mèo", "vi", "animal") == "2 con mèo" and phrase(3, "buku", "id", "book") == "3 buah buku" and phrase(3, "libro", "fil") == "3 na libro"
    assert phrase(2, "แมว", "th", "animal") == "แมว 2 ตัว" and phrase(3, "书", "zh-Hans-SG", "book") == "3本书" and phrase(1.5, "cat", "en") == "1.5 cat"
    category = lambda n, code: value(spark, grammar.plural_category(F.lit(n), F.lit(code)))
    assert [category(n, "en") for n in (0, 1, 2, 1.5)] == ["other", "one", "other", "other"]
    assert [category(n, "fil") for n in (1, 4, 5, 6, 9, 14, 20)] == ["one", "other", "one", "other", "other", "other", "one"]
    assert category(1, "th") == "other" and category(1_000_000, "pt-TL") == "many"
    forms = F.create_map(F.lit("one"), F.lit("{n} cat"), F.lit("other"), F.lit("{n} cats"))
    assert value(spark, grammar.select_plural(F.lit(2), F.lit("en"), forms)) == "2 cats"
    assert value(spark, grammar.speech_level(F.lit("jv"), F.lit("formal"))) == "krama" and value(spark, grammar.has_speech_levels(F.lit("vi"))) is False
    assert value(spark, grammar.particle_is_gendered(F.lit("th"))) and not value(spark, grammar.particle_is_gendered(F.lit("vi")))
    assert value(spark, grammar.pronoun_is_gendered(F.lit("my"))) and not value(spark, grammar.pronoun_is_gendered(F.lit("vi")))


def test_names(spark):
    name = lambda **parts: F.struct(*(F.lit(parts.get(k)).cast("string").alias(k) for k in ("full", "given", "middle", "family", "patronymic", "nickname")))
    assert value(spark, grammar.validate_name(name(given="An"), F.lit("VN"))) == ["Family name is required"]
    assert value(spark, grammar.validate_name(name(given="Sukarno"), F.lit("ID"))) == [] and value(spark, grammar.validate_name(name(), F.lit("MM"))) == ["Name is required"]
    assert value(spark, grammar.short_name(name(given="Somchai", nickname="Lek"), F.lit("th"))) == "Lek"
    assert value(spark, grammar.allows_mononym(F.lit("ID"))) and not value(spark, grammar.allows_mononym(F.lit("VN")))


def test_vietnamese(spark):
    rows = ["Tiếng Việt", "Đà Nẵng", "Hồ Chí Minh", "naïve ÅÇé", "plain"]
    model = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) <= 0x36F).replace("đ", "d").replace("Đ", "D")
    assert each(spark, rows, scripts.fold_vietnamese) == [model(t) for t in rows]
    assert each(spark, rows[:3], lambda c: scripts.to_search_key(c, F.lit("vi"))) == ["tieng viet", "da nang", "ho chi minh"]
    assert value(spark, scripts.slugify_vietnamese(F.lit("Hồ Chí Minh!"))) == "ho-chi-minh"
    loose = [unicodedata.normalize("NFD", t) for t in rows]
    assert each(spark, loose, scripts.normalize_vietnamese) == rows and each(spark, loose, scripts.tone_of)[0] == "sắc"
    typed = {"Tieengs Vieejt": "Tiếng Việt", "ddaa": "đâ", "chaof": "chào", "toans": "toán", "giayf": "giày", "": "", " a  b ": " a  b ", "nawxng": "nẵng", "muaf": "mùa", "HOAF": "HÒA", "DDaf": "Đà", "sfx": "sfx", "s": "s", "thuwowngf": "thừơng", "thuowngf": "thuờng", "asf\tbs\nngoaif": "às\tbs\nngoài", "quys": "qúy", "ax b": "ã b", "viejet": "vieẹt", "caacs": "cấc"}
    assert dict(zip(typed, each(spark, typed, scripts.from_telex), strict=True)) == typed
    assert each(spark, [None], scripts.from_telex) == [None]


def test_search_keys_of_every_script(spark):
    rows = ["й ά Ǖ が 한 क़ ﬁ Å", "ộ" * 3, "a\u0323\u0302\u0345b", "ุ่", "ุ่ x", None] + [chr(c) for c in (*range(0xC0, 0x250), *range(0x370, 0x530, 3), *range(0x1E00, 0x2000), *range(0x900, 0x980), *range(0x3040, 0x3100), 0xAC01, 0xF900, 0x2F800, 0x1D15E)]
    assert each(spark, rows, scripts.fold_vietnamese) == [None if t is None else scripts._bare(t) for t in rows]
    zawgyi, unicode = "ေက်ာင္း", "ကျောင်း"
    key = lambda t, c: value(spark, scripts.to_search_key(F.lit(t), F.lit(c)))
    assert key(zawgyi, "my") == key(unicode, "my") and value(spark, scripts.search_matches(F.lit(zawgyi), F.lit(f"x {unicode}"), F.lit("my")))
    assert key("Й", "id") == "и" and key("น้ำ ๑๒", "th") == "นำ 12"


def test_composed_letters_of_every_script(spark):
    """NFC in the JVM for what is settled, in Python for the rest: equal to unicodedata over all letters, marks behind them and hangul."""
    rng = random.Random(9)
    rows = [chr(c) for c in range(0xA0, 0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    rows = ["".join(rows[i : i + 40]) for i in range(0, len(rows), 40)] + [unicodedata.normalize("NFD", r) for r in rng.sample(rows, 300)]
    marks = [chr(c) for c in range(0x300, 0x370)] + ["ᅡ", "ᆨ", "가", "が"]
    rows += ["".join(rng.choice("aeiouyAÔếकก가" + "".join(marks)) for _ in range(12)) for _ in range(500)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", scripts.normalize_nfc(F.col("t")).alias("v"), (F.col("t").rlike(f"[{scripts._unsettled()}]")).alias("open")).orderBy("i").collect()
    assert [r.v for r in got] == [unicodedata.normalize("NFC", t) for t in rows]
    plan = spark.createDataFrame([("x",)], "t string").select(scripts.normalize_nfc(F.col("t")))._jdf.queryExecution().toString()
    assert "_nfc(CASE WHEN" in plan


def test_jawi_and_myanmar(spark):
    rng = random.Random(1)
    table = [*scripts.RUMI_DIGRAPHS, *zip(scripts.RUMI_LETTERS, scripts.JAWI_LETTERS, strict=True)]

    def scan(t):
        out = ""
        while t:
            a, b = next(((a, b) for a, b in table if t.startswith(a)), (t[0], t[0]))
            out, t = out + b, t[len(a) :]
        return out

    rows = ["".join(rng.choice("nghskydztc aei") for _ in range(12)) for _ in range(200)]
    assert each(spark, rows, scripts.rumi_to_jawi) == [scan(t) for t in rows]
    assert value(spark, scripts.jawi_to_rumi(F.lit("شڠ"))) == "syng" and value(spark, scripts.is_jawi(F.lit("abc"))) is False
    verdict = value(spark, scripts.detect_myanmar_encoding(F.lit("ေက်ာင္း")))
    assert verdict.encoding == "zawgyi" and 0.5 < verdict.confidence <= 1
    assert value(spark, scripts.zawgyi_to_unicode(F.lit("ေက်ာင္း"))) == "ကျောင်း"
    with pytest.raises(Exception, match="Zawgyi"):
        value(spark, scripts.assert_unicode_myanmar(F.lit("ေက်ာင္း")))
    assert value(spark, scripts.search_matches(F.lit("da n"), F.lit("Đà Nẵng"), F.lit("vi"))) and not value(spark, scripts.search_matches(F.lit(" "), F.lit("x"), F.lit("en")))


def test_sentences(spark):
    rows = ["Hello there. How are you?", "Version 1.2 shipped.", "Wait... \"Really?\" Yes", "", "no end", "a.b", "ខ្មែរ។ ល្អ"]
    assert each(spark, rows, text.sentences) == [["Hello there. ", "How are you?"], ["Version 1.2 shipped."], ["Wait... ", '"Really?" ', "Yes"], [], ["no end"], ["a.", "b"], ["ខ្មែរ។ ", "ល្អ"]]
    assert value(spark, text.spaced_words(F.lit("e-mail can't 1,500 — Tiếng"))) == ["e-mail", "can't", "1,500", "Tiếng"]


SAMPLES = {"Thai": "เด็กๆ กินข้าวที่บ้านเกี่ยวกับภาษาไทย น้ำใจ", "Laoo": "ຂ້ອຍຮັກພາສາລາວ ເຈົ້າ", "Khmr": "ខ្ញុំស្រឡាញ់ភាសាខ្មែរ", "Mymr": "မြန်မာဘာသာစကားကိုချစ်တယ် အင်္ဂလိပ်", "Hans": "我爱新加坡，你呢？"}
EDGES = ["", " ", "\n", "ก", "เ", C.ZWSP, "ก" * 200, "ក្", "င်္", "👨‍👩‍👧‍👦", "a\r\nb", "🇹🇭🇸"]


@pytest.mark.parametrize("script", SAMPLES)
def test_clusters_and_spans(script):
    words = re.findall(r"\w{2,6}", SAMPLES[script])
    lexicon = C.Lexicon.of(words)
    for t in [SAMPLES[script], SAMPLES[script] * 3 + " abc 1,5", *EDGES]:
        units = C.clusters(t, script)
        assert "".join(units) == t
        at = 0
        for u in units[:-1]:
            at += len(u)
            assert plain.illegal_reasons(t, at, "cut") == [], (t, at)
        for engine in segment.ENGINES:
            pieces = plain.spans(t, script, lexicon, engine)
            assert "".join(p for p, _ in pieces) == t
            marked = plain.with_breaks(t, script, lexicon, engine)
            assert marked.replace(C.ZWSP, "") == t.replace(C.ZWSP, "")
            for most in (1, 3, 8):
                short = plain.truncated(t, script, most, lexicon=lexicon, engine=engine)
                assert short == t or len(C.clusters(short, script)) <= max(2, most)


@pytest.mark.parametrize("script", SAMPLES)
def test_one_pattern_for_clusters(script):
    """The pattern for runs of native letters against the rules, on random letters."""
    rng = random.Random(script)
    first, last = {"Thai": (0xE01, 0xE5B), "Laoo": (0xE81, 0xEDF), "Khmr": (0x1780, 0x17F9), "Mymr": (0x1000, 0x109F), "Hans": (0x4E00, 0x9FFF)}[script]
    common = [c for c in SAMPLES[script] if first <= ord(c) <= last]
    for _ in range(3000):
        run = "".join(rng.choice(common) if rng.random() < 0.6 else chr(rng.randint(first, last)) for _ in range(rng.randint(1, 10)))
        assert C.native_clusters(run, script) == list(C.clusters(run, script)), ascii(run)


def test_graphemes():
    assert C.graphemes("a\r\nb") == ["a", "\r\n", "b"] and C.graphemes("🇹🇭🇸🇬") == ["🇹🇭", "🇸🇬"] and C.graphemes("👍🏽") == ["👍🏽"]
    assert C.graphemes("각가") == ["각", "가"] and C.graphemes("éx") == ["é", "x"] and C.graphemes("") == []


def brute_cheapest(units, lexicon, script):
    """All divisions of few clusters."""
    best = None
    for mask in range(1 << max(0, len(units) - 1)):
        words, start = [], 0
        for i in range(1, len(units) + 1):
            if i == len(units) or mask >> (i - 1) & 1:
                words.append(units[start:i])
                start = i
        bend = C.UNKNOWN / C.BEST_LENGTH[script] ** 2
        cost = sum(lexicon.cost.get("".join(w), C.UNKNOWN + C.PER_CLUSTER * len(w) + bend * len(w) ** 2) for w in words)
        if best is None or cost < best[0] - 1e-12:
            best = (cost, words)
    return best[0]


def test_viterbi_is_cheapest():
    rng = random.Random(5)
    lexicon = C.Lexicon.of(["ab", "abc", "cd", "d", "bcd"])
    for _ in range(200):
        units = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        words = plain.cheapest(units, lexicon, "Hans")
        bend = C.UNKNOWN / C.BEST_LENGTH["Hans"] ** 2
        cost = sum(lexicon.cost.get(w, C.UNKNOWN + C.PER_CLUSTER * len(w) + bend * len(w) ** 2) for w in words)
        assert "".join(words) == "".join(units) and abs(cost - brute_cheapest(units, lexicon, "Hans")) < 1e-9


def test_segmentation_columns(spark):
    lexicons = segment.register_words({}, "th", ["ฉัน", "รัก", "ภาษา", "ไทย", "มาก"])
    rows = spark.createDataFrame([("ฉันรักภาษาไทยมาก", "th"), ("hello world", "en"), (None, "th"), ("x", None)], "t string, c string")
    got = rows.select(segment.words(F.col("t"), F.col("c"), lexicons).alias("w"), segment.truncate(F.col("t"), F.col("c"), 8, lexicons=lexicons).alias("s"), segment.spans(F.col("t"), F.col("c"), lexicons).alias("p"), segment.insert_line_break_opportunities(F.col("t"), F.col("c"), lexicons).alias("b"), segment.grapheme_length(F.col("t"), F.col("c")).alias("n")).collect()
    assert got[0].w == ["ฉัน", "รัก", "ภาษา", "ไทย", "มาก"] and got[0].s == "ฉันรักภาษา…"
    assert got[1].w == ["hello", "world"] and got[1].s == "hello…" and got[1].b == "hello world" and got[2].w is None
    assert got[0].b.count(C.ZWSP) == 4 and got[0].p[1].start == 3 and got[0].p[1].text == "รัก" and got[1].n == 11
    assert {r.t: r.words for r in segment.with_words(rows.where("t is not null and c is not null"), "t", "c", lexicons).collect()}["hello world"] == ["hello", "world"]
    assert segment.lexicon_size(lexicons, "th") == 5


def test_jvm_words_equal_the_rules(spark):
    """Words found by patterns of the JVM are those of the plain rules, on random strings of every script."""
    import random

    from lontar.functions import clusters as C

    letters = {"th": "กขคงจฉดตนมรสหอเแโใไะาำๅๆฯั้่์็ิีฺุู๑๒฿๏๚", "lo": "ກຂຄງຈດຕນມຣສຫອເແໂໃໄະາຳໆັິີຸູ່້໌໑", "km": "កខគឃងចឆជតថនបផពមយរលវសហអ្ាិីឹឺុូើេែំះ៉់។១", "my": "ကခဂငစဆညတထနပဖဗမယရလသဟအ္်ျြွှါာိီုူေဲံ့း၊၁ဿဥ", "zh-Hans-SG": "我是中国人新加坡，。、豈𠀀"}
    rng, rows = random.Random(5), []
    for code, own in letters.items():
        for _ in range(400):
            rows.append((code, "".join(rng.choice(own) if rng.random() < 0.85 else rng.choice(" ab1.,'-é\n\u200b\u200d!") for _ in range(rng.randint(0, 25)))))
    got = spark.createDataFrame(rows, "locale string, text string").select("locale", "text", segment.words(F.col("text"), F.col("locale")).alias("words")).collect()
    script = {c: R.LOCALES[c].script for c in letters}
    for r in got:
        assert r.words == [w for w, is_word in plain.spans(r.text, script[r.locale]) if is_word], (r.locale, r.text)


def test_engine_of_the_user(spark):
    engine = segment.Engine("halves", lambda text, script: [(text[: len(text) // 2], True), (text[len(text) // 2 :], False)])
    got = spark.createDataFrame([("th", "abcd")], "locale string, text string").select(segment.words(F.col("text"), F.col("locale"), engine=engine).alias("w"), segment.break_offsets(F.lit("ab"), F.lit("th"), engine=engine).alias("b")).first()
    assert got.w == ["ab"] and got.b == []


def test_sentences_keep_every_character(spark):
    given = ["a\x01b. c", "Version 1.2 shipped. Yes! ", "no end", "", "...", "1.2.3", "A?\u201d B\u3002C\n\nD.", "x." * 3000 + "tail", "y " * 20000]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").orderBy("i").select(text.sentences(F.col("t")).alias("s")).collect()]
    assert ["".join(s) for s in got] == given
    assert got[:6] == [["a\x01b. ", "c"], ["Version 1.2 shipped. ", "Yes! "], ["no end"], [], ["..."], ["1.2.3"]]
    assert got[6] == ["A?\u201d ", "B\u3002", "C\n\nD."]


def settled(text):
    """Zawgyi text in Unicode: letters one by one, then marks swap with the neighbour before them until none is out of place."""
    wide = "".join(scripts.ZAWGYI.get(c, c) for c in text)
    letters = [scripts.SHIFT.get(c, c) for c in wide]
    bases = re.compile(f"[{scripts.BASES}]")
    rank = {c: i for i, alike in enumerate(scripts.ORDER) for c in alike}
    swapped = True
    owner, at, home = [], None, []  # the base that each mark belongs to
    for i, c in enumerate(letters):
        if bases.match(c):
            at = i
        elif c not in rank:
            at = None
        owner.append(at if bases.match(c) or c in rank else None)
    nxt = None
    for i in range(len(letters) - 1, -1, -1):  # marks without one before them go to the next
        if bases.match(letters[i]):
            nxt = i
        elif letters[i] not in rank:
            nxt = None
        elif owner[i] is None:
            owner[i] = nxt
        home.append(owner[i])
    home = home[::-1]
    key = lambda i: -1 if bases.match(letters[i]) else rank.get(letters[i], 0)
    order = list(range(len(letters)))
    while swapped:
        swapped = False
        for j in range(1, len(order)):
            a, b = order[j - 1], order[j]
            if home[a] is not None and home[a] == home[b] and key(a) > key(b):
                order[j - 1], order[j] = b, a
                swapped = True
    return "".join(letters[i] for i in order)


def test_zawgyi_in_the_jvm(spark):
    rng = random.Random(11)
    own = "".join(scripts.ZAWGYI) + "".join(scripts.SHIFT) + "ကခဂငစတနမရလသအ" * 3 + "ောိီုူဲံ့း" * 2 + " a၊"
    rows = ["".join(rng.choice(own) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None, "plain"]
    assert each(spark, rows, scripts.zawgyi_to_unicode) == [None if r is None else settled(r) for r in rows]
    frame = spark.createDataFrame([("x",)], "t string").select(scripts.normalize_myanmar(F.col("t")))
    assert "EvalPython" not in frame._jdf.queryExecution().toString()


def test_legality_is_linear_and_that_of_pairs(spark):
    from lontar.functions import legality

    rng = random.Random(13)
    own = "กเาะัๆກເາັកា្ំကါ္်ျးန။, aé\u0301𠀀"
    rows = ["".join(rng.choice(own) for _ in range(rng.randint(0, 20))) for _ in range(800)] + ["", None, "ကျ်" * 3]
    for kind in ("break", "cut"):
        frame = spark.createDataFrame([(i, t, list(range(-1, 22))) for i, t in enumerate(rows)], "i int, t string, o array<int>").orderBy("i")
        t = F.col("t")
        got = frame.select(legality.illegal_offsets(t, kind).alias("at"), legality.illegal_count(t, None, kind).alias("n"), legality.illegal_counts(t, kind).alias("by"), legality.judged(t, F.col("o"), kind).alias("judged")).collect()
        for text, r in zip(rows, got, strict=True):
            if text is None:
                assert (r.at, r.n, r.by, r.judged) == (None, None, None, None)
                continue
            want = {at: names for at in range(len(text) + 1) if (names := plain.illegal_reasons(text, at, kind))}
            assert r.at == list(want) and r.n == len(want) and {x.at: x.reasons for x in r.judged} == want, ascii(text)
            assert {x.reason: x.n for x in r.by} == {name: n for name in legality.reasons(kind) if (n := sum(name in x for x in want.values()))}


def test_sentences_are_counted_as_they_are_found(spark):
    given = [None, "", " ", "One. Two 3.14, or 2.5! Three?! \"Four.\" five", "a.b.1.2.c", "...", "1.", ".1", "ဟုတ်။ ไทย। x…y", "A-b's 1,000.5 c’d— e\n\nF."]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").orderBy("i")
    found = frame.select(text.sentences(F.col("t")).alias("s"), text.sentence_count(F.col("t")).alias("n"), text.spaced_words(F.col("t")).alias("w"), text.spaced_word_count(F.col("t")).alias("m")).collect()
    assert found[0].n is None and all(r.n == len(r.s) and r.m == len(r.w) and "".join(r.s) == t for r, t in zip(found[1:], given[1:], strict=True))
