"""Queries over the supplied tables, and over literal rows where those tables hold no such text.

ORACLES has DuckDB SQL with the same columns. Queries without one run algorithms that SQL can't
express; tests hold those against known results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as R
from ..functions import dates, digits, grammar, numbers, scripts, segment, text
from ..functions.locale import fallback_chain, locale_from_request, parse_accept_language, resolve_locale
from ..operators import evaluate, export, lint, messages, readiness, store
from ..ship import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_text(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_sql_text, r)) + ")" for r in rows)


def _dealt(spark: SparkSession, sf_dir: str, table: str, key: str, rows: list[tuple], schema: str) -> DataFrame:
    """Each row of a table, by its key, with one of some literal rows, dealt out in turn."""
    held = F.array(*(F.struct(*(F.lit(v) for v in r)) for r in rows)).cast(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")
    dealt = spread(_table(spark, sf_dir, table).select(key)).withColumn("__row", F.get(held, (F.col(key) % len(rows)).cast("int")))
    return dealt.select(key, *(F.col(f"__row.{c.split(' ')[0]}") for c in schema.split(", ")))


def _dealt_sql(table: str, key: str, rows: list[tuple], columns: str, shown: str = "") -> str:
    return f"SELECT {key}, {shown or columns} FROM {table} JOIN ({_values([(i, *r) for i, r in enumerate(rows)])}) t(nth, {columns}) ON {key} % {len(rows)} = nth"


_CODES = list(R.LOCALES)
#: The locale that a nation's numbers are shown in, and that a language of the documents stands for.
_NATIONS = [(i, c, v.count_order, R.classifier(c, "book"), v.native_digits, 543 if v.calendar == "buddhist" else 0, c in ("fil", "ceb", "fil-x-taglish")) for i, (c, v) in enumerate(R.LOCALES.items())]
_LANGS = [("en", "en"), ("fr", "vi"), ("de", "th"), ("es", "id")]

_PHRASE = """CASE WHEN d.ord = 'num-noun' THEN {n} || CASE WHEN d.na THEN ' na ' ELSE ' ' END || {noun}
  WHEN d.clf IS NULL THEN CASE WHEN d.ord = 'noun-num-clf' THEN {noun} || ' ' || {n} ELSE {n} || ' ' || {noun} END
  WHEN d.ord = 'noun-num-clf' THEN {noun} || ' ' || {n} || ' ' || d.clf
  WHEN d.code = 'zh-Hans-SG' THEN {n} || d.clf || {noun} ELSE {n} || ' ' || d.clf || ' ' || {noun} END"""


@query(f"""
WITH d(i, code, ord, clf, digits, era, na) AS ({_values(_NATIONS)})
SELECT n.n_name, d.code AS locale, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders,
  CAST(max(year(o_orderdate)) + max(d.era) AS INTEGER) AS last_year,
  {_PHRASE.format(n="CAST(count(DISTINCT o_orderkey) AS VARCHAR)", noun="'order'")} AS phrase,
  coalesce(translate(CAST(count(DISTINCT o_orderkey) AS VARCHAR), '0123456789', d.digits), CAST(count(DISTINCT o_orderkey) AS VARCHAR)) AS native_orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN d ON d.i = n_nationkey % {len(_CODES)}
GROUP BY n.n_name, d.code, d.ord, d.clf, d.digits, d.na
""")
def localised_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and orders of each nation, said in a locale's way."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    by_order = line.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    joined = by_order.join(orders, by_order.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    sums = joined.groupBy("c_nationkey").agg(F.sum("amount").alias("amount"), F.count("*").alias("orders"), F.max(F.year("o_orderdate")).alias("year"))
    named = sums.join(nations, sums.c_nationkey == nations.n_nationkey)
    code = F.element_at(F.array(*map(F.lit, _CODES)), F.col("n_nationkey") % len(_CODES) + 1)
    named = named.withColumn("locale", code)
    year = F.when(F.col("locale").isin("th"), dates.to_buddhist_year(F.col("year"))).otherwise(F.col("year"))
    return named.select("n_name", "locale", F.round("amount", 2).alias("revenue"), "orders", year.cast("int").alias("last_year"), grammar.format_count(F.col("orders"), F.lit("order"), F.col("locale"), F.lit("book")).alias("phrase"), digits.to_native_digits(F.col("orders").cast("string"), F.col("locale")).alias("native_orders"))


_WORD_RE2 = r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}][\p{L}\p{N}\p{M}]*(?:[''’ʼ‐‑-][\p{L}\p{N}\p{M}]+)*"
_PROTECTED = "regexp_replace(regexp_replace(text, '([0-9])\\.([0-9])', '\\1' || chr(2) || '\\2', 'g'), '([0-9])\\.([0-9])', '\\1' || chr(2) || '\\2', 'g')"


@query(f"""
SELECT lang, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, '{_WORD_RE2}'))) AS BIGINT) AS words,
  CAST(sum(len(list_filter(string_split(regexp_replace({_PROTECTED}, '([!?…។៕၊။。！？.][!?…។៕၊။。！？.]*["''’”)\\]}}»]*[ \\t\\n\\r​]*)', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))) AS BIGINT) AS sentences
FROM documents GROUP BY lang
""")
def words_and_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and sentences of documents by language."""
    docs = spread(_table(spark, sf_dir, "documents").select("lang", "text"))
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(text.spaced_word_count(F.col("text"))).cast("long").alias("words"), F.sum(text.sentence_count(F.col("text"))).cast("long").alias("sentences"))


_FOLD = "replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')"


@query(f"SELECT md5(trim(regexp_replace(lower({_FOLD}), '\\s+', ' ', 'g'))) AS search_key, count(*) AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def search_key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that one search would find alike."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(scripts.to_search_key(F.col("text"), F.lit("en"))).alias("search_key"))
    return docs.groupBy("search_key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).where("docs > 1")


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(lower({_FOLD}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, text <> {_FOLD} AS has_marks FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of whole documents, and whether folding changes them."""
    t = F.col("text")
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(scripts.slugify_vietnamese(t)).alias("slug"), (t != scripts.fold_vietnamese(t)).alias("has_marks"))


_LINT_DOCS = f"""
WITH m(lang, locale) AS ({_values(_LANGS)}), d AS (SELECT m.locale, text FROM documents JOIN m USING (lang)),
f AS (
  SELECT locale, 'empty-value' AS rule FROM d WHERE trim(text) = ''
  UNION ALL SELECT locale, 'gendered-particle' FROM d WHERE locale = 'th' AND regexp_matches(text, '(ครับ|ค่ะ|คะ)\\s*$')
  UNION ALL SELECT locale, 'hardcoded-plural' FROM d WHERE locale <> 'en' AND regexp_matches(text, '(?i)\\(s\\)|\\(es\\)')
  UNION ALL SELECT locale, 'missing-classifier' FROM d WHERE locale <> 'en' AND regexp_matches(text, '\\{{count\\}}\\s*\\S')
  UNION ALL SELECT locale, 'no-break-opportunity' FROM d WHERE locale = 'th' AND length(text) > 40 AND NOT regexp_matches(text, '[\\s\\x{{200B}}\\x{{A0}}]')
  UNION ALL SELECT locale, 'hardcoded-currency' FROM d WHERE locale <> 'en' AND regexp_matches(text, '[$€£]')
  UNION ALL SELECT locale, 'vietnamese-nfc' FROM d WHERE locale = 'vi' AND text <> nfc_normalize(text)
) SELECT locale, rule, count(*) AS findings FROM f GROUP BY ALL
"""


@query(_LINT_DOCS)
def lint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on documents as if each were a message of its language's locale."""
    to = R.literal_map(dict(_LANGS))
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text").where(F.col("lang").isin(*[a for a, _ in _LANGS])))
    rows = docs.select(to[F.col("lang")].alias("locale"), F.col("doc_id").cast("string").alias("key"), F.lit(None).cast("string").alias("register"), F.lit(None).cast("string").alias("plural"), F.col("text").alias("value"), F.lit(0).alias("ord"))
    return lint.lint(rows, reference=None).groupBy("locale", "rule").agg(F.count("*").alias("findings"))


_NOW = "1998-12-31 00:00:00"


@query(f"""
WITH s AS (SELECT event_type, CAST(epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-06-01 00:00:00') // 1000 AS BIGINT) AS ms FROM events),
u AS (SELECT *, CASE {" ".join(f"WHEN abs(ms) >= {n} THEN '{u}'" for u, n in dates.LENGTHS.items())} ELSE 'second' END AS unit FROM s),
v AS (SELECT *, CAST(floor(CAST(ms AS DOUBLE) / CASE unit {" ".join(f"WHEN '{u}' THEN {n}" for u, n in dates.LENGTHS.items())} END + 0.5) AS BIGINT) AS span FROM u)
SELECT event_type, unit, span, count(*) AS events FROM v GROUP BY ALL
""")
def event_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by how long before or after a moment they came."""
    span = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lit("2024-06-01 00:00:00").cast("timestamp"))
    events = _table(spark, sf_dir, "events").select("event_type", span.alias("ms"))
    return events.groupBy("event_type", dates.relative_unit(F.col("ms")).alias("unit"), dates.relative_value(F.col("ms")).alias("span")).agg(F.count("*").alias("events"))


_PARTS = [(c, v.count_order, R.classifier(c, "thing"), c in ("fil", "ceb", "fil-x-taglish")) for c, v in R.LOCALES.items()]


@query(f"WITH d(code, ord, clf, na) AS ({_values(_PARTS)}) SELECT p_partkey, d.code AS locale, {_PHRASE.format(n='CAST(p_size AS VARCHAR)', noun='p_name')} AS phrase FROM part CROSS JOIN d")
def counted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counted phrase for each part and locale."""
    locales = R.dim_locale(spark).select(F.col("code").alias("locale"))
    parts = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")).crossJoin(F.broadcast(locales))
    return parts.select("p_partkey", "locale", grammar.format_count(F.col("p_size"), F.col("p_name"), F.col("locale")).alias("phrase"))


@query("""
SELECT o_orderkey, CASE WHEN round(o_totalprice, 2) < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(round(o_totalprice, 2))) AS dollars,
  strftime(o_orderdate, '%b %-d, %Y') AS day, CAST(year(o_orderdate) + 543 AS INTEGER) AS buddhist_year,
  translate(CAST(year(o_orderdate) + 543 AS VARCHAR), '0123456789', '๐๑๒๓๔๕๖๗๘๙') AS thai_year
FROM orders""")
def localised_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their amount, day and year as locales write them."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    year = dates.to_buddhist_year(F.year("o_orderdate"))
    return orders.select("o_orderkey", numbers.format_currency(spark, F.col("o_totalprice"), "en").alias("dollars"), dates.format_date(spark, F.col("o_orderdate"), "en").alias("day"), year.cast("int").alias("buddhist_year"), digits.to_native_digits(year.cast("string"), "th").alias("thai_year"))


@query()
def currency_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances of suppliers in every locale's money."""
    locales = R.dim_locale(spark).select(F.col("code").alias("locale"))
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").crossJoin(F.broadcast(locales))
    return numbers.with_money(rows, "s_acctbal").select("s_suppkey", "locale", "money")


#: Short forms of thousands and millions in some locales.
_SHORT = "(VALUES ('en', 'K', 'M', ',.'), ('vi', '\u00a0N', '\u00a0Tr', '.,'), ('th', 'K', 'M', ',.'), ('id', '\u00a0rb', '\u00a0jt', '.,')) t(locale, thousand, million, marks)"


@query(f"""
WITH v AS (SELECT s_suppkey, locale, thousand, million, marks, round(s_acctbal, 3) AS n, round(s_acctbal / 100) AS p, s_acctbal * 1000 AS c, abs(s_acctbal * 1000) AS a FROM supplier CROSS JOIN {_SHORT}),
w AS (SELECT *, CASE WHEN round(a / 1e3) >= 1e3 THEN a / 1e6 WHEN round(a) >= 1e3 THEN a / 1e3 ELSE a END AS part, CASE WHEN round(a / 1e3) >= 1e3 THEN million WHEN round(a) >= 1e3 THEN thousand ELSE '' END AS unit FROM v)
SELECT s_suppkey, locale, CASE WHEN n < 0 THEN '-' ELSE '' END || translate(regexp_replace(format('{{:,.3f}}', abs(n)), '\\.?0+$', ''), ',.', marks) AS number,
  CASE WHEN p < 0 THEN '-' ELSE '' END || format('{{:.0f}}', abs(p)) || '%' AS percent,
  CASE WHEN c < 0 THEN '-' ELSE '' END || translate(CASE WHEN round(part, 1) < 100 THEN regexp_replace(format('{{:.1f}}', round(part, 1)), '\\.0$', '') ELSE format('{{:.0f}}', round(part)) END, ',.', marks) || unit AS compact FROM w""")
def short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances as plain, percent and compact numbers of some locales."""
    v = F.col("s_acctbal")
    parts = [F.struct(F.lit(c).alias("locale"), numbers.format_number(spark, v, c).alias("number"), numbers.format_percent(spark, v / 10000, c).alias("percent"), numbers.format_compact(spark, v * 1000, c).alias("compact")) for c in ("en", "vi", "th", "id")]
    return _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").select("s_suppkey", F.inline(F.array(*parts)))


@query()
def dates_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last order days as each country writes them."""
    span = _table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    parts = [F.struct(F.lit(c).alias("country"), dates.format_date_for_country(spark, F.col("first"), c).alias("first_day"), dates.format_date_for_country(spark, F.col("last"), c, style="long").alias("last_day"), dates.format_time(spark, F.col("last"), v.default_locale).alias("time")) for c, v in R.COUNTRIES.items()]
    return span.select(F.inline(F.array(*parts)))


@query()
def order_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before a moment customers last ordered, in Thai and English."""
    last = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    now = F.lit(_NOW).cast("timestamp")
    return last.select("o_custkey", *(dates.format_relative_time(spark, F.col("last"), now, c).alias(c) for c in ("th", "en")))


_TAGS = ["VI-vn", "th_TH", "ms-Arab-BN", "xx-YY", " en-SG-x-singlish ", "zh-Hans-SG-x-a", "jv-Java", "MS_bn", "id", "fil-PH"]
_RESOLVED = ["vi", "th", "ms-Arab-BN", None, "en-SG-x-singlish", "zh-Hans-SG", "jv-Java", "ms-BN", "id", "fil"]
_CHAINS = [" ".join(R.LOCALES[c].fallback) if c else "en" for c in _RESOLVED]


@query(_dealt_sql("customer", "c_custkey", list(zip(_TAGS, _RESOLVED, _CHAINS, strict=True)), "tag, locale, chain"))
def resolved_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language tags of customers resolved, and their fallback chains."""
    rows = _dealt(spark, sf_dir, "customer", "c_custkey", [(t,) for t in _TAGS], "tag string")
    return rows.select("c_custkey", "tag", resolve_locale(F.col("tag")).alias("locale"), F.array_join(fallback_chain(F.col("tag")), " ").alias("chain"))


_REQUESTS = [("a", None, None, "en;q=0.5,vi,th;q=0.8", "vi th en", "vi"), ("b", None, "KH", "en-US", "en-US", "km"), ("c", "lo", "TH", "th", "th", "lo"), ("d", "nope", None, "xx, lo;q=0.9", "xx lo", "lo"), ("e", None, None, None, None, "en")]


@query(_dealt_sql("events", "event_id", _REQUESTS, "id, cookie, country, header, tags, locale", "id, tags, locale"))
def negotiated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locales of web requests, one for each event, from cookie, country and header."""
    rows = _dealt(spark, sf_dir, "events", "event_id", [r[:4] for r in _REQUESTS], "id string, cookie string, country string, header string")
    return rows.select("event_id", "id", F.array_join(parse_accept_language(F.col("header")), " ").alias("tags"), locale_from_request(F.col("cookie"), F.col("country"), F.col("header")).alias("locale"))


@query("SELECT page_id, lower(regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1)) AS lang, CASE WHEN lower(regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1)) = 'en' THEN 'en' END AS locale FROM pages")
def page_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that each page names, and its locale."""
    lang = F.lower(F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1))
    return _table(spark, sf_dir, "pages").select("page_id", lang.alias("lang"), resolve_locale(lang).alias("locale"))


_JAWI = [("ng", "ڠ"), ("ny", "ڽ"), ("sy", "ش"), ("kh", "خ"), ("gh", "غ"), ("th", "ث"), ("dz", "ذ"), ("ch", "چ")]


def _jawi_sql(column: str) -> str:
    out = f"lower({column})"
    for a, b in _JAWI:
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate({out}, 'abcdefghijklmnopqrstuvwyz', 'ابچديفݢهيجکلمنوڤقرستوۏويز')"


@query(f"SELECT n_name, {_jawi_sql('n_name')} AS jawi, true AS is_jawi FROM nation")
def jawi_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in Jawi letters."""
    jawi = scripts.rumi_to_jawi(F.col("n_name"))
    return _table(spark, sf_dir, "nation").select("n_name", jawi.alias("jawi"), scripts.is_jawi(jawi).alias("is_jawi"))


_SYLLABLES = [("Tiếng", "sắc", True, "tieng"), ("Việt", "nặng", True, "viet"), ("chào", "huyền", True, "chao"), ("hỏi", "hỏi", True, "hoi"), ("ngã", "ngã", True, "nga"), ("ban", "ngang", False, "ban"), ("Đà", "huyền", True, "da")]


@query(_dealt_sql("customer", "c_custkey", _SYLLABLES, "syllable, tone, marked, search_key"))
def vietnamese_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tones, marks and search keys of customers' syllables."""
    s = F.col("syllable")
    rows = _dealt(spark, sf_dir, "customer", "c_custkey", [r[:1] for r in _SYLLABLES], "syllable string")
    return rows.select("c_custkey", "syllable", scripts.tone_of(s).alias("tone"), scripts.has_vietnamese_diacritics(s).alias("marked"), scripts.to_search_key(s, F.lit("vi")).alias("search_key"))


_TYPED = [("Tieengs Vieejt", "Tiếng Việt"), ("ddaa", "đâ"), ("chaof", "chào"), ("toans", "toán"), ("giayf", "giày"), ("HOAF", "HÒA"), ("nawxng", "nẵng")]


@query(_dealt_sql("customer", "c_custkey", _TYPED, "keys, composed"))
def typed_vietnamese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' Telex keystrokes composed."""
    rows = _dealt(spark, sf_dir, "customer", "c_custkey", [r[:1] for r in _TYPED], "keys string")
    return rows.select("c_custkey", "keys", scripts.from_telex(F.col("keys")).alias("composed"))


_MYANMAR = [("မြန်မာ", "unicode", "မြန်မာ"), ("ေက်ာင္း", "zawgyi", "ကျောင်း"), ("hello", "unknown", "hello"), ("က", "unicode", "က")]


@query(_dealt_sql("part", "p_partkey", _MYANMAR, "text, encoding, converted", "text, encoding"))
def myanmar_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which encoding Burmese texts of parts are in."""
    rows = _dealt(spark, sf_dir, "part", "p_partkey", [r[:1] for r in _MYANMAR], "text string")
    return rows.select("p_partkey", "text", scripts.detect_myanmar_encoding(F.col("text"))["encoding"].alias("encoding"))


@query(_dealt_sql("part", "p_partkey", _MYANMAR, "text, encoding, converted", "text, converted"))
def converted_myanmar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burmese texts of parts in Unicode, whatever they were in."""
    rows = _dealt(spark, sf_dir, "part", "p_partkey", [r[:1] for r in _MYANMAR], "text string")
    return rows.select("p_partkey", "text", scripts.normalize_myanmar(F.col("text")).alias("converted"))


_POLITE = [("Hello.", "th", "female", "Hello ค่ะ."), ("Hello?", "th", "male", "Hello ครับ?"), ("Hello", "th", "neutral", "Hello"), ("Salamat!  ", "fil", "neutral", "Salamat po!"), ("Hi", "en", "male", "Hi")]


@query(_dealt_sql("events", "event_id", _POLITE, "text, locale, gender, polite"))
def polite_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of events with the particle of the speaker."""
    rows = _dealt(spark, sf_dir, "events", "event_id", [r[:3] for r in _POLITE], "text string, locale string, gender string")
    return rows.select("*", grammar.with_politeness(F.col("text"), F.col("locale"), F.col("gender")).alias("polite"))


def _pronoun_rows() -> list[tuple]:
    every = R.pronouns()
    return [(c, r, who, g, pair[i]) for c, v in R.LOCALES.items() for r, t in (every.get(c) or every.get(v.base_locale) or every["en"]).items() for who, pair in t.items() for i, g in enumerate(("male", "female"))]


@query(_dealt_sql("customer", "c_custkey", _pronoun_rows(), "locale, register, referent, gender, pronoun"))
def pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronouns of every locale, register, referent and gender, dealt out to customers."""
    asked = _dealt(spark, sf_dir, "customer", "c_custkey", [r[:4] for r in _pronoun_rows()], "locale string, register string, referent string, gender string")
    return asked.select("*", grammar.pronoun(F.col("locale"), F.col("referent"), F.col("register"), F.col("gender")).alias("pronoun"))


_NAMES = [("VN", "Nguyễn", "Văn", "An", None, None, "Nguyễn Văn An", "An"), ("MM", None, None, None, "Aung San", None, "Aung San", "Aung San"), ("MY", "Ahmad", None, "Siti", None, "binti", "Siti binti Ahmad", "Siti"), ("ID", None, None, "Sukarno", None, None, "Sukarno", "Sukarno"), ("TH", "Jaidee", None, "Somchai", None, None, "Somchai Jaidee", "Somchai")]


@query(_dealt_sql("customer", "c_custkey", _NAMES, "country, family, middle, given, full_name, patronymic, formatted, short", "country, formatted, short"))
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers as countries write them."""
    rows = _dealt(spark, sf_dir, "customer", "c_custkey", [r[:6] for r in _NAMES], "country string, family string, middle string, given string, full string, patronymic string")
    name = F.struct("full", "given", "middle", "family", "patronymic", F.lit(None).cast("string").alias("nickname"))
    return rows.select("c_custkey", "country", grammar.format_name(name, F.col("country")).alias("formatted"), grammar.short_name(name, F.col("country")).alias("short"))


_MESSAGES = [
    ("en", "cart.title", None, None, "Your cart", 0), ("en", "cart.items", None, "one", "{count} item", 0), ("en", "cart.items", None, "other", "{count} items", 1),
    ("en", "greet", "formal", None, "Good day {name}", 0), ("en", "greet", "casual", None, "Hey {name}", 1), ("en", "pay", None, None, "Pay {amount}", 0),
    ("th", "cart.title", None, None, "ตะกร้าของคุณ", 0), ("th", "cart.items", None, None, "{count} ชิ้น", 0), ("th", "greet", "formal", None, "สวัสดีครับ", 0),
    ("vi", "cart.title", None, None, "Your cart", 0), ("vi", "pay", None, None, "Trả $5 {total}", 0), ("lo", "greet", None, None, "", 0),
]
_LONG = "locale string, key string, register string, plural string, value string, ord int"
_MESSAGE_SQL = f"m AS (SELECT locale, key || '.' || s_suppkey AS key, register, plural, value, ord FROM supplier CROSS JOIN ({_values(_MESSAGES)}) t(locale, key, register, plural, value, ord))"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal messages of every supplier, whose number ends their keys."""
    held = F.array(*(F.struct(*(F.lit(v) for v in r)) for r in _MESSAGES)).cast(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in _LONG.split(', '))}>>")
    rows = spread(_table(spark, sf_dir, "supplier").select("s_suppkey")).select("s_suppkey", F.explode(held).alias("m")).select("s_suppkey", "m.*")
    return rows.withColumn("key", F.concat_ws(".", "key", F.col("s_suppkey").cast("string"))).drop("s_suppkey")


_ASKED = [(1, "th", "cart.items", None, 3.0, "3 ชิ้น", "th", False), (2, "en", "cart.items", None, 1.0, "1 item", "en", False), (3, "lo", "cart.title", None, None, "ตะกร้าของคุณ", "th", False), (4, "vi", "greet", "casual", None, "Hey {name}", "en", False), (5, "en", "nope", None, None, "nope", None, True), (6, "en", "cart.items", None, 1500.0, "1,500 items", "en", False)]


@query(f"SELECT o_orderkey AS request_id, text, matched_locale, missing FROM ({_dealt_sql('orders', 'o_orderkey', [r[5:] for r in _ASKED], 'text, matched_locale, missing')})")
def resolved_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that orders ask for, found through fallback chains, registers and plural forms."""
    asked = _dealt(spark, sf_dir, "orders", "o_orderkey", [r[1:5] for r in _ASKED], "locale string, key string, register string, count double").withColumnRenamed("o_orderkey", "request_id")
    return messages.resolve_messages(asked, spark.createDataFrame(_MESSAGES, _LONG)).select("request_id", "text", "matched_locale", "missing")


@query(f"""
WITH {_MESSAGE_SQL}, k AS (SELECT DISTINCT key FROM m WHERE locale = 'en'), l AS (SELECT DISTINCT locale FROM m WHERE locale <> 'en'), h AS (SELECT DISTINCT locale, key FROM m)
SELECT l.locale, count(*) AS total, count(h.key) AS translated, coalesce(string_agg(CASE WHEN h.key IS NULL THEN k.key END, ' ' ORDER BY k.key), '') AS missing
FROM k CROSS JOIN l LEFT JOIN h ON h.locale = l.locale AND h.key = k.key GROUP BY l.locale""")
def bundle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the reference each locale has."""
    return messages.coverage(_messages(spark, sf_dir)).withColumn("missing", F.array_join("missing", " "))


_FINDINGS = [
    ("lo", "greet", "empty-value"), ("lo", "greet", "missing-placeholder"), ("lo", "cart.title", "missing-key"), ("lo", "cart.items", "missing-key"), ("lo", "pay", "missing-key"),
    ("th", "cart.items", "missing-classifier"), ("th", "greet", "gendered-particle"), ("th", "greet", "missing-placeholder"), ("th", "pay", "missing-key"),
    ("vi", "cart.title", "untranslated"), ("vi", "pay", "hardcoded-currency"), ("vi", "pay", "missing-placeholder"), ("vi", "pay", "unknown-placeholder"), ("vi", "cart.items", "missing-key"), ("vi", "greet", "missing-key"),
]


@query(f"SELECT locale, key || '.' || s_suppkey AS key, rule FROM supplier CROSS JOIN ({_values(_FINDINGS)}) t(locale, key, rule)")
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules find in the literal messages."""
    return lint.lint(_messages(spark, sf_dir)).select("locale", "key", "rule")


_COUNTS = [("th", 20, 20, 60, 20, 0, 0), ("vi", 20, 20, 60, 0, 0, 0), ("lo", 10, 5, 5, 1, 1, 2), ("km", 0, 0, 0, 0, 0, 0), ("fil-x-taglish", 8, 8, 16, 0, 2, 1), ("en-SG", 5, 500, 9000, -3, 0, 0)]
_COUNT_NAMES = ("locale", "total_keys", "translated_keys", "filled_register_slots", "draft_keys", "errors", "warnings")


@query(f"""
WITH c AS (SELECT locale, {", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in _COUNT_NAMES[1:])} FROM ({_dealt_sql("supplier", "s_suppkey", _COUNTS, ", ".join(_COUNT_NAMES))}) GROUP BY locale),
a AS (SELECT locale, total_keys AS t, least(greatest(translated_keys, 0), total_keys) AS d, CASE WHEN locale = 'fil-x-taglish' THEN 2 ELSE 3 END AS r, filled_register_slots AS f, draft_keys AS g, errors AS e, warnings AS w FROM c),
b AS (SELECT *, least(greatest(g, 0), d) AS dr, t * r AS s, least(greatest(f, 0), t * r) AS fs FROM a),
x AS (SELECT locale, CASE WHEN t > 0 THEN d / t ELSE 0 END * 35 AS p1, CASE WHEN s > 0 THEN fs / s ELSE 0 END * 25 AS p2,
  CASE WHEN d > 0 THEN greatest(0, 1 - (e + 0.4 * w) / d) ELSE 0 END * 25 AS p3, CASE WHEN d > 0 THEN (d - dr) / d ELSE 0 END * 15 AS p4 FROM b),
y AS (SELECT locale, CAST(floor(round(p1, 2) + round(p2, 2) + round(p3, 2) + round(p4, 2) + 0.5) AS INTEGER) AS score FROM x)
SELECT locale, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM y""")
def readiness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and grades of locales from the counts of suppliers."""
    rows = _dealt(spark, sf_dir, "supplier", "s_suppkey", _COUNTS, "locale string, " + ", ".join(f"{n} long" for n in _COUNT_NAMES[1:]))
    return readiness.score_readiness(rows.groupBy("locale").agg(*(F.sum(n).alias(n) for n in _COUNT_NAMES[1:]))).select("locale", "score", "grade")


@query()
def bundle_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness of the literal messages, and what drags each locale most."""
    return readiness.readiness_from_bundles(_messages(spark, sf_dir)).select("locale", "score", "grade", "top_drag")


@query("""
WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) || ':' || event_type AS key, ts, props FROM events),
r AS (SELECT event_id, key, lag(props) OVER (PARTITION BY key ORDER BY ts, event_id) AS before, props AS after FROM e)
SELECT event_id, key, before, after FROM r""")
def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits: the value before and after each."""
    at = F.struct("ts", "event_id")
    edits = _table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.lit("en").alias("locale"), F.lit("neutral").alias("register"), F.col("props").alias("value"), F.lit("u").alias("user"), F.lit("human").alias("source"), at.alias("at"))
    none = spark.createDataFrame([], "key string, locale string, register string, value string")
    _, revisions = store.apply_edits(none, edits)
    return revisions.select(F.col("at.event_id").alias("event_id"), "key", "before", "after")


@query("SELECT event_id, event_type, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 of a log."""
    log = _table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.struct("ts", "event_id").alias("at"))
    return store.newest_revisions(log).select("event_id", "event_type", "at_ms")


@query("""
SELECT 'key,description,en,vi' || chr(10) || string_agg(n_name || ',' || 'nation ' || CAST(n_nationkey AS VARCHAR) || ',' || CASE WHEN contains(n_name || ', ' || CAST(n_regionkey AS VARCHAR), ',') THEN '"' || n_name || ', ' || CAST(n_regionkey AS VARCHAR) || '"' END || ',', chr(10) ORDER BY n_name) AS body FROM nation""")
def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as translation keys, in one CSV file."""
    keys = _table(spark, sf_dir, "nation").select(F.lit("p").alias("project_id"), F.col("n_name").alias("name"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("description"), F.create_map(F.lit("en"), F.create_map(F.lit("neutral"), F.concat("n_name", F.lit(", "), F.col("n_regionkey").cast("string")))).alias("values"))
    return export.export_keys("csv", keys, ["en", "vi"]).select("body")


@query("""
SELECT '{' || chr(10) || '  "nation": {' || chr(10) || string_agg('    "' || lower(n_name) || '": "' || n_name || '"', ',' || chr(10) ORDER BY lower(n_name)) || chr(10) || '  }' || chr(10) || '}' AS body, 'application/json; charset=utf-8' AS content_type, 'en.json' AS filename FROM nation
UNION ALL SELECT '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<resources>' || chr(10) || string_agg('    <string name="nation_' || replace(lower(n_name), ' ', '_') || '">' || n_name || '</string>', chr(10) ORDER BY lower(n_name)) || chr(10) || '</resources>' || chr(10), 'application/xml; charset=utf-8', 'strings-en.xml' FROM nation
UNION ALL SELECT string_agg('"nation.' || lower(n_name) || '" = "' || n_name || '";', chr(10) ORDER BY lower(n_name)) || chr(10), 'text/plain; charset=utf-8', 'Localizable-en.strings' FROM nation""")
def exported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as translation files of the other formats."""
    keys = _table(spark, sf_dir, "nation").select(F.lit("p").alias("project_id"), F.concat(F.lit("nation."), F.lower("n_name")).alias("name"), F.lit(None).cast("string").alias("description"), F.create_map(F.lit("en"), F.create_map(F.lit("neutral"), F.col("n_name"))).alias("values"))
    files = [export.export_keys(f, keys, ["en"]) for f in ("json", "android", "ios")]
    return files[0].unionByName(files[1]).unionByName(files[2])


@query("""
WITH k AS (SELECT p_partkey AS name, 'old' AS v, p_partkey % 5 = 0 AS regulated FROM part), e AS (SELECT p_partkey + 10 AS name FROM part)
SELECT CAST(coalesce(k.name, e.name) AS VARCHAR) AS name, CASE WHEN k.name IS NULL THEN 'created' WHEN e.name IS NOT NULL AND NOT regulated THEN 'updated' WHEN e.name IS NOT NULL THEN 'skipped' ELSE 'kept' END AS action,
  CASE WHEN k.name IS NULL OR (e.name IS NOT NULL AND NOT regulated) THEN 'new' ELSE 'old' END AS value
FROM k FULL JOIN e ON k.name = e.name""")
def imported_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import into a project of keys, some of them regulated."""
    parts = _table(spark, sf_dir, "part")
    keys = parts.select(F.lit("p").alias("project_id"), F.col("p_partkey").cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.create_map(F.lit("vi"), F.create_map(F.lit("neutral"), F.lit("old"))).alias("values"), F.array().cast("array<string>").alias("draft"), (F.col("p_partkey") % 5 == 0).alias("regulated"))
    entries = parts.select((F.col("p_partkey") + 10).cast("string").alias("name"), F.lit("new").alias("value"))
    return store.import_entries(keys, entries, "p", "vi").select("name", "action", F.col("values")["vi"]["neutral"].alias("value"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, CAST(l_returnflag = 'R' AS INTEGER) AS b FROM lineitem),
i AS (SELECT l_orderkey, sum(b) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT l_orderkey, max(n) AS longest FROM (SELECT l_orderkey, g, count(*) AS n FROM i GROUP BY ALL) GROUP BY l_orderkey""")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most lines of an order in a row without a return."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", *order, (F.col("l_returnflag") == "R").alias("is_break"))
    return evaluate.longest_unbroken(lines, ["l_orderkey"], order, "is_break")


_SPANS = rf"list_transform(regexp_extract_all(text, '{_WORD_RE2}|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda s: length(s))".replace("\\\\", "\\")


@query(f"""
WITH s AS (SELECT conv_id, turn, text, {_SPANS} AS n FROM conversations),
e AS (SELECT conv_id, turn, text, list_max(list_filter(list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])), lambda x: x <= 39)) AS cut FROM s)
SELECT conv_id, turn, CASE WHEN length(text) <= 40 THEN text ELSE regexp_replace(left(text, CAST(coalesce(cut, 39) AS BIGINT)), '\\s+$', '') || '…' END AS truncated FROM e""")
def truncated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns in at most 40 clusters."""
    turns = spread(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit("en").alias("locale")))
    return segment.with_truncated(turns, "text", "locale", 40).select("conv_id", "turn", "truncated")


_THAI = ["ฉัน", "รัก", "ภาษา", "ไทย", "มาก", "ราคา", "บาท", "สวัสดี", "ครับ"]
_UNSPACED = [("th", "ฉันรักภาษาไทยมาก", "ฉัน|รัก|ภาษา|ไทย|มาก"), ("th", "ราคา 1,500 บาท", "ราคา|1,500|บาท"), ("th", "สวัสดีครับ", "สวัสดี|ครับ"), ("en", "e-mail can't 1,500", "e-mail|can't|1,500"), ("my", "မြန်မာ", "မြန်|မာ")]


@query(_dealt_sql("part", "p_partkey", _UNSPACED, "locale, text, words"))
def segmented_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of texts with and without spaces, by a lexicon that is a parameter."""
    from ..functions.clusters import Lexicon

    rows = _dealt(spark, sf_dir, "part", "p_partkey", [r[:2] for r in _UNSPACED], "locale string, text string")
    return segment.with_words(rows, "text", "locale", {"th": Lexicon.of(_THAI)}).select("p_partkey", "locale", "text", F.array_join("words", "|").alias("words"))


_ENDS = "SELECT role AS locale, conv_id, turn, unnest(list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i]))) AS pos FROM (SELECT role, conv_id, turn, list_transform(regexp_extract_all(text, '{pattern}'), lambda s: length(s)) AS n FROM conversations)"


@query(f"""
WITH p AS ({_ENDS.format(pattern=_WORD_RE2 + "|(?s:.)")}), g AS ({_ENDS.format(pattern="[^ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]")}),
c AS (SELECT locale, count(*) FILTER (WHERE p.pos IS NOT NULL AND g.pos IS NOT NULL) AS tp, count(*) FILTER (WHERE g.pos IS NULL) AS fp, count(*) FILTER (WHERE p.pos IS NULL) AS fn
  FROM p FULL JOIN g USING (locale, conv_id, turn, pos) GROUP BY locale),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r""")
def boundary_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well spaces and the tokenizer agree on where words of conversation turns end."""
    turns = spread(_table(spark, sf_dir, "conversations")).select(F.col("role").alias("locale"), F.concat_ws(":", "conv_id", "turn").alias("text_id"), "text")

    def ends(pattern: str) -> DataFrame:
        parts = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        sums = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out")))["out"]
        return turns.select("locale", "text_id", F.explode(sums).alias("at"))

    return evaluate.boundary_scores(ends(rf"(?:{text.WORD})|(?s:.)"), ends(r"\S+|(?s:\s)"))


_UNSPACED_LOCALES = [("th", 1, "Thai"), ("my", 1, "Mymr"), ("shn", 1, "Mymr"), ("km", 1, "Khmr"), ("lo", 1, "Laoo"), ("zh-Hans-SG", 1, "Hans")]


@query(_dealt_sql("customer", "c_custkey", _UNSPACED_LOCALES, "code, n_countries, script"))
def unspaced_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locales of scripts without spaces, by customer, from the registry."""
    rows = _dealt(spark, sf_dir, "customer", "c_custkey", [r[:1] for r in _UNSPACED_LOCALES], "code string")
    held = R.dim_locale(spark).where("not word_spaced").select("code", F.size("countries").alias("n_countries"), "script")
    return rows.join(F.broadcast(held), "code").select("c_custkey", "code", "n_countries", "script")  # a row for each locale


@query(f"WITH f(locale, rank, tag) AS ({_values([(c, i, t) for c in _CODES for i, t in enumerate(R.chain(c))])}), n AS (SELECT n_nationkey, n_name FROM nation) SELECT n.n_name, min_by(f.tag, f.rank) AS negotiated FROM n JOIN f ON f.locale = (SELECT code FROM ({_values([(i, c) for i, c in enumerate(_CODES)])}) d(i, code) WHERE d.i = n.n_nationkey) WHERE f.tag IN ('th', 'ms', 'en') GROUP BY n.n_name")
def negotiated_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of three locales for each nation's, as a join with the fallback table."""
    from ..functions.locale import negotiated

    code = F.element_at(F.array(*map(F.lit, _CODES)), F.col("n_nationkey") + 1)
    asked = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("request_id"), F.array(code).alias("requested"))
    pool = spark.createDataFrame([("th",), ("ms",), ("en",)], "tag string")
    return negotiated(asked, R.dim_fallback(spark), pool).select(F.col("request_id").alias("n_name"), "negotiated")
