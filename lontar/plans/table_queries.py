"""More queries over the supplied tables, each with SQL that says the same from the tables alone.

Where the tables hold no text of a script, texts are put together from rows and letters, in Spark and in SQL alike.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digits, grammar, numbers, scripts, segment, text
from ..functions.locale import cluster_script, first_day_of_week, get_locale, html_attributes, is_supported, needs_segmentation
from ..operators import evaluate, export, lint, messages, readiness, store
from ..ship import spread
from ..sources import bundles
from .queries import ORACLES, _dealt, _table, _values, query

_FOUR = ("vi", "id", "th", "en")


def _pick(at, values) -> F.Column:
    """The value at a number, round and round."""
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _no_text(*names: str) -> list[F.Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


#: Parts, as the items that translation keys are about.
_ITEMS = "(SELECT p_partkey AS item, p_name || ' ' || p_partkey AS title, p_size % 5 AS shelf FROM part)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"), (F.col("p_size") % 5).alias("shelf")))


# ------------------------------------------------------------ messages and bundles

_GROUPED = "regexp_replace(format('{{:,.3f}}', {v}), '\\.?0+$', '')"


@query(f"""
WITH r AS (SELECT event_id AS request_id, user_id % 25 AS n, {_sql_list(_FOUR)}[user_id % 4 + 1] AS locale, (event_id % 3) * 1234 + 1 AS c, round(value, 2) AS v FROM events),
m AS (SELECT r.*, n_name, n IS NOT NULL AND locale = 'vi' AND n % 2 = 0 AS vi, locale = 'th' AND n % 3 = 0 AS th FROM r LEFT JOIN nation ON n_nationkey = n AND n < 23),
w AS (SELECT *, format('{{:,d}}', c) AS cs, {_GROUPED.format(v='v')} AS vs FROM m),
x AS (SELECT *, CASE WHEN locale IN ('vi', 'id') THEN translate(cs, ',.', '.,') ELSE cs END AS count, CASE WHEN locale IN ('vi', 'id') THEN translate(vs, ',.', '.,') ELSE vs END AS price FROM w)
SELECT request_id, n_name IS NULL AS missing, CASE WHEN n_name IS NULL THEN NULL WHEN vi THEN 'vi' WHEN th THEN 'th' ELSE 'en' END AS matched_locale,
  CASE WHEN n_name IS NULL THEN 'n' || n WHEN vi THEN count || ' đơn từ ' || n_name || ', ' || price || ' {{unit}}' WHEN th THEN n_name || ' ' || count || ' ชิ้น'
  WHEN c = 1 THEN count || ' order from ' || n_name || ' at ' || price ELSE count || ' orders from ' || n_name || ' at ' || price END AS text FROM x""")
def localised_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages about nations, asked for by events in four locales, with counts and prices as those write them."""
    nations = _table(spark, sf_dir, "nation").where("n_nationkey < 23")
    key, name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name")

    def held(locale, plural, value, rows, at=0):
        return rows.select(F.lit(locale).alias("locale"), key, F.lit(None).cast("string").alias("register"), F.lit(plural).cast("string").alias("plural"), value.alias("value"), F.lit(at).alias("ord"))

    every = held("en", "one", F.concat(F.lit("{count} order from "), name, F.lit(" at {price}")), nations)
    every = every.unionByName(held("en", "other", F.concat(F.lit("{count} orders from "), name, F.lit(" at {price}")), nations, 1))
    every = every.unionByName(held("vi", None, F.concat(F.lit("{count} đơn từ "), name, F.lit(", {price} {unit}")), nations.where("n_nationkey % 2 = 0")))
    every = every.unionByName(held("th", None, F.concat(name, F.lit(" {count} ชิ้น")), nations.where("n_nationkey % 3 = 0")))
    asked = _table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), _pick(F.col("user_id"), _FOUR).alias("locale"), F.concat(F.lit("n"), (F.col("user_id") % 25).cast("string")).alias("key"), ((F.col("event_id") % 3) * 1234 + 1).cast("double").alias("count"), F.create_map(F.lit("price"), F.round("value", 2)).alias("numbers"))
    return messages.resolve_messages(asked, every).select("request_id", "text", "matched_locale", "missing")


@query(f"""
SELECT item, '#' || (item % 7) AS shown, CASE WHEN item % 2 = 0 THEN 'flat' ELSE 'nested' END AS found, 'inner ' || title AS inner_text FROM {_ITEMS}""")
def flattened_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON bundles, one for each part, flattened to dotted keys; a key stored flat wins."""
    items = _items(spark, sf_dir)
    k, n = F.col("item").cast("string"), F.col("title")
    flat = F.when(F.col("item") % 2 == 0, F.lit(', "a.b": "flat"')).otherwise("")
    body = F.concat(F.lit('{"a": {"b": "nested", "c": {"d": "inner '), n, F.lit('"}}, "shown": {"formal": "#'), (F.col("item") % 7).cast("string"), F.lit('"}'), flat, F.lit("}"))
    long = bundles.flatten_bundles(items.select(k.alias("locale"), body.alias("body")))
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    return long.groupBy(F.col("locale").cast("long").alias("item")).agg(value("shown").alias("shown"), value("a.b").alias("found"), value("a.c.d").alias("inner_text"))


@query("SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events")
def property_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of the events' properties, as an import reads them."""
    body = F.regexp_replace("props", r"([0-9.]+)", '"$1"')
    long = bundles.flatten_bundles(_table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("locale"), body.alias("body")), message_rule=False)
    return long.select(F.col("locale").cast("long").alias("event_id"), "key", "value")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's keys: parts in English, some in Thai and Lao, with drafts and regulated ones."""
    n = F.col("item")
    one = lambda x: F.create_map(F.lit("neutral"), x)
    table = F.map_concat(
        F.create_map(F.lit("en"), one(F.col("title"))),
        F.when(n % 2 == 0, F.create_map(F.lit("th"), F.create_map(F.lit("formal"), F.concat(F.lit("th "), F.col("title"))))).otherwise(F.create_map().cast("map<string,map<string,string>>")),
        F.when(n % 3 == 0, F.create_map(F.lit("lo"), one(F.when(n % 6 == 0, "").otherwise(F.concat(F.lit("lo "), F.col("title")))))).otherwise(F.create_map().cast("map<string,map<string,string>>")),
    )
    draft = F.when(n % 4 == 0, F.array(F.lit("lo"))).otherwise(F.array().cast("array<string>"))
    return _items(spark, sf_dir).select(_pick(F.col("shelf"), ("p", "p", "q")).alias("project_id"), F.col("title").alias("name"), *_no_text("description"), table.alias("values"), draft.alias("draft"), (n % 5 == 0).alias("regulated"))


@query(f"""
SELECT title AS key, CASE WHEN n % 3 = 0 AND n % 6 <> 0 THEN 'lo ' || title WHEN n % 2 = 0 THEN 'th ' || title ELSE title END AS value,
  CASE WHEN n % 3 = 0 AND n % 6 <> 0 THEN 'lo' WHEN n % 2 = 0 THEN 'th' ELSE 'en' END AS matched_locale
FROM (SELECT title, item AS n FROM {_ITEMS}) WHERE NOT (n % 5 = 0 AND n % 4 = 0)""")
def application_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an application in Lao loads: each key in the first locale of the chain that has a text, no regulated drafts."""
    return messages.bundle(_stored(spark, sf_dir), "lo")


@query(f"SELECT title AS name, item % 4 = 0 AS has_draft FROM {_ITEMS} WHERE shelf % 3 < 2")
def listed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one project."""
    return store.list_keys(_stored(spark, sf_dir), "p").select("name", (F.size("draft") > 0).alias("has_draft"))


@query(f"SELECT title AS key, title AS source, 'th ' || title AS target FROM {_ITEMS} WHERE item % 2 = 0 AND item % 4 <> 0 ORDER BY title LIMIT 20")
def remembered_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of approved texts in two locales, the first twenty by key."""
    keys = _stored(spark, sf_dir)
    values = keys.select(F.col("name").alias("key"), F.explode("values").alias("locale", "own")).select("key", "locale", F.lit("neutral").alias("register"), F.element_at(F.map_values("own"), 1).alias("value"))
    drafts = keys.where(F.size("draft") > 0).select(F.col("name").alias("key"), F.lit("th").alias("locale"))
    return store.translation_memory(values, "en", "th", drafts=drafts)


@query(f"""
SELECT title AS name, CASE WHEN shelf % 3 < 2 THEN 'p' ELSE 'q' END AS project_id FROM {_ITEMS} WHERE item % 7 <> 0
UNION ALL SELECT r_name || ' region', 'p' FROM region""")
def edited_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys after some were made (those that exist are left) and some deleted."""
    keys = _stored(spark, sf_dir)
    made = _table(spark, sf_dir, "region").select(F.lit("p").alias("project_id"), F.concat("r_name", F.lit(" region")).alias("name"))
    made = made.unionByName(keys.select("project_id", "name"))
    spare = [F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in keys.columns if c not in ("project_id", "name")]
    gone = _items(spark, sf_dir).where("item % 7 = 0").select(_pick(F.col("shelf"), ("p", "p", "q")).alias("project_id"), F.col("title").alias("name"))
    return store.delete_keys(store.create_keys(keys, made.select("project_id", "name", *spare)), gone).select("name", "project_id")


@query("""
SELECT c_custkey, n_name AS project, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE c_custkey % 2 = 0 OR n_nationkey % 2 = 1 END AS can_edit, c_custkey % 3 IN (0, 2) AS translates
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def edit_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may edit which project's locale: by role and by the locales that translators have."""
    n = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("project"), _pick(F.col("n_nationkey"), ("vi", "th")).alias("locale"))
    members = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", _pick(F.col("c_custkey"), ("owner", "viewer", "translator")).alias("role"), F.when(F.col("c_custkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("th"), F.lit("lo"))).alias("locales"))
    rows = store.can_edit(members.join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    return rows.select("c_custkey", "project", "can_edit", store.has_role(F.col("role"), "translator").alias("translates"))


@query("SELECT n_name AS project FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING')")
def member_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with a member of a group, by a table of memberships."""
    members = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("project_id"))
    projects = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project"))
    return store.projects_with(projects, members).select("project")


@query("SELECT s_suppkey AS id, s_name || '@example.org' AS email, s_name AS name FROM supplier")
def safe_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts without what no one may see."""
    return store.safe_users(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit("@example.org")).alias("email"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("password_hash")))


@query("""
WITH l(locale, has) AS (VALUES ('vi', 2), ('th', 3), ('lo', 7)), k AS (SELECT locale, n_name, n_nationkey % has = 0 AS here FROM nation CROSS JOIN l)
SELECT locale, count(*) AS total, count(*) FILTER (WHERE here) AS translated, string_agg(CASE WHEN NOT here THEN n_name END, ' ' ORDER BY n_name) AS missing FROM k GROUP BY locale""")
def nation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nations each locale has of the reference."""
    n = _table(spark, sf_dir, "nation")
    long = lambda code, rows: rows.select(F.lit(code).alias("locale"), F.col("n_name").alias("key"), *_no_text("register", "plural"), F.col("n_name").alias("value"), F.lit(0).alias("ord"))
    every = long("en", n)
    for code, has in (("vi", 2), ("th", 3), ("lo", 7)):
        every = every.unionByName(long(code, n.where(F.col("n_nationkey") % has == 0)))
    return messages.coverage(every).withColumn("missing", F.array_join("missing", " "))


# ------------------------------------------------------------ lint and readiness

_LINT_CASES = {
    0: ("", ["empty-value", "missing-placeholder"]),
    1: ("{n} {{name}} ครับ", ["gendered-particle"]),
    2: ("{n}(s) {{name}}", ["hardcoded-plural"]),
    3: ("{{count}} {n}", ["missing-classifier", "missing-placeholder", "unknown-placeholder"]),
    4: ("{n} {{name}}", ["untranslated"]),
    5: (None, ["missing-key"]),
    6: ("{n} $5 {{name}}", ["hardcoded-currency"]),
    7: ("ก" * 50, ["no-break-opportunity", "missing-placeholder"]),
    8: ("{n}: {{name}}", []),
}
_LINT_RULES = " ".join(f"WHEN {k} THEN {_sql_list(v[1]) if v[1] else '[]'}" for k, v in _LINT_CASES.items())


_LINTED = f"""
SELECT 'th' AS locale, title AS key, unnest(CASE item % 9 {_LINT_RULES} END) AS rule FROM {{items}}
UNION ALL SELECT 'vi', title, unnest(CASE item % 3 WHEN 0 THEN ['vietnamese-nfc'] WHEN 1 THEN ['missing-key'] ELSE [] END) FROM {{items}}
UNION ALL SELECT 'my', title, unnest(CASE item % 2 WHEN 0 THEN ['zawgyi-encoding'] ELSE [] END) FROM {{items}}"""


def _linted(items: DataFrame) -> DataFrame:
    """Findings in messages about items (item, title), each with its fault."""
    name = F.col("title")
    spare = [*_no_text("register", "plural"), F.lit(0).alias("ord")]
    said = lambda code, value: items.select(F.lit(code).alias("locale"), name.alias("key"), value.alias("value"), *spare).where("value is not null")

    def built(pattern: str | None) -> F.Column:
        if pattern is None:
            return F.lit(None).cast("string")
        return F.replace(F.lit(pattern.replace("{n}", "\0").replace("{{", "{").replace("}}", "}")), F.lit("\0"), name)

    thai = F.lit(None).cast("string")
    for k, (pattern, _) in _LINT_CASES.items():
        thai = F.when(F.col("item") % 9 == k, built(pattern)).otherwise(thai)
    vietnamese = F.when(F.col("item") % 3 == 0, F.concat(name, F.lit(" ế {name}"))).when(F.col("item") % 3 == 2, F.concat(name, F.lit(" ế {name}")))
    burmese = F.concat(name, F.when(F.col("item") % 2 == 0, "ေက်ာင္း {name}").otherwise("မြန်မာ {name}"))
    every = said("en", F.concat(name, F.lit(" {name}"))).unionByName(said("th", thai)).unionByName(said("vi", vietnamese)).unionByName(said("my", burmese))
    return lint.lint(every).select("locale", "key", "rule")


@query(_LINTED.format(items="(SELECT n_nationkey AS item, n_name AS title FROM nation)"))
def linted_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on messages about nations, each with its fault."""
    return _linted(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item"), F.col("n_name").alias("title")))


@query(_LINTED.format(items=_ITEMS))
def linted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on messages about parts, each with its fault."""
    return _linted(_items(spark, sf_dir))


@query(f"""
SELECT shelf AS region, CAST(count(*) FILTER (WHERE item % 3 = 0) AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE item % 3 <> 0) AS BIGINT) AS warnings FROM {_ITEMS} GROUP BY shelf""")
def issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity for each shelf of parts."""
    issues = _items(spark, sf_dir).select(F.col("shelf").alias("region"), F.when(F.col("item") % 3 == 0, "error").otherwise("warning").alias("severity"))
    return lint.issue_counts(issues, "region")


@query(f"""
WITH k AS (SELECT locale, title, item % 5 = 0 AS e FROM {_ITEMS} CROSS JOIN (VALUES ('th'), ('lo')) l(locale))
SELECT locale, line FROM (
  SELECT locale, locale || ': ' || count(*) FILTER (WHERE e) || ' errors, ' || count(*) FILTER (WHERE NOT e) || ' warnings' AS line FROM k GROUP BY locale
  UNION ALL SELECT locale, '  [' || CASE WHEN e THEN 'error' ELSE 'warning' END || '] ' || title || ' r: m' FROM k)""")
def lint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of findings, line by line."""
    issues = _items(spark, sf_dir).select(F.explode(F.array(F.lit("th"), F.lit("lo"))).alias("locale"), F.col("title").alias("key"), F.lit("r").alias("rule"), F.when(F.col("item") % 5 == 0, "error").otherwise("warning").alias("severity"), F.lit("m").alias("message"))
    return lint.lint_report(issues).select("locale", "line")


_PARTS = """
a AS (SELECT locale, t, least(greatest(done, 0), t) AS d, r, f, g, e, w FROM c),
b AS (SELECT *, least(greatest(g, 0), d) AS dr, t * r AS s, least(greatest(f, 0), t * r) AS fs FROM a),
x AS (SELECT locale, CASE WHEN t > 0 THEN d / t ELSE 0 END * 35 AS p1, CASE WHEN s > 0 THEN fs / s ELSE 0 END * 25 AS p2,
  CASE WHEN d > 0 THEN greatest(0, 1 - (e + 0.4 * w) / d) ELSE 0 END * 25 AS p3, CASE WHEN d > 0 THEN (d - dr) / d ELSE 0 END * 15 AS p4 FROM b),
y AS (SELECT *, CAST(floor(round(p1, 2) + round(p2, 2) + round(p3, 2) + round(p4, 2) + 0.5) AS INTEGER) AS score FROM x),
z AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade,
  [35 - round(p1, 2), 25 - round(p2, 2), 25 - round(p3, 2), 15 - round(p4, 2)] AS lost FROM y)"""
_DRAG = "CASE WHEN list_max(lost) > 0 THEN ['translated', 'registerDepth', 'lintClean', 'reviewed'][list_position(lost, list_max(lost))] END"


@query(f"""
WITH c AS (SELECT 'th' AS locale, count(*) AS t, count(*) FILTER (WHERE item % 2 = 0) AS done, 3 AS r, count(*) FILTER (WHERE item % 2 = 0) AS f, 0 AS g, 0 AS e, 0 AS w FROM {_ITEMS}
  UNION ALL SELECT 'lo', count(*), count(*) FILTER (WHERE item % 3 = 0), 3, count(*) FILTER (WHERE item % 3 = 0 AND item % 6 <> 0), count(*) FILTER (WHERE item % 4 = 0), 0, 0 FROM {_ITEMS}), {_PARTS}
SELECT locale, score, grade, {_DRAG} AS top_drag FROM z""")
def stored_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How ready two locales of a stored project are, and what costs them most."""
    return readiness.score_readiness(readiness.store_counts(_stored(spark, sf_dir), ["en", "th", "lo"])).select("locale", "score", "grade", "top_drag")


@query(f"""
WITH c AS (SELECT 'x' || c_nationkey AS locale, count(*) AS t, count(*) FILTER (WHERE c_acctbal > 0) AS done, 1 AS r, count(*) FILTER (WHERE c_acctbal > 1000) AS f,
  count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS g, 0 AS e, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS w FROM customer GROUP BY c_nationkey), {_PARTS}
SELECT score, grade, locales, blocking FROM (SELECT CAST(floor(avg(score) + 0.5) AS INTEGER) AS score, string_agg(locale, ' ' ORDER BY score, locale) AS locales, coalesce(string_agg(CASE WHEN score < 75 THEN locale END, ' ' ORDER BY score, locale), '') AS blocking FROM z) q,
  LATERAL (SELECT CASE WHEN q.score >= 90 THEN 'A' WHEN q.score >= 75 THEN 'B' WHEN q.score >= 60 THEN 'C' WHEN q.score >= 40 THEN 'D' ELSE 'F' END AS grade)""")
def release_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project of as many locales as nations have customers: its score, locales from the worst, and those that block."""
    count = lambda c, name: F.count_if(c).alias(name)
    counts = _table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("x"), F.col("c_nationkey").cast("string")).alias("locale")).agg(
        F.count("*").alias("total_keys"), count(F.col("c_acctbal") > 0, "translated_keys"), count(F.col("c_acctbal") > 1000, "filled_register_slots"), count(F.col("c_mktsegment") == "BUILDING", "draft_keys"), F.lit(0).alias("errors"), count(F.col("c_mktsegment") == "MACHINERY", "warnings"))
    whole = readiness.project_readiness(readiness.score_readiness(counts))
    return whole.select("score", "grade", F.array_join("locales", " ").alias("locales"), F.array_join("blocking", " ").alias("blocking"))


# ------------------------------------------------------------ numbers and locales

_TEN = "translate({x}, '0123456789', '๐๑๒๓๔๕๖๗๘๙')"


@query(f"""
SELECT o_orderkey, round(o_totalprice, 2) AS from_vi, round(o_totalprice, 2) AS from_th, {_TEN.format(x="format('{:,.2f}', round(o_totalprice, 2))")} AS thai, true AS native FROM orders""")
def parsed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices read back from what Vietnamese and Thai people write."""
    price = F.round("o_totalprice", 2)
    plain = F.format_number(price, 2)
    vietnamese, thai = F.translate(plain, ",.", ".,"), digits.to_native_digits(plain, "th")
    rows = _table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", digits.parse_number(vietnamese, F.lit("."), F.lit(",")).alias("from_vi"), digits.parse_number(thai, F.lit(","), F.lit(".")).alias("from_th"), thai.alias("thai"), digits.has_native_digits(thai).alias("native"))


_PLAIN_SQL = "regexp_replace(format('{:,.3f}', abs(round(s_acctbal, 3))), '\\.?0+$', '')"
_SIGN_SQL = "CASE WHEN round(s_acctbal, 3) < 0 THEN '-' ELSE '' END"


@query(f"""
SELECT s_suppkey, {_SIGN_SQL} || {_PLAIN_SQL} AS en, {_SIGN_SQL} || translate({_PLAIN_SQL}, ',.', '.,') AS vi, {_SIGN_SQL} || translate({_PLAIN_SQL}, ',.', '.,') AS id, {_SIGN_SQL} || {_TEN.format(x=_PLAIN_SQL)} AS th,
  CASE WHEN round(s_acctbal) < 0 THEN '-' ELSE '' END || format('{{:,.0f}}', abs(round(s_acctbal))) || '%' AS share FROM supplier""")
def plain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as four locales write numbers, and as a percentage."""
    v = F.col("s_acctbal")
    own = [numbers.format_number(spark, v, c, native_digits=c == "th").alias(c) for c in ("en", "vi", "id", "th")]
    return _table(spark, sf_dir, "supplier").select("s_suppkey", *own, numbers.format_percent(spark, v / 100, "en").alias("share"))


@query("""
SELECT s_suppkey, code, known, lang, dir, first_day, unspaced, script, decimals FROM supplier JOIN (VALUES
  (0, 'th', true, 'th', 'ltr', 0, true, 'Thai', 2), (1, 'LO_la', true, 'lo', 'ltr', 0, true, 'Laoo', 0), (2, 'ms-Arab-BN', true, 'ms-Arab-BN', 'rtl', 0, false, 'Latn', 2), (3, 'vi-VN', true, 'vi', 'ltr', 1, false, 'Latn', 0), (4, 'km', true, 'km', 'ltr', 0, true, 'Khmr', 0))
  t(nth, code, known, lang, dir, first_day, unspaced, script, decimals) ON s_suppkey % 5 = nth""")
def web_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages need to know of a locale and its country."""
    tags = [("th", "TH", "THB"), ("LO_la", "LA", "LAK"), ("ms-Arab-BN", "BN", "BND"), ("vi-VN", "VN", "VND"), ("km", "KH", "KHR")]
    rows = _dealt(spark, sf_dir, "supplier", "s_suppkey", tags, "code string, country string, currency string")
    c, html = F.col("code"), html_attributes(F.col("code"))
    return rows.select("s_suppkey", "code", is_supported(c).alias("known"), html["lang"].alias("lang"), html["dir"].alias("dir"), first_day_of_week(F.col("country")).alias("first_day"), needs_segmentation(get_locale(c)).alias("unspaced"), cluster_script(c).alias("script"), numbers.currency_decimals(F.col("currency")).alias("decimals"))


@query("""
SELECT p_partkey, CASE WHEN p_size = 1 THEN '1 widget' ELSE p_size || ' widgets' END AS en, p_size || ' widgets' AS vi, CASE WHEN p_size = 1 THEN 'one' ELSE 'other' END AS category_en, 'other' AS category_th,
  CASE WHEN p_size IN (1, 2, 3) OR p_size % 10 NOT IN (4, 6, 9) THEN 'one' ELSE 'other' END AS category_fil FROM part""")
def chosen_plurals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of a noun for the size of each part, in locales with and without a plural."""
    n = F.col("p_size")
    forms = F.create_map(F.lit("one"), F.lit("{n} widget"), F.lit("other"), F.lit("{n} widgets"))
    own = [grammar.select_plural(n, F.lit(c), forms).alias(c) for c in ("en", "vi")]
    return _table(spark, sf_dir, "part").select("p_partkey", *own, *(grammar.plural_category(n, F.lit(c)).alias(f"category_{c}") for c in ("en", "th", "fil")))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Nguyễn ' || c_mktsegment || ' ' || c_name WHEN 1 THEN c_name ELSE c_name || ' ' || c_mktsegment END AS formatted,
  CASE c_custkey % 3 WHEN 1 THEN c_name ELSE c_name END AS short, c_custkey % 3 = 1 AS mononym, CAST(0 AS INTEGER) AS lacks FROM customer""")
def customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as Vietnam, Myanmar and Thailand write them."""
    third = F.col("c_custkey") % 3
    none = F.lit(None).cast("string")
    name = F.struct(
        F.when(third == 1, F.col("c_name")).alias("full"), F.when(third != 1, F.col("c_name")).alias("given"), F.when(third == 0, F.col("c_mktsegment")).alias("middle"),
        F.when(third == 0, F.lit("Nguyễn")).when(third == 2, F.col("c_mktsegment")).alias("family"), none.alias("patronymic"), none.alias("nickname"),
    )
    country = _pick(F.col("c_custkey"), ("VN", "MM", "TH"))
    return _table(spark, sf_dir, "customer").select("c_custkey", grammar.format_name(name, country).alias("formatted"), grammar.short_name(name, country).alias("short"), grammar.allows_mononym(country).alias("mononym"), F.size(grammar.validate_name(name, country)).alias("lacks"))


@query("""
SELECT c_custkey, country, coalesce(CASE country
    WHEN 'VN' THEN array_to_string([CASE WHEN c_custkey % 7 = 0 THEN 'Family name is required' END, CASE WHEN c_custkey % 5 = 0 THEN 'Given name is required' END], '; ')
    WHEN 'SG' THEN array_to_string([CASE WHEN c_custkey % 5 = 0 THEN 'Given name is required' END, CASE WHEN c_custkey % 7 = 0 THEN 'Family name is required' END], '; ')
    WHEN 'MM' THEN 'Name is required' ELSE CASE WHEN c_custkey % 5 = 0 THEN 'Given name is required' END END, '') AS faults,
  CASE country WHEN 'MM' THEN 'full!' WHEN 'VN' THEN 'family! middle given!' WHEN 'SG' THEN 'given! middle family!' ELSE 'given! middle family' END AS fields
FROM (SELECT c_custkey, ['VN', 'SG', 'MM', 'ID'][c_custkey % 4 + 1] AS country FROM customer)""")
def checked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing of customers' names where each country wants it, and the fields that it asks for."""
    n, none = F.col("c_custkey"), F.lit(None).cast("string")
    given, family = F.when(n % 5 != 0, F.col("c_name")).otherwise(" "), F.when(n % 7 != 0, F.col("c_mktsegment"))
    name = F.struct(none.alias("full"), given.alias("given"), none.alias("middle"), family.alias("family"), none.alias("patronymic"), none.alias("nickname"))
    country = _pick(n, ("VN", "SG", "MM", "ID"))
    fields = F.transform(grammar.name_fields(country), lambda f: F.concat(f["key"], F.when(f["required"], "!").otherwise("")))
    return _table(spark, sf_dir, "customer").select("c_custkey", country.alias("country"), F.array_join(grammar.validate_name(name, country), "; ").alias("faults"), F.array_join(fields, " ").alias("fields"))


# ------------------------------------------------------------ text

_VOWELS = ("a", "ă", "â", "e", "ê", "i", "o", "ô", "ơ", "u", "ư", "y")
_BARE = ("a", "a", "a", "e", "e", "i", "o", "o", "o", "u", "u", "y")
_KEYED = ("a", "aw", "aa", "e", "ee", "i", "o", "oo", "ow", "u", "uw", "y")
_MARKS = ("", "́", "̀", "̉", "̃", "̣")
_TONES = ("ngang", "sắc", "huyền", "hỏi", "ngã", "nặng")
_TONE_KEYS = ("", "s", "f", "r", "x", "j")


@query(f"""
SELECT c_custkey, nfc_normalize(s) AS composed, {_sql_list(_TONES)}[c_custkey % 6 + 1] AS tone, 'b' || {_sql_list(_BARE)}[c_custkey % 12 + 1] AS search_key,
  {_sql_list(_VOWELS)}[c_custkey % 12 + 1] <> {_sql_list(_BARE)}[c_custkey % 12 + 1] OR c_custkey % 6 <> 0 AS marked, nfc_normalize(s) AS typed
FROM (SELECT c_custkey, 'b' || {_sql_list(_VOWELS)}[c_custkey % 12 + 1] || {_sql_list(_MARKS)}[c_custkey % 6 + 1] AS s FROM customer)""")
def toned_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vietnamese syllables of every vowel and tone: composed, told by tone, folded, and typed in Telex."""
    k = F.col("c_custkey")
    loose = F.concat(F.lit("b"), _pick(k, _VOWELS), _pick(k, _MARKS))
    keys = F.concat(F.lit("b"), _pick(k, _KEYED), _pick(k, _TONE_KEYS))
    rows = spread(_table(spark, sf_dir, "customer").select("c_custkey", scripts.normalize_vietnamese(loose).alias("composed"), scripts.from_telex(keys).alias("typed")))
    c = F.col("composed")
    return rows.select("c_custkey", "composed", scripts.tone_of(c).alias("tone"), scripts.to_search_key(c, F.lit("vi")).alias("search_key"), scripts.has_vietnamese_diacritics(c).alias("marked"), "typed")


_UNITS = {"th": ("กา", "เก", "กั", "น"), "lo": ("ກາ", "ເກ", "ກັ", "ນ"), "km": ("កា", "ក្ក", "កំ", "ន"), "my": ("ကာ", "က္က", "ကံ", "န"), "zh-Hans-SG": ("我", "是", "中", "国")}
_UNIT_SQL = " ".join(f"WHEN '{c}' THEN {_sql_list(u)}" for c, u in _UNITS.items())
_BUILT = f"""
d AS (SELECT p_partkey, locale, list_transform(string_split(lpad(CAST(p_partkey % 4096 AS VARCHAR), 6, '0'), ''), lambda c: (CASE locale {_UNIT_SQL} END)[CAST(c AS INTEGER) % 4 + 1]) AS units
  FROM part CROSS JOIN (SELECT unnest({_sql_list(_UNITS)}) AS locale))"""


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of six clusters in every script without spaces, by the digits of a part's key."""
    rows = spread(_table(spark, sf_dir, "part").select("p_partkey")).withColumn("locale", F.explode(F.array(*map(F.lit, _UNITS))))
    figures = F.transform(F.split(F.lpad((F.col("p_partkey") % 4096).cast("string"), 6, "0"), ""), lambda c: c.cast("int") % 4 + 1)
    out = F.lit(None).cast("array<string>")
    for code, units in _UNITS.items():
        own = F.array(*map(F.lit, units))
        out = F.when(F.col("locale") == code, F.transform(figures, partial(F.element_at, own))).otherwise(out)
    return rows.withColumn("units", out).withColumn("text", F.array_join("units", ""))


@query(f"WITH {_BUILT} SELECT p_partkey, locale, array_to_string(units, '|') AS words, CAST(6 AS INTEGER) AS clusters, array_to_string(units, chr(8203)) AS broken, array_to_string(units, '') AS stripped FROM d")
def unspaced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by the rules, clusters and line breaks of texts without spaces."""
    t, c = F.col("text"), F.col("locale")
    broken = segment.insert_line_break_opportunities(t, c)
    return _built(spark, sf_dir).select("p_partkey", "locale", F.array_join(segment.words(t, c), "|").alias("words"), segment.grapheme_length(t, c).alias("clusters"), broken.alias("broken"), text.strip_line_break_opportunities(broken).alias("stripped"))


@query(f"""
WITH {_BUILT}, u AS (SELECT p_partkey, units, unnest(generate_series(1, 5)) AS i FROM d WHERE locale = 'th'),
r AS (SELECT p_partkey, CASE units[i] WHEN 'กา' THEN 'orphaned-trailing-vowel' WHEN 'เก' THEN 'orphaned-leading-vowel' WHEN 'กั' THEN 'break-before-combining-mark' END AS reason FROM
  (SELECT p_partkey, units, unnest(generate_series(1, 6)) AS i FROM d WHERE locale = 'th')),
n AS (SELECT p_partkey, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL)
SELECT p_partkey AS text_id, CAST(sum(n) AS BIGINT) AS illegal, arg_min(reason, (-n, reason)) AS worst FROM n GROUP BY p_partkey""")
def illegal_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places of Thai texts no one may cut at, and the commonest reason."""
    rows = _built(spark, sf_dir).where("locale = 'th'").select(F.col("p_partkey").alias("text_id"), "text")
    return evaluate.illegal_summary(rows)


@query("SELECT conv_id, turn, length_grapheme(text) AS clusters, length_grapheme(text || '🇹🇭👨‍👩‍👧e' || chr(769) || 'ก็') AS more FROM conversations")
def grapheme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of conversation turns, bare and with flags, families and marks added."""
    t = F.col("text")
    n = lambda x: segment.grapheme_length(x, F.lit("en")).cast("long")
    turns = spread(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return turns.select("conv_id", "turn", n(t).alias("clusters"), n(F.concat(t, F.lit("🇹🇭👨‍👩‍👧éก็"))).alias("more"))


@query("SELECT p_partkey, contains(lower(p_name), 'wid') AS found, contains(lower(p_type), 'eco') AS economy FROM part")
def part_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a search finds, whatever marks and case it is typed in."""
    hit = lambda typed, c: scripts.search_matches(F.lit(typed), F.col(c), F.lit("vi"))
    return _table(spark, sf_dir, "part").select("p_partkey", hit("WỊD", "p_name").alias("found"), hit(" êco ", "p_type").alias("economy"))


_SUBSCRIPTS = ("ၠ", "ၡ", "ၢ", "ၣ", "ၥ")
_LETTERS = ("က", "ခ", "ဂ", "ဃ", "စ")


@query(f"""
SELECT s_suppkey, b || chr(4154) || l AS stacked, b || chr(4145) AS turned FROM
  (SELECT s_suppkey, {_sql_list(_LETTERS)}[s_suppkey % 5 + 1] AS b, {_sql_list(_LETTERS)}[(s_suppkey // 5) % 5 + 1] AS l FROM supplier)""")
def converted_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zawgyi stacks and leading vowels in Unicode."""
    k = F.col("s_suppkey")
    base = _pick(k, _LETTERS)
    stacked = F.concat(base, _pick(F.floor(k / 5), _SUBSCRIPTS))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", scripts.zawgyi_to_unicode(stacked).alias("stacked"), scripts.zawgyi_to_unicode(F.concat(F.lit("ေ"), base)).alias("turned"))


# ------------------------------------------------------------ files


@query("""
SELECT n_name AS locale, rpad(n_name, 12, ' ') || repeat('#', CAST(floor(s * 20 / 100 + 0.5) AS INTEGER)) || repeat('.', 20 - CAST(floor(s * 20 / 100 + 0.5) AS INTEGER)) || ' ' || lpad(CAST(s AS VARCHAR), 3, ' ') || ' ' ||
  CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'F' END AS line, s < 75 AS blocking FROM (SELECT n_name, n_nationkey * 4 AS s FROM nation)""")
def readiness_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of scores with their bars."""
    score = (F.col("n_nationkey") * 4).alias("score")
    rows = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("locale"), score, readiness.grade_for(F.col("n_nationkey") * 4).alias("grade"))
    return export.readiness_report(rows)


@query("""
SELECT n_name AS name, 'https://fonts.googleapis.com/css2?family=Noto+Sans+Thai:wght@400;500;700&display=swap' AS link, ':lang(th), [lang="th"] {' AS first_line FROM nation WHERE n_nationkey = 0""")
def page_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts of a page in Thai."""
    one = _table(spark, sf_dir, "nation").where("n_nationkey = 0")
    return one.select(F.col("n_name").alias("name"), F.lit(export.font_link(["th"])).alias("link"), F.lit(export.font_css(["th"]).split("\n")[0]).alias("first_line"))


# ------------------------------------------------------------ more of the registry, lexicons and letters


@query("""
SELECT s_suppkey, code, levels, formal, gendered FROM supplier JOIN (VALUES (0, 'jv', true, 'krama', false), (1, 'su', true, 'lemes', false), (2, 'th', true, 'ราชาศัพท์/สุภาพ', true), (3, 'km', true, 'ភាសាសុភាព', true), (4, 'vi', false, NULL, false), (5, 'fil', false, NULL, false))
  t(nth, code, levels, formal, gendered) ON s_suppkey % 6 = nth""")
def speech_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which locales have levels of speech, what the formal one is called, and whether particles tell a gender."""
    rows = _dealt(spark, sf_dir, "supplier", "s_suppkey", [(c,) for c in ("jv", "su", "th", "km", "vi", "fil")], "code string")
    c = F.col("code")
    return rows.select("s_suppkey", "code", grammar.has_speech_levels(c).alias("levels"), grammar.speech_level(c, F.lit("formal")).alias("formal"), grammar.particle_is_gendered(c).alias("gendered"))


@query("""
SELECT p_partkey, translate(lpad(CAST(p_partkey AS VARCHAR), 7, '0'), '0123456789', 'ابدڤجکلمنس') AS jawi, translate(lpad(CAST(p_partkey AS VARCHAR), 7, '0'), '0123456789', 'abdpjklmns') AS rumi FROM part""")
def jawi_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of parts as Malay letters, in Jawi and back."""
    latin = F.translate(F.lpad(F.col("p_partkey").cast("string"), 7, "0"), "0123456789", "abdpjklmns")
    jawi = scripts.rumi_to_jawi(latin)
    return _table(spark, sf_dir, "part").select("p_partkey", jawi.alias("jawi"), scripts.jawi_to_rumi(jawi).alias("rumi"))


@query(f"WITH {_BUILT} SELECT p_partkey, array_to_string([units[1] || units[2], units[3] || units[4], units[5] || units[6]], '|') AS words, 16 AS known FROM d WHERE locale = 'th'")
def words_of_the_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thai texts divided by words that the user registered, each of two clusters."""
    pairs = [a + b for a in _UNITS["th"] for b in _UNITS["th"]]
    lexicons = segment.register_words({}, "th", pairs)
    rows = _built(spark, sf_dir).where("locale = 'th'")
    return rows.select("p_partkey", F.array_join(segment.words(F.col("text"), F.col("locale"), lexicons), "|").alias("words"), F.lit(segment.lexicon_size(lexicons, "th")).alias("known"))


@query(f"WITH {_BUILT} SELECT p_partkey, array_to_string(units, '') AS text, array_to_string(list_transform(range(1, 6), lambda i: CAST(length(array_to_string(units[1:i], '')) AS VARCHAR)), ' ') AS offsets FROM d WHERE locale = 'zh-Hans-SG'")
def annotated_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of an annotated corpus, whose words are divided by strokes, and where their words end."""
    plain, offsets = bundles.annotated(F.array_join("units", "|"))
    return _built(spark, sf_dir).where("locale = 'zh-Hans-SG'").select("p_partkey", plain.alias("text"), F.array_join(F.transform(offsets, lambda o: o.cast("string")), " ").alias("offsets"))


#: Counts of the literal messages: th has three of four keys with a text for one register each, vi two, lo one that is empty.
ORACLES["bundle_readiness"] = f"""
WITH c(locale, t, done, r, f, g, e, w) AS (VALUES ('th', 4, 3, 3, 3, 0, 1, 2), ('vi', 4, 2, 3, 2, 0, 2, 1), ('lo', 4, 0, 3, 0, 0, 2, 0)), {_PARTS}
SELECT locale, score, grade, {_DRAG} AS top_drag FROM z"""


# ------------------------------------------------------------ SQL for queries of the other module

#: How locales write their own money: decimals, separators, digits, and what stands before and after.
_MONEY = [
    ("en", 2, ",.", "$", ""), ("vi", 0, ".,", "", " ₫"), ("th", 2, ",.", "฿", ""), ("id", 0, ".,", "Rp ", ""), ("jv", 0, ".,", "Rp ", ""), ("jv-Java", 0, ".,", "Rp ", ""), ("su", 0, ".,", "Rp ", ""),
    ("ms", 2, ",.", "RM ", ""), ("ms-Arab", 2, ",.", "RM ", ""), ("ms-BN", 2, ".,", "$ ", ""), ("ms-Arab-BN", 2, ",.", "BND ", ""), ("fil", 2, ",.", "₱", ""), ("ceb", 2, ",.", "₱", ""), ("my", 0, ",.", "", " K"),
    ("shn", 0, ",.", "MMK ", ""), ("km", 0, ",.", "", "៛"), ("lo", 0, ".,", "₭", ""), ("tet", 2, " ,", "", " US$"), ("pt-TL", 2, " ,", "", " US$"), ("en-SG", 2, ",.", "$", ""), ("zh-Hans-SG", 2, ",.", "$", ""),
    ("ta-SG", 2, ",.", "$ ", ""), ("ms-SG", 2, ",.", "$", ""), ("tpi", 2, ",.", "K ", ""), ("en-PG", 2, ",.", "K ", ""), ("fil-x-taglish", 2, ",.", "₱", ""), ("en-SG-x-singlish", 2, ",.", "$", ""), ("id-x-gaul", 0, ".,", "Rp ", ""),
    ("ms-x-manglish", 2, ",.", "RM ", ""),
]
ORACLES["currency_by_locale"] = f"""
WITH m(locale, places, marks, before, after) AS ({_values(_MONEY)}),
v AS (SELECT s_suppkey, m.*, CASE places WHEN 0 THEN round(s_acctbal) ELSE round(s_acctbal, 2) END AS x FROM supplier CROSS JOIN m),
w AS (SELECT *, translate(CASE places WHEN 0 THEN format('{{:,.0f}}', abs(x)) ELSE format('{{:,.2f}}', abs(x)) END, ',.' || CASE locale WHEN 'my' THEN '0123456789' ELSE '' END, marks || CASE locale WHEN 'my' THEN '၀၁၂၃၄၅၆၇၈၉' ELSE '' END) AS body FROM v)
SELECT s_suppkey, locale, CASE WHEN x < 0 AND locale <> 'lo' THEN '-' ELSE '' END || before || CASE WHEN x < 0 AND locale = 'lo' THEN '-' ELSE '' END || body || after AS money FROM w"""

_UNITS_OF_TIME = [
    ("year", 31_536_000_000, "ปี", "ที่แล้ว"), ("month", 2_592_000_000, "เดือน", "ที่ผ่านมา"), ("week", 604_800_000, "สัปดาห์", "ที่ผ่านมา"), ("day", 86_400_000, "วัน", "ที่ผ่านมา"),
    ("hour", 3_600_000, "ชั่วโมง", "ที่ผ่านมา"), ("minute", 60_000, "นาที", "ที่ผ่านมา"), ("second", 1000, "วินาที", "ที่ผ่านมา"),
]
#: Spans that have words of their own.
_NAMED_SPANS = [
    ("year", -1, "last year", "ปีที่แล้ว"), ("year", 1, "next year", "ปีหน้า"), ("month", -1, "last month", "เดือนที่แล้ว"), ("month", 1, "next month", "เดือนหน้า"), ("week", -1, "last week", "สัปดาห์ที่แล้ว"), ("week", 1, "next week", "สัปดาห์หน้า"),
    ("day", -2, None, "เมื่อวานซืน"), ("day", -1, "yesterday", "เมื่อวาน"), ("day", 1, "tomorrow", "พรุ่งนี้"), ("day", 2, None, "มะรืนนี้"), ("second", 0, "now", "ขณะนี้"),
]
ORACLES["order_ages"] = f"""
WITH u(unit, ms, thai, ago) AS ({_values(_UNITS_OF_TIME)}), w(unit, n, en, th) AS ({_values(_NAMED_SPANS)}),
l AS (SELECT o_custkey, CAST(epoch_us(max(o_orderdate)) // 1000 - epoch_us(TIMESTAMP '1998-12-31 00:00:00') // 1000 AS BIGINT) AS span FROM orders GROUP BY o_custkey),
p AS (SELECT o_custkey, span, arg_max(u, u.ms) AS u FROM l LEFT JOIN u ON abs(span) >= u.ms OR (span IS NOT NULL AND u.unit = 'second') GROUP BY ALL),
n AS (SELECT o_custkey, u.unit AS unit, u.thai AS thai, u.ago AS ago, CAST(floor(CAST(span AS DOUBLE) / u.ms + 0.5) AS BIGINT) AS n FROM p),
c AS (SELECT n.*, format('{{:,}}', abs(n.n)) AS size, w.en AS own_en, w.th AS own_th FROM n LEFT JOIN w ON w.unit = n.unit AND w.n = n.n)
SELECT o_custkey,
  coalesce(own_en, CASE WHEN n < 0 THEN '' ELSE 'in ' END || size || ' ' || unit || CASE WHEN abs(n) = 1 THEN '' ELSE 's' END || CASE WHEN n < 0 THEN ' ago' ELSE '' END) AS en,
  coalesce(own_th, CASE WHEN n < 0 THEN '' ELSE 'ในอีก ' END || size || ' ' || thai || CASE WHEN n < 0 THEN ago ELSE '' END) AS th FROM c"""
