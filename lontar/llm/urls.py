"""URL filtering by an index of rules on their rarest token. DataFrame operations only.

A rule is a pattern on host and path, with the literal tokens (runs of a-z and 0-9) that any URL it
fits must have. Each rule is filed under the one of its tokens that the fewest URLs have. A URL's
tokens fetch the rules filed under them, and only those patterns are run. Rules of filter lists, with
wildcards and anchors, have their literals drawn from the pattern: whole tokens, and where a wildcard
touches a run of letters, what three letters of it stand together. Rules without a literal are run on
every URL. Equal URLs are judged once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut, met, prepare


#: Before three letters that stand together in a token.
GRAM = "~"


@dataclass(frozen=True)
class Rule:
    """name: None for a pattern of the method, else the listed rule's text; pattern: on host and path together."""

    action: str
    name: str | None
    pattern: str
    tokens: tuple[str, ...]

    @staticmethod
    def listed(action: str, rule: str) -> Rule:
        """A rule host/path: it fits the host and its subdomains, if the URL's path starts with its own."""
        host, _, path = rule.partition("/")
        whole = re.split(r"[^a-z0-9]+", host + "/" + path.lower())
        tokens = [t for t in (whole if path.endswith("/") or not path else whole[:-1]) if t]
        return Rule(action, rule, r"\A(?:[^/]*\.)?" + _quoted(host) + "/" + _quoted(path), tuple(dict.fromkeys(tokens)))

    @staticmethod
    def filtered(line: str) -> Rule:
        """A line of a filter list, in any case: `*` stands for anything, `^` for a separator or the end, `|` at either end
        anchors there, `||` at the start anchors at a label of the host; `@@` before it allows. `$` is a plain character."""
        action, rest = ("allow", line[2:]) if line.startswith("@@") else ("block", line)
        start = next(a for a in ("||", "|", "") if rest.startswith(a))
        rest = rest.removeprefix(start)
        end = "|" if rest.endswith("|") else ""
        rest = re.sub("[A-Z]+", lambda m: m[0].lower(), rest.removesuffix(end))  # other scripts keep their case
        pattern = {"||": r"\A(?:[^/]*\.)?", "|": r"\A", "": ""}[start]
        pattern += "".join({"*": ".*", "^": r"(?:[^a-zA-Z0-9_.%-]|\z)"}.get(c) or _quoted(c) for c in rest)
        found = [(m[0], (m.start() > 0 or bool(start)) and rest[m.start() - 1 : m.start()] != "*", (m.end() < len(rest) or bool(end)) and rest[m.end() : m.end() + 1] != "*") for m in re.finditer("[a-z0-9]+", rest)]
        tokens = [run for run, left, right in found if left and right]
        grams = [GRAM + run[i : i + 3] for run, _, _ in found for i in range(len(run) - 2)]
        return Rule(action, None, "(?is)" + pattern + (r"\z" if end else ""), tuple(dict.fromkeys(tokens or grams)))

    @staticmethod
    def words(action: str, *words: str) -> Rule:
        """The words, one after the other, between other characters than letters and digits."""
        return Rule(action, None, r"(?i)(?:\A|[^a-zA-Z0-9])" + "[^a-zA-Z0-9]+".join(map(_quoted, words)) + r"(?:[^a-zA-Z0-9]|\z)", words)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: The listed rules.
LISTED = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words of hosts and paths that no corpus wants.
UNWANTED = (("spam", "farm"), ("cheap", "pills"), ("casino",), ("poker",), ("viagra",), ("cialis",), ("payday", "loan"), ("payday", "loans"), ("porn",), ("xxx",), ("escort",), ("escorts",), ("warez",), ("malware",), ("phishing",), ("link", "farm"), ("replica", "watches"), ("free", "download", "crack"))
RULES = tuple(Rule.listed(a, r) for a, r in LISTED) + tuple(Rule.words("block", *w) for w in UNWANTED)


def host_of(url: F.Column) -> F.Column:
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(_small_letters(rest), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _small_letters(text: F.Column) -> F.Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_tokens(place: F.Column, grams: bool = False) -> F.Column:
    """Runs of letters and digits, and the grams in them."""
    whole = F.filter(F.split(_small_letters(place), "[^a-z0-9]+"), lambda t: t != "")
    if grams:
        inner = F.transform(F.filter(whole, lambda t: F.length(t) > 2), lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.concat(F.lit(GRAM), F.substring(t, i, F.lit(3)))))
        whole = F.concat(whole, F.flatten(inner))
    return F.array_distinct(whole)


SCHEMA = "rule_id int, action string, name string, pattern string, tokens array<string>"
#: Rules of which more bytes than that are joined by a shuffle instead of a broadcast.
SMALL = 8 << 20
#: Rules without a literal that are run in one expression.
BLOCK = 200


def rule_frame(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules as a table, as judge() also takes it from storage."""
    return spark.createDataFrame([(i, r.action, r.name, r.pattern, list(r.tokens)) for i, r in enumerate(rules)], SCHEMA)


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES) -> DataFrame:
    """A row for each row of pages (page_id, url, ...): page_id, host, path, rule, verdict.

    rules: Rules, or a table of them (rule_id, action, name, pattern, tokens). The longest listed rule that
    fits decides (equal lengths: the smallest rule_id); else an unlisted pattern that fits gives its action,
    block before allow; else allow. Rules without a literal are read by the driver and run on every URL, in blocks. Without `://`, and for null, host and path are empty and nothing fits.
    Repeated rows and null page_ids stay; an empty table gives no rows. Other columns are not read.
    """
    spark = prepare(pages.sparkSession)
    filed = rules if isinstance(rules, DataFrame) else rule_frame(spark, rules)
    bare = F.when(F.size("tokens") == 0, F.struct("rule_id", "action", "name", "pattern"))
    # Of rules, a stated set, never of pages.
    held, with_grams, loose = filed.agg(F.coalesce(F.sum(F.length("pattern") + 100), F.lit(0)), F.coalesce(F.bool_or(F.exists("tokens", lambda t: t.startswith(GRAM))), F.lit(False)), F.collect_list(bare)).first()
    small = (lambda df: F.broadcast(df)) if held < SMALL else (lambda df: df)

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = rows.where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    urls = cut(urls.select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("place"), "n"))
    tokens = urls.select("url", "place", F.explode(url_tokens(F.col("place"), with_grams)).alias("token"))
    literal = filed.select("rule_id", F.explode("tokens").alias("token"))
    used = tokens.select("token").join(small(literal.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literal.join(used, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = cut(filed.join(rarest, "rule_id").select("token", "rule_id", "action", "name", "pattern"))
    fitting = tokens.join(small(index), "token").where(F.expr("rlike(place, pattern)")).select("url", "rule_id", "action", "name")
    for at in range(0, len(loose), BLOCK):
        rest = F.array(*(F.when(F.col("place").rlike(r["pattern"]), F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["action"]).alias("action"), F.lit(r["name"]).cast("string").alias("name"))) for r in loose[at : at + BLOCK]))
        fitting = fitting.unionByName(urls.select("url", F.inline(F.array_compact(rest))))
    longest = F.max_by(F.struct("name", "action"), F.when(F.col("name").isNotNull(), F.struct(F.length("name"), -F.col("rule_id"))))
    found = fitting.groupBy("url").agg(longest.alias("best"), F.max(F.when(F.col("name").isNull(), F.col("action"))).alias("other"))
    # Rows without a URL need no verdict looked up; frequent URLs are met in salted parts.
    out = met(rows.where("url is not null"), found, "url", how="left", counts=urls.select("url", "n"))
    none = rows.where("url is null").select("*", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("best", "other")))
    out = out.unionByName(none)
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.name").alias("rule"), F.coalesce("best.action", "other", F.lit("allow")).alias("verdict"))


def op7_rare_token(spark, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    listed = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(LISTED, key=lambda x: -len(x[1])))
    action = " ".join(f"WHEN '{r}' THEN '{a}'" for a, r in LISTED)
    bad = " OR ".join(f"regexp_matches(lower(host || path), '(^|[^a-z0-9]){'[^a-z0-9]+'.join(w)}([^a-z0-9]|$)')" for w in UNWANTED)
    return f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (SELECT *, CASE {listed} END AS rule FROM u)
SELECT page_id, host, path, rule, coalesce(CASE rule {action} END, CASE WHEN {bad} THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


ORACLE = _oracle()
