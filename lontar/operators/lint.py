"""Regional rules over the long table of messages: one pass over strings, and one join with the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.grammar import count_order, has_grammatical_number
from ..functions.locale import by_locale, resolve_locale
from ..functions.scripts import SPACE, detect_myanmar_encoding, normalize_vietnamese
from .messages import PLACEHOLDER

_BLANK = rf"\A{SPACE}*\z"


def _name(code: Column) -> Column:
    return by_locale(code, {c: v.name for c, v in R.LOCALES.items()})


def string_findings(value: Column, code: Column, composed: Column | None = None) -> Column:
    """Findings (rule, severity, message) on one string of a known locale. composed: the string in NFC, for Vietnamese."""
    found = detect_myanmar_encoding(value)
    currency = by_locale(code, {c: v.default_currency for c, v in R.LOCALES.items()})
    # Locales are asked before texts, and for what a pattern must hold before it: the JVM looks for that in the bytes, without making a string.
    say = lambda rule, severity, message: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))
    rules = [
        (code.isin(*R.locales_for_script("Mymr")) & (found["encoding"] == "zawgyi"), say("zawgyi-encoding", "error", F.concat(F.lit("written in Zawgyi: "), found["signals"][0], F.lit("; normalize_myanmar() converts it")))),
        ((code == "vi") & (value != composed) if composed is not None else F.lit(False), say("vietnamese-nfc", "error", F.lit("letters and marks are not composed; normalize_vietnamese() composes them"))),
        ((code == "th") & F.contains(value, F.lit("ค")) & value.rlike(rf"(ครับ|ค่ะ|คะ){SPACE}*\z"), say("gendered-particle", "warning", F.lit("ends in a particle that tells the speaker's gender; with_politeness() adds the right one"))),
        (~has_grammatical_number(code) & F.contains(value, F.lit("(")) & value.rlike(r"\([eE]?[sS]\)"), say("hardcoded-plural", "warning", F.concat(F.lit("optional plural ending, but nouns have no plural in "), _name(code)))),
        ((count_order(code) != "num-noun") & F.contains(value, F.lit("{count}")) & value.rlike(r"\{count\}\s*\S"), say("missing-classifier", "warning", F.concat(F.lit("count without a classifier, which phrases need in "), _name(code), F.lit("; see format_count()")))),
        (code.isin(*R.unspaced_locales()) & ~value.rlike(SPACE.replace("]", r"\x{200B}]")) & (F.length(value) + F.regexp_count(value, F.lit(r"[\x{10000}-\x{10FFFF}]")) > 40), say("no-break-opportunity", "warning", F.lit("more than 40 characters that no line can break in; see insert_line_break_opportunities()"))),
        ((currency != "USD") & (F.contains(value, F.lit("$")) | F.contains(value, F.lit("€")) | F.contains(value, F.lit("£"))), say("hardcoded-currency", "warning", F.concat(F.lit("foreign currency sign where "), currency, F.lit(" is used; see format_currency()")))),
    ]
    empty = F.array(say("empty-value", "error", F.lit("no text")))
    return F.when(value.rlike(_BLANK), empty).otherwise(F.array_compact(F.array(*(F.when(c, s) for c, s in rules))))


def placeholders(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(value, F.lit(PLACEHOLDER), F.lit(1)))


def placeholder_findings(value: Column, reference: Column) -> Column:
    """Placeholders that the reference has and the string has not, and the other way round; none without a reference."""
    finding = lambda rule, before, after: lambda n: F.struct(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), F.concat(F.lit(before), n, F.lit(after)).alias("message"))
    lost = F.transform(F.array_except(placeholders(reference), placeholders(value)), finding("missing-placeholder", "the reference has {", "}, this text has not"))
    new = F.transform(F.array_except(placeholders(value), placeholders(reference)), finding("unknown-placeholder", "the reference has no {", "}"))
    return F.coalesce(F.concat(lost, new), F.array().cast("array<struct<rule:string,severity:string,message:string>>"))


def lint(messages: DataFrame, reference: str | None = "en", exact_nfc: bool = True) -> DataFrame:
    """(locale, key, rule, severity, message) for every locale but the reference; unknown locales have none.

    messages is the long table. Each string is judged for itself, so variants of a message can repeat a
    finding. Vietnamese strings that hold combining marks or none at all alike need NFC, which Spark
    lacks: with exact_nfc only Vietnamese rows pass through Python.
    """
    named = messages.withColumn("code", resolve_locale(F.col("locale"))).where("code is not null")
    rows = named.where(F.col("locale") != reference) if reference else named
    if exact_nfc:
        vietnamese = F.col("code") == "vi"
        rows = rows.where(~vietnamese).withColumn("composed", F.col("value")).unionByName(rows.where(vietnamese).withColumn("composed", normalize_vietnamese(F.col("value"))))
    else:
        rows = rows.withColumn("composed", F.when(F.col("value").rlike("[̀-ͯ]"), F.lit("")).otherwise(F.col("value")))
    first = messages.where(F.col("locale") == reference).groupBy("key").agg(F.min_by("value", "ord").alias("source"))
    rows = rows.join(first, "key", "left") if reference else rows.withColumn("source", F.lit(None).cast("string"))
    own = F.concat(string_findings(F.col("value"), F.col("code"), F.col("composed")), placeholder_findings(F.col("value"), F.col("source")))
    out = rows.select("locale", "key", F.explode(own).alias("f")).select("locale", "key", "f.*")
    if not reference:
        return out
    locales = named.where(F.col("locale") != reference).select("locale", "code").distinct()
    heads = rows.groupBy("locale", "key").agg(F.min_by("value", "ord").alias("value"))
    pairs = first.crossJoin(F.broadcast(locales)).join(heads, ["locale", "key"], "left")  # as many locales as the registry has
    same = (F.col("code") != "en") & (F.col("value") == F.col("source")) & (F.length("value") > 3)
    finding = F.when(F.col("value").isNull(), F.struct(F.lit("missing-key").alias("rule"), F.lit("error").alias("severity"), F.lit("not in this locale").alias("message"))).when(same, F.struct(F.lit("untranslated").alias("rule"), F.lit("warning").alias("severity"), F.lit("the same as in the reference").alias("message")))
    return out.unionByName(pairs.withColumn("f", finding).where("f is not null").select("locale", "key", "f.*"))


def issue_counts(issues: DataFrame, *by: str) -> DataFrame:
    """Errors and warnings for each locale, or for other columns of the issues."""
    return issues.groupBy(*(by or ("locale",))).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def lint_report(issues: DataFrame) -> DataFrame:
    """(locale, line_no, line): a heading with the counts of each locale, then a line for each finding, errors first."""
    heads = issue_counts(issues).select("locale", F.lit(0).alias("line_no"), F.format_string("%s: %d errors, %d warnings", "locale", "errors", "warnings").alias("line"))
    order = Window.partitionBy("locale").orderBy(F.col("severity") != "error", "key", "rule", "message")
    lines = issues.select("locale", F.row_number().over(order).alias("line_no"), F.format_string("  [%s] %s %s: %s", "severity", "key", "rule", "message").alias("line"))
    return heads.unionByName(lines)
