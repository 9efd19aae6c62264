"""Functions under SQL names, for sessions that speak SQL.

Column functions become temporary SQL functions of their own expressions, which the optimizer sees through; what needs
arrays of whole batches is registered as a UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import dates, digits, grammar, legality, numbers, scripts, segment, text
from . import locale as L
from . import spans as S
from .segment import Lexicons

_T, _C = "t string", "locale string"
#: Column functions by name, with their arguments.
COLUMNS = {
    "resolve_locale": (L.resolve_locale, "tag string"), "is_supported": (L.is_supported, "tag string"), "fallback_chain": (L.fallback_chain, "tag string"),
    "cluster_script": (L.cluster_script, "tag string"), "needs_segmentation": (L.needs_segmentation, "tag string"), "first_day_of_week": (L.first_day_of_week, "country string"),
    "to_latin_digits": (digits.to_latin_digits, _T), "has_native_digits": (digits.has_native_digits, _T), "to_native_digits": (digits.to_native_digits, f"{_T}, {_C}"), "parse_number": (digits.parse_number, f"{_T}, group string, decimal string"),
    "sentences": (text.sentences, _T), "spaced_words": (text.spaced_words, _T), "strip_line_breaks": (text.strip_line_break_opportunities, _T),
    "fold_letters": (scripts.fold_letters, _T), "slugify_vietnamese": (scripts.slugify_vietnamese, _T), "tone_of": (scripts.tone_of, _T), "has_vietnamese_diacritics": (scripts.has_vietnamese_diacritics, _T),
    "rumi_to_jawi": (scripts.rumi_to_jawi, _T), "jawi_to_rumi": (scripts.jawi_to_rumi, _T), "is_jawi": (scripts.is_jawi, _T), "detect_myanmar_encoding": (scripts.detect_myanmar_encoding, _T), "is_zawgyi": (scripts.is_zawgyi, _T),
    "illegal_breaks": (lambda t: legality.illegal_count(t), _T), "illegal_cuts": (lambda t: legality.illegal_count(t, None, "cut"), _T),
    "count_order": (grammar.count_order, _C), "uses_classifiers": (grammar.uses_classifiers, _C), "classifier_for": (grammar.classifier_for, f"{_C}, category string"), "format_count": (lambda n, noun, c, k: grammar.format_count(n, noun, c, k), f"n double, noun string, {_C}, category string"),
    "polite_particle": (grammar.polite_particle, f"{_C}, gender string"), "with_politeness": (grammar.with_politeness, f"{_T}, {_C}, gender string"), "particle_is_gendered": (grammar.particle_is_gendered, _C), "pronoun": (grammar.pronoun, f"{_C}, referent string, register string, gender string"),
    "pronoun_is_gendered": (grammar.pronoun_is_gendered, _C), "speech_level": (grammar.speech_level, f"{_C}, register string"), "has_speech_levels": (grammar.has_speech_levels, _C), "allows_mononym": (grammar.allows_mononym, "country string"), "name_fields": (grammar.name_fields, "country string"),
    "has_grammatical_number": (grammar.has_grammatical_number, _C), "plural_categories": (grammar.plural_categories, _C), "plural_category": (grammar.plural_category, f"n double, {_C}"), "select_plural": (grammar.select_plural, f"n double, {_C}, forms map<string,string>"),
    "currency_decimals": (numbers.currency_decimals, "currency string"), "to_buddhist_year": (dates.to_buddhist_year, "year int"), "from_buddhist_year": (dates.from_buddhist_year, "year int"),
}


def _defined(spark: SparkSession, name: str, made: Column, arguments: str) -> None:
    """A temporary SQL function of a column's expression."""
    rows = spark.createDataFrame([], arguments)
    body = rows.select(made.alias("made"))._jdf.queryExecution().analyzed().expressions().head().child().sql()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURN {body}")


def register(spark: SparkSession, lexicons: Lexicons | None = None, prefix: str = "lontar_", locales: tuple[str, ...] = ()) -> list[str]:
    """Register COLUMNS and words, spans, line_breaks, truncate_text, graphemes and nfc; gives the names.

    For each of locales, also number_, money_, percent_, date_ and time_ of that locale, such as money_vi(amount).
    """
    of = lambda kind, shape: segment._udf(kind, shape, lexicons, "lexical")

    @F.pandas_udf("string")
    def nfc(t: pd.Series) -> pd.Series:
        return t.str.normalize("NFC")

    every = {
        "words": of("array<string>", lambda t, starts, word, _: S.words(t, starts, word)),
        "spans": of("array<struct<start:int,end:int,text:string,word_like:boolean>>", lambda t, starts, word, _: S.listed(t, starts, word)),
        "line_breaks": of("string", lambda t, starts, word, script: S.broken(t, starts, word & (script != "Latn"))),
        "truncate_text": of("string", lambda t, starts, _, script, n: S.truncated(t, starts, script, n.to_pylist(), "…")),
        "graphemes": segment._by_clusters("array<string>", list),
        "nfc": nfc,
    }
    for name, function in every.items():
        spark.udf.register(prefix + name, function)
    names = list(every)
    for name, (function, arguments) in COLUMNS.items():
        columns = [F.col(part.split(" ")[0]) for part in arguments.split(", ")]
        _defined(spark, prefix + name, function(*columns), arguments)
        names.append(name)
    for code in locales:
        found = L.R.resolve(code).code
        tail = found.lower().replace("-", "_")
        for name, made, arguments in (
            ("number", numbers.format_number(spark, F.col("n"), found), "n double"),
            ("money", numbers.format_currency(spark, F.col("n"), found), "n double"),
            ("percent", numbers.format_percent(spark, F.col("n"), found), "n double"),
            ("date", dates.format_date(spark, F.col("at"), found), "at timestamp_ntz"),
            ("time", dates.format_time(spark, F.col("at"), found), "at timestamp_ntz"),
        ):
            _defined(spark, f"{prefix}{name}_{tail}", made, arguments)
            names.append(f"{name}_{tail}")
    return [prefix + name for name in names]
