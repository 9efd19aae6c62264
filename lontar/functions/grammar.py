"""Counted phrases, politeness, pronouns, names and plurals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import registry as R
from ..registry import tables as T
from .digits import to_native_digits
from .locale import by_locale, resolve_locale

_ORDERS = {c: v.count_order for c, v in R.LOCALES.items()}


def count_order(locale: Column) -> Column:
    return by_locale(resolve_locale(locale), _ORDERS, "num-noun")


def uses_classifiers(locale: Column) -> Column:
    return count_order(locale) != "num-noun"


def classifier_for(locale: Column, category: Column) -> Column:
    """The classifier of the first tag of the chain that has one. English ends every chain and has none."""
    dense = {f"{c} {k}": v for c in R.LOCALES for k in T.CATEGORIES if (v := R.classifier(c, k))}
    return R.literal_map(dense)[F.concat_ws(" ", resolve_locale(locale), category)]


def format_count(count: Column, noun: Column, locale: Column, category: Column | None = None, classifier: Column | None = None, native_digits: bool = False, number: Column | None = None) -> Column:
    """A counted phrase in the locale's order. number: how the count is written, if not plainly."""
    code, order = resolve_locale(locale), count_order(locale)
    shown = F.when(count == F.floor(count), count.cast("decimal(38,0)").cast("string")).otherwise(count.cast("string")) if number is None else number
    if native_digits:
        shown = to_native_digits(shown, locale)
    word = classifier_for(locale, F.lit("thing") if category is None else category)
    word = word if classifier is None else F.coalesce(classifier, word)
    word = F.when(word != "", word)
    gap = F.when(code == "zh-Hans-SG", "").otherwise(" ")
    return (
        F.when(order == "num-noun", F.concat(shown, F.when(code.isin("fil", "ceb", "fil-x-taglish"), " na ").otherwise(" "), noun))
        .when(word.isNull(), F.when(order == "noun-num-clf", F.concat(noun, F.lit(" "), shown)).otherwise(F.concat(shown, F.lit(" "), noun)))
        .when(order == "noun-num-clf", F.concat(noun, gap, shown, gap, word))
        .otherwise(F.concat(shown, gap, word, gap, noun))
    )


def _own_or_base(held: dict) -> dict:
    """A table by locale code, where mixed locales have their base's."""
    return {c: held.get(v.base_locale or c, held.get(c)) for c, v in R.LOCALES.items()}


def polite_particle(locale: Column, gender: Column | None = None, sentence: Column | None = None) -> Column:
    """The particle for the speaker's gender (neutral unless said) and type of sentence (statement unless said); null without one."""
    held = {f"{c} {g} {s}": pair[i] for c, t in _own_or_base(R.particles()).items() if t for g, pair in t.items() if pair for i, s in enumerate(("statement", "question"))}
    return R.literal_map(held)[F.concat_ws(" ", resolve_locale(locale), F.coalesce(gender, F.lit("neutral")) if gender is not None else F.lit("neutral"), F.coalesce(sentence, F.lit("statement")) if sentence is not None else F.lit("statement"))]


def with_politeness(text: Column, locale: Column, gender: Column | None = None, sentence: Column | None = None) -> Column:
    """The text with the particle before its closing mark."""
    particle = polite_particle(locale, gender, sentence)
    trimmed = F.regexp_replace(text, r"(?U)[\s﻿]+\z", "")
    mark = F.regexp_extract(trimmed, r"([.!?？。])\z", 1)
    return F.when(particle.isNull(), text).otherwise(F.concat(F.regexp_replace(trimmed, r"[.!?？。]\z", ""), F.lit(" "), particle, mark))


def particle_is_gendered(locale: Column) -> Column:
    held = {c: t["male"][0] != t["female"][0] for c, t in _own_or_base(R.particles()).items() if t}
    return by_locale(resolve_locale(locale), held, False)


def pronoun(locale: Column, referent: Column, register: Column | None = None, gender: Column | None = None) -> Column:
    """The pronoun of the locale, else of its base, else English; null for unknown locales."""
    every = R.pronouns()
    held = {f"{c} {r} {who} {g}": pair[i] for c, v in R.LOCALES.items() for r, t in (every.get(c) or every.get(v.base_locale) or every["en"]).items() for who, pair in t.items() for i, g in enumerate(("male", "female"))}
    how = F.lit("neutral") if register is None else F.coalesce(register, F.lit("neutral"))
    sex = F.lit("male") if gender is None else F.when(gender == "female", "female").otherwise("male")
    return R.literal_map(held)[F.concat_ws(" ", resolve_locale(locale), how, referent, sex)]


def pronoun_is_gendered(locale: Column) -> Column:
    every = R.pronouns()
    held = {c: any(a != b for t in table.values() for a, b in t.values()) for c, v in R.LOCALES.items() if (table := every.get(c) or every.get(v.base_locale))}
    return by_locale(resolve_locale(locale), held, False)


def speech_level(locale: Column, register: Column) -> Column:
    held = {f"{c} {r}": v for c, t in R.speech_levels().items() for r, v in t.items()}
    return R.literal_map(held)[F.concat_ws(" ", resolve_locale(locale), register)]


def has_speech_levels(locale: Column) -> Column:
    return F.coalesce(resolve_locale(locale).isin(*R.speech_levels()), F.lit(False))


def _order(country: Column) -> Column:
    return F.coalesce(R.literal_map({c: v.name_order for c, v in R.COUNTRIES.items()})[F.upper(country)], F.lit("given-family"))


def name_fields(country: Column) -> Column:
    """The fields of a person's name in the country: key, label, required."""
    def fields(order: str, loose: bool = False) -> Column:
        return F.array(*(F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.lit(must and not (loose and k == "family")).alias("required")) for k, label, must in T.NAME_FIELDS[order]))

    loose = [c for c, v in R.COUNTRIES.items() if v.mononym_common]
    out = F.when(F.upper(country).isin(*loose), fields("given-family", True)).otherwise(fields("given-family"))
    for order in ("mononym", "patronymic", "family-given"):
        out = F.when(_order(country) == order, fields(order)).otherwise(out)
    return out


def format_name(name: Column, country: Column) -> Column:
    """The parts of a name in the country's order; the full name where that is all there is, or all there can be."""
    part = lambda k: F.nullif(name[k], F.lit(""))
    order = _order(country)
    whole = (part("full").isNotNull()) & ((order == "mononym") | part("given").isNull())
    joined = (
        F.when(order == "family-given", F.concat_ws(" ", part("family"), part("middle"), part("given")))
        .when(order == "patronymic", F.concat_ws(" ", part("given"), part("patronymic"), part("family")))
        .otherwise(F.concat_ws(" ", part("given"), part("middle"), part("family")))
    )
    return F.trim(F.when(whole, name["full"]).otherwise(joined))


def short_name(name: Column, country: Column) -> Column:
    return (
        F.when((F.upper(country) == "TH") & (F.coalesce(name["nickname"], F.lit("")) != ""), name["nickname"])
        .when(_order(country) == "mononym", F.coalesce(name["full"], name["given"], F.lit("")))
        .otherwise(F.coalesce(name["given"], name["full"], F.lit("")))
    )


def allows_mononym(country: Column) -> Column:
    return F.coalesce(F.upper(country).isin(*[c for c, v in R.COUNTRIES.items() if v.mononym_common or v.name_order == "mononym"]), F.lit(False))


def validate_name(name: Column, country: Column) -> Column:
    """What is missing of a name, one sentence each."""
    value = lambda k: F.element_at(F.create_map(*[x for key in ("full", "given", "middle", "family", "patronymic") for x in (F.lit(key), F.trim(F.coalesce(name[key], F.lit(""))))]), k)
    short = F.transform(F.filter(name_fields(country), lambda f: f["required"] & (value(f["key"]) == "")), lambda f: F.concat(f["label"], F.lit(" is required")))
    none = (F.coalesce(name["full"], F.lit("")) == "") & (F.coalesce(name["given"], F.lit("")) == "") & (F.coalesce(name["family"], F.lit("")) == "")
    return F.when((F.size(short) == 0) & none, F.array(F.lit("Name is required"))).otherwise(short)


#: CLDR cardinal rules of the locales that have more than one form.
_ONE_IS_1 = ("en", "en-SG", "en-PG", "en-SG-x-singlish", "tpi")
_ONE_IS_1_OR_DECIMAL = ("ta-SG",)
_FILIPINO = ("fil", "ceb", "fil-x-taglish")
_PORTUGUESE = ("pt-TL", "tet")


def has_grammatical_number(locale: Column) -> Column:
    code = resolve_locale(locale)
    return F.coalesce(code.isin(*_ONE_IS_1, *_ONE_IS_1_OR_DECIMAL, *_FILIPINO, *_PORTUGUESE), F.lit(False))


def plural_categories(locale: Column) -> Column:
    code = resolve_locale(locale)
    return F.when(code.isin(*_PORTUGUESE), F.array(F.lit("one"), F.lit("many"), F.lit("other"))).when(has_grammatical_number(locale), F.array(F.lit("one"), F.lit("other"))).otherwise(F.array(F.lit("other")))


def plural_category(count: Column, locale: Column) -> Column:
    """The CLDR cardinal category of a count as it is written without trailing zeros."""
    code, n = resolve_locale(locale), F.abs(count.cast("double"))
    whole = n == F.floor(n)
    tail = F.pmod(n, F.lit(10))
    fraction_end = F.regexp_extract(n.cast("decimal(38,6)").cast("string"), r"\.([0-9]*[1-9])0*$", 1).substr(-1, 1)
    filipino = F.when(whole, n.isin(1, 2, 3) | ~tail.isin(4, 6, 9)).otherwise(~fraction_end.isin("4", "6", "9"))
    return (
        F.when(code.isin(*_ONE_IS_1, *_ONE_IS_1_OR_DECIMAL) & (n == 1), "one")
        .when(code.isin(*_FILIPINO) & filipino, "one")
        .when(code.isin(*_PORTUGUESE) & (n == 1), "one")
        .when(code.isin(*_PORTUGUESE) & whole & (n != 0) & (n % 1_000_000 == 0), "many")
        .otherwise("other")
    )


def select_plural(count: Column, locale: Column, forms: Column) -> Column:
    """The form (a map by category) for a count, with {n} replaced by it."""
    template = F.coalesce(forms[plural_category(count, locale)], forms["other"], F.lit(""))
    shown = F.when(count == F.floor(count), count.cast("decimal(38,0)").cast("string")).otherwise(count.cast("string"))
    return F.replace(template, F.lit("{n}"), shown)
