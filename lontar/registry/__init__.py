"""Locales and countries as records and as dimension DataFrames of fixed, small size."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as T


def _rows(text: str, mark: str = "|") -> list[list[str]]:
    return [[cell.strip() for cell in line.split(mark)] for line in text.strip().split("\n")]


@dataclass(frozen=True)
class Locale:
    code: str
    name: str
    native_name: str
    script: str
    direction: str
    intl_locale: str
    default_currency: str
    calendar: str
    word_spaced: bool
    count_order: str
    code_mixed: bool
    base_locale: str | None
    native_digits: str | None
    countries: tuple[str, ...]
    registers: tuple[str, ...]
    fallback: tuple[str, ...]
    font_family: str
    font_web: str
    font_weights: tuple[int, ...]
    line_height: float


@dataclass(frozen=True)
class Country:
    code: str
    name: str
    native_name: str
    currency: str
    currency_symbol: str
    currency_decimals: int
    calling_code: str
    time_zones: tuple[str, ...]
    default_locale: str
    locales: tuple[str, ...]
    default_calendar: str
    first_day_of_week: int
    name_order: str
    mononym_common: bool


def _locales() -> dict[str, Locale]:
    fonts = {r[0]: r for r in _rows(T.FONTS)}
    out = {}
    for code, name, own, script, intl, currency, order, chain, countries in _rows(T.LOCALES):
        font = fonts.get(code) or fonts.get(script) or fonts["Latn"]
        out[code] = Locale(
            code, name, own, script, "rtl" if script == "Arab" else "ltr", intl, currency, "buddhist" if code in T.BUDDHIST else "gregory",
            code not in T.UNSPACED, order, code in T.CODE_MIXED, T.CODE_MIXED.get(code), T.DIGITS.get(code), tuple(countries.split()),
            T.MIXED_REGISTERS if code in T.CODE_MIXED else T.REGISTERS, (code, *chain.split()), font[1], font[2], tuple(map(int, font[3].split())), float(font[4]),
        )
    return out


def _countries() -> dict[str, Country]:
    out = {}
    for code, name, own, currency, symbol, decimals, calling, zones, locales, first, order, mononym in _rows(T.COUNTRIES):
        every = tuple(locales.split())
        out[code] = Country(code, name, own, currency, symbol, int(decimals), calling, tuple(zones.split()), every[0], every, "buddhist" if every[0] in T.BUDDHIST else "gregory", int(first), order, mononym == "yes")
    return out


LOCALES, COUNTRIES = _locales(), _countries()
LOCALE_CODES, REGION = tuple(LOCALES), tuple(COUNTRIES)
_LOWER = {code.lower(): code for code in LOCALES}


@cache
def resolve(tag: str | None) -> Locale | None:
    """The locale of a language tag, by its longest known prefix of subtags."""
    parts = (tag or "").strip().lower().replace("_", "-").split("-")
    found = next((_LOWER[p] for n in range(len(parts), 0, -1) if (p := "-".join(parts[:n])) in _LOWER), None)
    return LOCALES[found] if found else None


def chain(tag: str) -> tuple[str, ...]:
    """Where a message is looked for: the locale's fallbacks, English last."""
    found = resolve(tag)
    steps = found.fallback if found else ()
    return steps if "en" in steps else (*steps, "en")


def dim_locale(spark: SparkSession) -> DataFrame:
    """A row for each locale, in the order of the registry."""
    schema = "ord int, code string, name string, native_name string, script string, direction string, intl_locale string, default_currency string, calendar string, word_spaced boolean, count_order string, code_mixed boolean, base_locale string, native_digits string, countries array<string>, registers array<string>, fallback array<string>, font_family string, font_web string, font_weights array<int>, line_height double"
    return spark.createDataFrame([(i, *map(_plain, asdict(v).values())) for i, v in enumerate(LOCALES.values())], schema)


def dim_country(spark: SparkSession) -> DataFrame:
    """A row for each country."""
    schema = "ord int, code string, name string, native_name string, currency string, currency_symbol string, currency_decimals int, calling_code string, time_zones array<string>, default_locale string, locales array<string>, default_calendar string, first_day_of_week int, name_order string, mononym_common boolean"
    return spark.createDataFrame([(i, *map(_plain, asdict(v).values())) for i, v in enumerate(COUNTRIES.values())], schema)


def dim_fallback(spark: SparkSession) -> DataFrame:
    """(locale, rank, tag): the chain of each locale."""
    return spark.createDataFrame([(c, i, t) for c in LOCALES for i, t in enumerate(chain(c))], "locale string, rank int, tag string")


def dim_classifier(spark: SparkSession) -> DataFrame:
    """(locale, category, classifier) for every locale that has one, through its chain."""
    return spark.createDataFrame([(c, k, v) for c in LOCALES for k in T.CATEGORIES if (v := classifier(c, k))], "locale string, category string, classifier string")


def _plain(value):
    return list(value) if isinstance(value, tuple) else value


_CLASSIFIERS = {code: dict(zip(T.CATEGORIES, words.split(), strict=True)) for code, words in _rows(T.CLASSIFIERS, ":")}


def classifier(tag: str, category: str) -> str | None:
    return next((_CLASSIFIERS[t][category] for t in chain(tag) if category in _CLASSIFIERS.get(t, {})), None)


def particles() -> dict[str, dict[str, tuple[str, str] | None]]:
    """For each locale's own table: gender to particles of a statement and a question."""
    out = {}
    for code, *columns in _rows(T.PARTICLES):
        out[code] = {g: tuple(c.split()) if c else None for g, c in zip(("male", "female", "neutral"), columns, strict=True)}
    return out


def pronouns() -> dict[str, dict[str, dict[str, tuple[str, str]]]]:
    """locale, register, referent to (male, female)."""
    out = {}
    for code, *columns in _rows(T.PRONOUNS):
        out[code] = {r: {who: (w.split("/") * 2)[:2] for who, w in zip(("you", "i", "we"), c.split(", "), strict=True)} for r, c in zip(T.REGISTERS, columns, strict=True)}
    return out


def speech_levels() -> dict[str, dict[str, str]]:
    return {code: dict(zip(T.REGISTERS, columns, strict=True)) for code, *columns in _rows(T.SPEECH_LEVELS)}


def locales_for_script(script: str) -> list[str]:
    return [c for c, v in LOCALES.items() if v.script == script]


def unspaced_locales() -> list[str]:
    return [c for c, v in LOCALES.items() if not v.word_spaced]


def locales_for_country(code: str) -> list[str]:
    found = COUNTRIES.get(code.upper())
    return list(found.locales) if found else []


def literal_map(values: dict) -> F.Column:
    """A map column of fixed values."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
