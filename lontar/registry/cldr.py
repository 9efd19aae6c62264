"""Locale data for numbers, money, dates and spans of time, read from the ICU that comes with Spark.

It is read once on the driver, as plain strings, and becomes literals of column expressions; nothing
of it runs on executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from . import LOCALES
from .tables import WHOLE_CURRENCIES

UNITS = ("year", "month", "week", "day", "hour", "minute", "second")
#: Spans up to so many units may have words of their own.
NAMED = 3
_DIGITS = re.compile(r"\d(?:.*\d)?", re.S)


@dataclass
class Affixes:
    prefix: str
    suffix: str
    negative_prefix: str
    negative_suffix: str


@dataclass
class LocaleData:
    intl: str
    group: str = ","
    decimal: str = "."
    digits: str = "0123456789"
    grouping_from: int = 1000
    minus: str = "-"
    number: Affixes = field(default_factory=lambda: Affixes("", "", "-", ""))
    percent: Affixes = field(default_factory=lambda: Affixes("", "%", "-", "%"))
    currency: dict[tuple[str, str], Affixes] = field(default_factory=dict)
    compact: list[tuple[float, float, str, str]] = field(default_factory=list)
    date: dict[str, str] = field(default_factory=dict)
    months: dict[str, list[str]] = field(default_factory=dict)
    weekdays: dict[str, list[str]] = field(default_factory=dict)
    eras: dict[str, str] = field(default_factory=dict)
    halves: tuple[str, str] = ("AM", "PM")
    relative: dict[str, dict[int, str]] = field(default_factory=dict)
    spans: dict[str, dict[tuple[str, str], str]] = field(default_factory=dict)
    parts: set[str] = field(default_factory=set)


_cache: dict[str, LocaleData] = {}


def _split(shown: str, negative: str) -> Affixes:
    a, b = _DIGITS.search(shown), _DIGITS.search(negative)
    return Affixes(shown[: a.start()], shown[a.end() :], negative[: b.start()], negative[b.end() :])


def read(spark: SparkSession, code: str, part: str = "number") -> LocaleData:
    """What a locale of the registry writes like; parts are read as they are asked for.

    part: number, compact, date, relative, or a currency and a display such as `THB symbol`.
    """
    intl = LOCALES[code].intl_locale
    icu = spark._jvm.com.ibm.icu
    locale = icu.util.ULocale.forLanguageTag(intl)
    if intl not in _cache:
        _cache[intl] = LocaleData(intl)
        _numbers(icu, locale, _cache[intl])
    out = _cache[intl]
    if part not in out.parts:
        out.parts.add(part)
        if " " in part:
            _money(icu, locale, out, *part.split(" "))
        elif part != "number":
            {"compact": _compact, "date": _dates, "relative": _relative}[part](icu, locale, out)
    return out


def _numbers(icu, locale, out: LocaleData) -> None:
    symbols = icu.text.DecimalFormatSymbols.getInstance(locale)
    out.group, out.decimal = symbols.getGroupingSeparatorString(), symbols.getDecimalSeparatorString()
    out.digits, out.minus = "".join(symbols.getDigitStrings()), symbols.getMinusSignString()
    plain = icu.text.NumberFormat.getInstance(locale)
    out.grouping_from = 1000 if out.group in plain.format(1234) else 10000
    out.number = _split(plain.format(1), plain.format(-1))
    share = icu.text.NumberFormat.getPercentInstance(locale)
    out.percent = _split(share.format(1.0), share.format(-1.0))


def _money(icu, locale, out: LocaleData, currency: str, display: str) -> None:
    styles = icu.text.NumberFormat
    kind = {"symbol": styles.CURRENCYSTYLE, "code": styles.ISOCURRENCYSTYLE, "name": styles.PLURALCURRENCYSTYLE}[display]
    money, places = styles.getInstance(locale, kind), 0 if currency in WHOLE_CURRENCIES else 2
    money.setCurrency(icu.util.Currency.getInstance(currency))
    money.setMinimumFractionDigits(places)
    money.setMaximumFractionDigits(places)
    out.currency[currency, display] = _split(money.format(7), money.format(-7))


def _compact(icu, locale, out: LocaleData) -> None:
    short = icu.text.CompactDecimalFormat.getInstance(locale, icu.text.CompactDecimalFormat.CompactStyle.SHORT)
    for power in range(3, 15):
        shown = short.format(float(2 * 10**power))
        number = _DIGITS.search(shown)
        scale = float(2 * 10**power) / _number(number[0], out)
        out.compact.append((float(10**power), scale, shown[: number.start()], shown[number.end() :]))


def _dates(icu, locale, out: LocaleData) -> None:
    form = icu.text.DateFormat
    gregory, buddhist = (icu.util.ULocale.forLanguageTag(f"{out.intl}-u-ca-{c}") for c in ("gregory", "buddhist"))
    for style, kind in (("short", form.SHORT), ("medium", form.MEDIUM), ("long", form.LONG), ("full", form.FULL)):
        out.date[style] = form.getDateInstance(kind, gregory).toPattern()
        out.date[f"buddhist {style}"] = form.getDateInstance(kind, buddhist).toPattern()
        out.date[f"time {style}"] = form.getTimeInstance(kind, gregory).toPattern()
    kinds = icu.text.DateFormatSymbols
    names = kinds(gregory)
    for use, context in (("format", kinds.FORMAT), ("own", kinds.STANDALONE)):
        for width, kind in (("MMM", kinds.ABBREVIATED), ("MMMM", kinds.WIDE)):
            out.months[f"{use} {width}"] = list(names.getMonths(context, kind))
        for width, kind in (("EEE", kinds.ABBREVIATED), ("EEEE", kinds.WIDE)):
            out.weekdays[f"{use} {width}"] = list(names.getWeekdays(context, kind))[1:]
    out.eras = {"gregory": names.getEras()[1], "buddhist": kinds(buddhist).getEras()[0]}
    out.halves = tuple(names.getAmPmStrings())


def _relative(icu, locale, out: LocaleData) -> None:
    spans = icu.text.RelativeDateTimeFormatter.getInstance(locale)
    units = icu.text.RelativeDateTimeFormatter.RelativeDateTimeUnit
    rules, plain = icu.text.PluralRules.forLocale(locale), icu.text.NumberFormat.getInstance(locale)
    for unit in UNITS:
        kind = getattr(units, unit.upper())
        out.relative[unit] = {n: spans.format(float(n), kind) for n in range(-NAMED, NAMED + 1)}
        held: dict[tuple[str, str], str] = {}
        for n in (5, 4, 21, 1_000_000):
            for sign, way in ((1, "future"), (-1, "past")):
                held.setdefault((way, rules.select(float(n))), spans.formatNumeric(float(sign * n), kind).replace(plain.format(n), "\0"))
        out.spans[unit] = held


def _number(text: str, data: LocaleData) -> float:
    plain = text.translate({ord(d): str(i) for i, d in enumerate(data.digits)})
    return float(plain.replace(data.group, "").replace(data.decimal, ".")) if plain else 2.0
