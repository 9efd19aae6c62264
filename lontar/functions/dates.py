"""Dates, times and spans of time in a locale's way."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import registry as R
from ..registry import cldr
from .digits import ASCII, to_native_digits

ERA = 543
#: Milliseconds of the units, the largest first.
LENGTHS = {"year": 31_536_000_000, "month": 2_592_000_000, "week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000}
_FIELD = re.compile(r"'((?:[^']|'')*)'|([A-Za-z])\2*|[^A-Za-z']+")


def to_buddhist_year(year: Column) -> Column:
    return year + ERA


def from_buddhist_year(year: Column) -> Column:
    return year - ERA


def _named(names: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), at)


def _written(pattern: str, at: Column, data: cldr.LocaleData, calendar: str) -> Column:
    """A CLDR pattern as an expression."""
    number = lambda c, width: F.translate(F.lpad(c.cast("string"), width, "0") if width > 1 else c.cast("string"), ASCII, data.digits)
    year = F.year(at) + ERA if calendar == "buddhist" else F.year(at)
    parts = []
    for m in _FIELD.finditer(pattern):
        text, kind, width = m[0], m[2], len(m[0])
        if kind is None:
            parts.append(F.lit((m[1] or "'").replace("''", "'") if text[0] == "'" else text))
        elif kind in "yu":
            parts.append(number(F.pmod(year, F.lit(100)), 2) if width == 2 else number(year, width))
        elif kind in "ML" and width > 2:
            parts.append(_named(data.months[f"{'own' if kind == 'L' else 'format'} {text[0:3].replace('L', 'M') if width == 3 else 'MMMM'}"], F.month(at)))
        elif kind in "ML":
            parts.append(number(F.month(at), width))
        elif kind == "d":
            parts.append(number(F.dayofmonth(at), width))
        elif kind in "Ecce":
            parts.append(_named(data.weekdays[f"{'own' if kind == 'c' else 'format'} {'EEEE' if width == 4 else 'EEE'}"], F.dayofweek(at)))
        elif kind == "G":
            parts.append(F.lit(data.eras[calendar]))
        elif kind in "Hk":
            parts.append(number(F.hour(at), width))
        elif kind in "hK":
            parts.append(number(F.pmod(F.hour(at) + 11, F.lit(12)) + 1, width))
        elif kind == "m":
            parts.append(number(F.minute(at), max(2, width)))
        elif kind == "s":
            parts.append(number(F.second(at), max(2, width)))
        elif kind in "abB":
            parts.append(F.when(F.hour(at) < 12, data.halves[0]).otherwise(data.halves[1]))
        elif kind in "zv":
            parts.append(F.lit("UTC"))
        else:
            raise ValueError(f"pattern {pattern!r} has a field {text!r}")
    return F.concat(*parts)


def format_date(spark: SparkSession, at: Column, locale: str, style: str = "medium", calendar: str | None = None, time_zone: str | None = None, native_digits: bool = False) -> Column:
    """A date in the locale's calendar unless said; timestamps are in UTC, shown in time_zone."""
    found = R.resolve(locale)
    data, calendar = cldr.read(spark, found.code, "date"), calendar or found.calendar
    at = F.from_utc_timestamp(at, time_zone) if time_zone else at
    out = _written(data.date[f"buddhist {style}" if calendar == "buddhist" else style], at, data, calendar)
    return to_native_digits(out, locale) if native_digits else out


def format_date_for_country(spark: SparkSession, at: Column, country: str, locale: str | None = None, time_zone: str | None = None, **options) -> Column:
    """A date in the country's calendar, language and first time zone unless said."""
    found = R.COUNTRIES[country.upper()]
    return format_date(spark, at, locale or found.default_locale, calendar=found.default_calendar, time_zone=time_zone or found.time_zones[0], **options)


def format_time(spark: SparkSession, at: Column, locale: str, style: str = "short", native_digits: bool = False) -> Column:
    data = cldr.read(spark, R.resolve(locale).code, "date")
    out = _written(data.date[f"time {style}"], at, data, "gregory")
    return to_native_digits(out, locale) if native_digits else out


def relative_unit(milliseconds: Column) -> Column:
    """The largest unit that the span has one of, else seconds."""
    out = F.lit("second")
    for unit, length in reversed(LENGTHS.items()):
        out = F.when(F.abs(milliseconds) >= length, unit).otherwise(out)
    return out


def relative_value(milliseconds: Column) -> Column:
    """The span in its unit, halves rounded up."""
    length = R.literal_map(LENGTHS)[relative_unit(milliseconds)]
    return F.floor(milliseconds / length + 0.5).cast("long")


def format_relative_time(spark: SparkSession, at: Column, now: Column, locale: str, native_digits: bool = False) -> Column:
    """How long ago or until, in words where the language has them."""
    from .grammar import plural_category
    from .numbers import format_number

    found = R.resolve(locale)
    data = cldr.read(spark, found.code, "relative")
    span = F.unix_millis(at.cast("timestamp")) - F.unix_millis(now.cast("timestamp"))
    unit, value = relative_unit(span), relative_value(span)
    named = R.literal_map({f"{u} {n}": text for u, held in data.relative.items() for n, text in held.items()})
    forms = R.literal_map({f"{u} {way} {category}": text for u, held in data.spans.items() for (way, category), text in held.items()})
    way = F.when(span < 0, "past").otherwise("future")
    category = plural_category(F.abs(value), F.lit(found.code))
    template = F.coalesce(forms[F.concat_ws(" ", unit, way, category)], forms[F.concat_ws(" ", unit, way, F.lit("other"))])
    counted = F.replace(template, F.lit("\0"), format_number(spark, F.abs(value), locale))
    out = F.when(F.abs(value) <= cldr.NAMED, named[F.concat_ws(" ", unit, value.cast("string"))]).otherwise(counted)
    return to_native_digits(out, locale) if native_digits else out
