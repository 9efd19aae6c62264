"""Numbers, money and percentages in a locale's way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as R
from ..registry import cldr
from ..registry.tables import WHOLE_CURRENCIES
from .digits import ASCII, to_native_digits


def currency_decimals(currency: Column) -> Column:
    return F.when(F.upper(currency).isin(*WHOLE_CURRENCIES), 0).otherwise(2)


def _body(value: Column, data: cldr.LocaleData, least: int, most: int) -> Column:
    """Digits of a number without its sign, half away from zero."""
    size = F.abs(F.round(value.cast("double"), most))
    plain = F.call_function("format_number", size, F.lit("#,##0" + ("." + "0" * least + "#" * (most - least) if most else "")))
    if data.grouping_from > 1000:
        plain = F.when(size < data.grouping_from, F.replace(plain, F.lit(","), F.lit(""))).otherwise(plain)
    shown = F.translate(plain, ",.", "\x01\x02")
    shown = F.replace(F.replace(shown, F.lit("\x01"), F.lit(data.group)), F.lit("\x02"), F.lit(data.decimal))
    return F.translate(shown, ASCII, data.digits) if data.digits != ASCII else shown


def _signed(value: Column, most: int, body: Column, around: cldr.Affixes) -> Column:
    negative = F.round(value.cast("double"), most) < 0
    return F.when(negative, F.concat(F.lit(around.negative_prefix), body, F.lit(around.negative_suffix))).otherwise(F.concat(F.lit(around.prefix), body, F.lit(around.suffix)))


def format_number(spark: SparkSession, value: Column, locale: str, least: int = 0, most: int = 3, native_digits: bool = False) -> Column:
    """At most three digits of a fraction unless said."""
    data = cldr.read(spark, R.resolve(locale).code)
    out = _signed(value, most, _body(value, data, least, most), data.number)
    return to_native_digits(out, locale) if native_digits else out


def format_currency(spark: SparkSession, value: Column, locale: str, currency: str | None = None, display: str = "symbol", native_digits: bool = False) -> Column:
    """An amount in the locale's own currency unless said; no decimals where nobody uses them."""
    found = R.resolve(locale)
    currency = currency or found.default_currency
    data, places = cldr.read(spark, found.code, f"{currency} {display}"), 0 if currency in WHOLE_CURRENCIES else 2
    out = _signed(value, places, _body(value, data, places, places), data.currency[currency, display])
    return to_native_digits(out, locale) if native_digits else out


def format_currency_for_country(spark: SparkSession, value: Column, country: str, locale: str | None = None, **options) -> Column:
    found = R.COUNTRIES[country.upper()]
    return format_currency(spark, value, locale or found.default_locale, currency=found.currency, **options)


def format_percent(spark: SparkSession, value: Column, locale: str, native_digits: bool = False) -> Column:
    """Whole percents, half away from zero by the value's decimals: 0.285 is 29%, though a hundred of that double are less than 28.5."""
    data = cldr.read(spark, R.resolve(locale).code)
    whole = F.round(F.round(value.cast("double"), 2) * 100, 0)
    out = _signed(whole, 0, _body(whole, data, 0, 0), data.percent)
    return to_native_digits(out, locale) if native_digits else out


def format_compact(spark: SparkSession, value: Column, locale: str, native_digits: bool = False) -> Column:
    """Short forms of thousands and more; two digits at least, no fraction from 100 on. What rounds up to the next short form has that: 999,500 is 1M."""
    data = cldr.read(spark, R.resolve(locale).code, "compact")
    size = F.abs(value.cast("double"))
    # The power of ten, of what is left when the rest is rounded, picks a scale and what stands around the digits.
    steps = [(1.0, "", ""), *((scale, before, after) for _, scale, before, after in data.compact)]
    starts = [first - steps[i][0] / 2 for i, (first, *_) in enumerate(data.compact)]
    power = F.size(F.filter(F.array(*map(F.lit, starts)), lambda start: start <= size)) + 1
    scale, before, after = (F.element_at(F.array(*map(F.lit, column)), power) for column in zip(*steps, strict=True))
    part = size / scale
    body = F.when(F.round(part, 1) < 100, _body(F.round(part, 1), data, 0, 1)).otherwise(_body(part, data, 0, 0))
    out = F.concat(F.when(value < 0, data.minus).otherwise(""), before, body, after)
    return to_native_digits(out, locale) if native_digits else out


def dim_money(spark: SparkSession, display: str = "symbol") -> DataFrame:
    """How each locale writes its own currency, a row for each, for joins with rows of many locales."""
    rows = []
    for code, found in R.LOCALES.items():
        currency = found.default_currency
        data = cldr.read(spark, code, f"{currency} {display}")
        around = data.currency[currency, display]
        rows.append((code, currency, 0 if currency in WHOLE_CURRENCIES else 2, data.group, data.decimal, data.digits, data.grouping_from, around.prefix, around.suffix, around.negative_prefix, around.negative_suffix))
    return spark.createDataFrame(rows, "locale string, currency string, places int, group string, decimal string, digits string, grouping_from int, prefix string, suffix string, negative_prefix string, negative_suffix string")


def with_money(df: DataFrame, value: str, locale: str = "locale", name: str = "money") -> DataFrame:
    """df with its amounts as the locale of each row writes them; null for unknown locales."""
    table = F.broadcast(dim_money(df.sparkSession).withColumnRenamed("locale", "__locale"))
    joined = df.join(table, F.col(locale) == F.col("__locale"), "left")
    exact = F.when(F.col("places") == 0, F.round(F.col(value).cast("double"), 0)).otherwise(F.round(F.col(value).cast("double"), 2))
    size = F.abs(exact)
    plain = F.when(F.col("places") == 0, F.format_number(size, 0)).otherwise(F.format_number(size, 2))
    plain = F.when(size < F.col("grouping_from"), F.replace(plain, F.lit(","), F.lit(""))).otherwise(plain)
    body = F.call_function("translate", plain, F.lit(",." + ASCII), F.concat("group", "decimal", "digits"))
    text = F.when(exact < 0, F.concat("negative_prefix", body, "negative_suffix")).otherwise(F.concat("prefix", body, "suffix"))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), text.alias(name))


def dim_numbers(spark: SparkSession) -> DataFrame:
    """How each locale writes plain numbers, a row for each, for joins with rows of many locales."""
    rows = []
    for code in R.LOCALES:
        data = cldr.read(spark, code)
        around = data.number
        rows.append((code, data.group, data.decimal, data.digits, data.grouping_from, around.prefix, around.suffix, around.negative_prefix, around.negative_suffix))
    return spark.createDataFrame(rows, "code string, group string, decimal string, digits string, grouping_from int, prefix string, suffix string, negative_prefix string, negative_suffix string")


def written(value: Column, symbols: Column) -> Column:
    """A number with at most three digits of a fraction, by a struct of dim_numbers()."""
    exact = F.round(value.cast("double"), 3)
    size = F.abs(exact)
    plain = F.call_function("format_number", size, F.lit("#,##0.###"))
    plain = F.when(size < symbols["grouping_from"], F.replace(plain, F.lit(","), F.lit(""))).otherwise(plain)
    body = F.call_function("translate", plain, F.lit(",." + ASCII), F.concat(symbols["group"], symbols["decimal"], symbols["digits"]))
    return F.when(exact < 0, F.concat(symbols["negative_prefix"], body, symbols["negative_suffix"])).otherwise(F.concat(symbols["prefix"], body, symbols["suffix"]))
