"""Digits of scripts, and numbers that people wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import registry as R
from ..registry.tables import DIGIT_ZEROS
from .locale import resolve_locale

ASCII = "0123456789"
_ALL = "".join(chr(z + d) for z in DIGIT_ZEROS for d in range(10))


def to_latin_digits(text: Column) -> Column:
    return F.translate(text, _ALL, ASCII * len(DIGIT_ZEROS))


def has_native_digits(text: Column) -> Column:
    return to_latin_digits(text) != text


def to_native_digits(text: Column, locale: Column | str) -> Column:
    """ASCII digits as the locale's own; unchanged where it has none."""
    if isinstance(locale, str):
        found = R.resolve(locale)
        return F.translate(text, ASCII, found.native_digits) if found and found.native_digits else text
    code = resolve_locale(locale)
    out = text
    for c, v in R.LOCALES.items():
        if v.native_digits:
            out = F.when(code == c, F.translate(text, ASCII, v.native_digits)).otherwise(out)
    return out


def parse_number(text: Column, group: Column, decimal: Column) -> Column:
    """The number at the start of what is left without group separators and other characters; null if there is none."""
    plain = F.replace(to_latin_digits(text), group, F.lit(""))
    at = F.instr(plain, decimal)
    once = F.when((at > 0) & (decimal != ""), F.concat(F.substring(plain, F.lit(1), at - 1), F.lit("."), F.substring(plain, at + F.length(decimal), F.length(plain)))).otherwise(plain)
    kept = F.regexp_replace(once, r"[^0-9.\-]", "")
    return F.regexp_extract(kept, r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("double")
