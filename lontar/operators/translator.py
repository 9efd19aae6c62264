"""A translator of one locale and register over the long table of messages, for tables of requests and of values."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions import dates, grammar, numbers
from . import messages as M


@dataclass(frozen=True)
class Translator:
    """messages: the long table. Every method but those that give a translator makes a DataFrame or a column."""

    messages: DataFrame
    locale: str
    register: str = "neutral"
    gender: str | None = None
    native_digits: bool = False

    def __post_init__(self) -> None:
        found = R.resolve(self.locale)
        if found is None:
            raise ValueError(f"unknown locale {self.locale!r}")
        object.__setattr__(self, "locale", found.code)

    @property
    def direction(self) -> str:
        return R.LOCALES[self.locale].direction

    def with_locale(self, locale: str) -> Translator:
        return replace(self, locale=locale)

    def with_register(self, register: str) -> Translator:
        return replace(self, register=register)

    def _asked(self, requests: DataFrame) -> DataFrame:
        out = requests.withColumn("locale", F.lit(self.locale))
        own = F.lit(self.register)
        out = out.withColumn("register", F.coalesce("register", own) if "register" in requests.columns else own)
        sex = F.lit(self.gender).cast("string")
        return out.withColumn("gender", F.coalesce("gender", sex) if "gender" in requests.columns else sex)

    def translate(self, requests: DataFrame) -> DataFrame:
        """requests (request_id, key, ...) with text, matched_locale and missing; see resolve_messages()."""
        return M.resolve_messages(self._asked(requests), self.messages, self.native_digits)

    def has(self, requests: DataFrame) -> DataFrame:
        return M.has_message(self._asked(requests), self.messages)

    def missing_keys(self, reference: str = "en") -> DataFrame:
        return M.missing_keys(self.messages, self.locale, reference)

    def number(self, value: Column, **options) -> Column:
        return numbers.format_number(self._spark, value, self.locale, **{"native_digits": self.native_digits} | options)

    def currency(self, value: Column, **options) -> Column:
        return numbers.format_currency(self._spark, value, self.locale, **{"native_digits": self.native_digits} | options)

    def date(self, at: Column, **options) -> Column:
        return dates.format_date(self._spark, at, self.locale, **{"native_digits": self.native_digits} | options)

    def relative_time(self, at: Column, now: Column) -> Column:
        return dates.format_relative_time(self._spark, at, now, self.locale, self.native_digits)

    def count(self, n: Column, noun: Column, **options) -> Column:
        return grammar.format_count(n, noun, F.lit(self.locale), **{"native_digits": self.native_digits} | options)

    def pronoun(self, referent: str = "you") -> Column:
        return grammar.pronoun(F.lit(self.locale), F.lit(referent), F.lit(self.register), F.lit(self.gender).cast("string"))

    def particle(self) -> Column:
        return grammar.polite_particle(F.lit(self.locale), F.lit(self.gender).cast("string"))

    @property
    def _spark(self):
        return self.messages.sparkSession
