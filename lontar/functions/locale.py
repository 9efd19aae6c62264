"""Locale resolution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R

def _codes() -> Column:
    return R.literal_map({c.lower(): c for c in R.LOCALES})


def by_locale(code: Column, values: dict[str, object], missing: object = None) -> Column:
    """The value for a resolved locale code; missing where there is none."""
    held = {k: v for k, v in values.items() if v is not None}
    if not held:
        return F.lit(missing)
    found = R.literal_map(held)[code]
    return found if missing is None else F.coalesce(found, F.lit(missing))


def resolve_locale(tag: Column) -> Column:
    """The registry's code for a language tag, by its longest known prefix; null if unknown."""
    parts = F.split(F.replace(F.lower(F.trim(tag)), F.lit("_"), F.lit("-")), "-")
    # Codes have at most three subtags but one of four: longer prefixes are never known.
    steps = [_codes()[F.array_join(F.slice(parts, 1, n), "-")] for n in (4, 3, 2, 1)]
    return F.coalesce(*steps)


def get_locale(tag: Column) -> Column:
    return F.coalesce(resolve_locale(tag), F.raise_error(F.concat(F.lit("unknown locale "), F.coalesce(tag, F.lit("null")))).cast("string"))


def is_supported(tag: Column) -> Column:
    return resolve_locale(tag).isNotNull()


def fallback_chain(tag: Column) -> Column:
    """The tags that a message is looked for in, English last; unknown tags have English alone."""
    chains = F.create_map(*[x for c in R.LOCALES for x in (F.lit(c), F.array(*map(F.lit, R.chain(c))))])
    return F.coalesce(chains[resolve_locale(tag)], F.array(F.lit("en")))


def parse_accept_language(header: Column) -> Column:
    """Tags of an Accept-Language header by falling quality, equal ones as they come; entries without a number go."""
    def quality(e: Column) -> Column:
        said = F.regexp_extract(e, r"q=\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")
        return F.when(F.contains(e, F.lit("q=")), said).otherwise(1.0)

    entry = F.transform(F.split(header, ","), lambda e, i: F.struct((-quality(e)).alias("q"), i.alias("i"), F.trim(F.element_at(F.split(e, ";"), 1)).alias("tag")))
    kept = F.filter(entry, lambda e: e["q"].isNotNull() & (e["tag"] != ""))
    return F.transform(F.array_sort(kept), lambda e: e["tag"])


def negotiate(requested: Column, available: Column | None = None, fallback: str = "en") -> Column:
    """The first requested tag whose own code, else a tag of whose chain, is in the pool; else fallback."""
    pool = F.array(*map(F.lit, R.LOCALES)) if available is None else F.transform(available, lambda t: F.coalesce(resolve_locale(t), t))
    tried = F.transform(requested, lambda t: F.when(resolve_locale(t).isNotNull(), F.element_at(F.concat(F.filter(F.concat(F.array(resolve_locale(t)), fallback_chain(t)), lambda c: F.array_contains(pool, c)), F.array(F.lit(None).cast("string"))), 1)))
    return F.coalesce(F.element_at(F.concat(F.filter(tried, lambda t: t.isNotNull()), F.array(F.lit(None).cast("string"))), 1), F.lit(fallback))


def locale_from_request(cookie: Column, country: Column, accept_language: Column, available: Column | None = None, fallback: str = "en") -> Column:
    """A known cookie wins whatever is available; else the country's locales, then the header, are negotiated."""
    of_country = F.create_map(*[x for c, v in R.COUNTRIES.items() for x in (F.lit(c), F.array(*map(F.lit, v.locales)))])
    none = F.array().cast("array<string>")
    asked = F.concat(F.coalesce(of_country[F.upper(country)], none), F.coalesce(parse_accept_language(accept_language), none))
    return F.coalesce(resolve_locale(cookie), negotiate(asked, available, fallback))


def html_attributes(tag: Column) -> Column:
    code = get_locale(tag)
    return F.struct(code.alias("lang"), by_locale(code, {c: v.direction for c, v in R.LOCALES.items()}).alias("dir"))


def first_day_of_week(country: Column) -> Column:
    return F.coalesce(R.literal_map({c: v.first_day_of_week for c, v in R.COUNTRIES.items()})[F.upper(country)], F.lit(1))


def needs_segmentation(tag: Column) -> Column:
    return F.coalesce(resolve_locale(tag).isin(*R.unspaced_locales()), F.lit(False))


def cluster_script(tag: Column) -> Column:
    """The script whose letters cluster: Thai, Laoo, Khmr, Mymr or Hans, else Latn."""
    return by_locale(resolve_locale(tag), {c: v.script for c, v in R.LOCALES.items() if v.script in ("Thai", "Laoo", "Khmr", "Mymr", "Hans")}, "Latn")


def negotiated(requests: DataFrame, fallbacks: DataFrame, pool: DataFrame, fallback: str = "en") -> DataFrame:
    """negotiate() as joins, for requests (request_id, requested array) and a pool (tag) of any size."""
    asked = requests.select("request_id", F.posexplode("requested").alias("pos", "asked")).withColumn("locale", resolve_locale(F.col("asked")))
    steps = asked.join(F.broadcast(fallbacks), "locale").join(pool.select(F.col("tag")).distinct(), "tag", "left_semi")
    best = steps.groupBy("request_id").agg(F.min_by("tag", F.struct("pos", "rank")).alias("negotiated"))
    return requests.join(best, "request_id", "left").select("request_id", F.coalesce("negotiated", F.lit(fallback)).alias("negotiated"))
