"""Messages found through fallback chains, registers and plural forms, as joins over the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.digits import to_native_digits
from ..functions.grammar import plural_category, with_politeness
from ..functions.locale import resolve_locale
from ..functions.numbers import dim_numbers, written

PLACEHOLDER = r"\{(\w+)\}"


def interpolate(template: Column, values: Column) -> Column:
    """Each {name} replaced by its value in a map; names without one stay. Values are not looked into again."""
    parts = F.regexp_extract_all(template, F.lit(r"\{\w+\}|[^{]+|\{"), F.lit(0))
    name = lambda p: F.regexp_extract(p, r"^\{(\w+)\}$", 1)
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.when(name(p) != "", values[name(p)]), p)), "")


def _candidates(requests: DataFrame, messages: DataFrame) -> DataFrame:
    chains = R.dim_fallback(requests.sparkSession)
    asked = requests.withColumn("code", F.coalesce(resolve_locale(F.col("locale")), F.lit("en")))
    steps = asked.join(F.broadcast(chains.withColumnRenamed("locale", "code")), "code")
    held = messages.select(F.col("locale").alias("tag"), "key", F.col("register").alias("of_register"), "plural", "value", "ord")
    return steps.join(held, ["tag", "key"])


def _nearest(spark, messages: DataFrame) -> DataFrame:
    """(code, key, tag, forms): for each locale asked for, the nearest of its chain that has the key, and its forms there.

    As large as the messages times the locales that fall back on them; requests are joined with it and not grouped.
    """
    forms = messages.groupBy(F.col("locale").alias("tag"), "key").agg(F.collect_list(F.struct(F.col("register").alias("of_register"), "plural", "value", "ord")).alias("forms"))
    steps = forms.join(F.broadcast(R.dim_fallback(spark).withColumnRenamed("locale", "code")), "tag")
    return steps.groupBy("code", "key").agg(F.min_by(F.struct("tag", "forms"), "rank").alias("near")).select("code", "key", "near.*")


def resolve_messages(requests: DataFrame, messages: DataFrame, native_digits: bool = False) -> DataFrame:
    """requests with text, matched_locale and missing.

    requests: request_id, locale, key, register, count, params (map of strings), numbers (map of doubles),
    polite, gender, fallback; only the first three must be there. Numbers and the count are written as the
    locale asked for writes them, whichever locale the message comes from; params stay as they are, and win. The nearest locale of the chain that has the key
    decides; in it the register asked for, else neutral, formal, casual; then the plural form of the
    count by that locale's rules, else other, else the first. Missing keys give fallback, else the key.
    """
    spare = {"register": "string", "count": "double", "params": "map<string,string>", "numbers": "map<string,double>", "polite": "boolean", "gender": "string", "fallback": "string"}
    for name, kind in spare.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    own = unused_name(requests.columns, "__message")
    position = lambda register: F.array_position(F.array(F.coalesce("register", F.lit("neutral")), F.lit("neutral"), F.lit("formal"), F.lit("casual")), register)
    code = F.coalesce(resolve_locale(F.col("locale")), F.lit("en"))
    forms = _nearest(requests.sparkSession, messages).select(F.struct("code", "key", "tag", "forms").alias(own))
    held = requests.join(forms, (code == F.col(f"{own}.code")) & (F.col("key") == F.col(f"{own}.key")), "left")
    tag = F.col(f"{own}.tag")
    category = F.when(F.col("count").isNull(), "other").otherwise(plural_category(F.col("count"), tag))
    held = held.withColumn(f"{own}_category", category)
    form = lambda f: F.when(f["plural"].isNull() | (f["plural"] == F.col(f"{own}_category")), 0).when(f["plural"] == "other", 1).otherwise(2)
    ordered = F.transform(F.col(f"{own}.forms"), lambda f: F.struct(F.when(f["of_register"].isNull(), 0).otherwise(position(f["of_register"])).alias("how"), form(f).alias("form"), f["ord"].alias("ord"), f["value"].alias("value")))
    best = F.struct(F.array_min(ordered)["value"].alias("value"), tag.alias("tag"))
    held = held.withColumn("best", F.when(tag.isNotNull(), best))
    symbols = unused_name(requests.columns)
    table = dim_numbers(requests.sparkSession)
    table = table.select(F.col("code").alias(f"{symbols}_code"), F.struct(*(x for x in table.columns if x != "code")).alias(symbols))
    asked_in = F.coalesce(resolve_locale(F.col("locale")), F.lit("en"))
    out = held.join(F.broadcast(table), asked_in == F.col(f"{symbols}_code"), "left")
    none = F.create_map().cast("map<string,string>")
    params, numbers = F.coalesce("params", none), F.coalesce("numbers", F.create_map().cast("map<string,double>"))
    numbers = F.map_filter(numbers, lambda k, _: ~F.map_contains_key(params, k))
    counted = F.col("count").isNotNull() & ~F.map_contains_key(params, F.lit("count")) & ~F.map_contains_key(numbers, F.lit("count"))
    shown = F.when(counted, F.create_map(F.lit("count"), written(F.col("count"), F.col(symbols)))).otherwise(none)
    values = F.map_concat(shown, F.transform_values(numbers, lambda _, v: written(v, F.col(symbols))), params)
    text = interpolate(F.col("best.value"), values)
    if native_digits:
        text = to_native_digits(text, F.col("locale"))
    text = F.when(F.coalesce("polite", F.lit(False)), with_politeness(text, F.col("locale"), F.col("gender"))).otherwise(text)
    missing = F.col("best").isNull()
    return out.select(*requests.columns, F.when(missing, F.coalesce("fallback", "key")).otherwise(text).alias("text"), F.col("best.tag").alias("matched_locale"), missing.alias("missing"))


def unused_name(columns: list[str], name: str = "__symbols") -> str:
    while any(c.startswith(name) for c in columns):
        name += "_"
    return name


def has_message(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """Requests that some locale of their chain can answer."""
    found = _candidates(requests, messages).select("request_id").distinct()
    return requests.join(found, "request_id", "left_semi")


def missing_keys(messages: DataFrame, locale: str, reference: str = "en") -> DataFrame:
    """Keys of the reference that the locale itself doesn't have; its chain plays no part."""
    keys = messages.where(F.col("locale") == reference).select("key").distinct()
    return keys.join(messages.where(F.col("locale") == locale).select("key"), "key", "left_anti")


def coverage(messages: DataFrame, reference: str = "en") -> DataFrame:
    """(locale, total, translated, missing) of each locale but the reference."""
    have = messages.select("locale", "key").distinct()
    keys = have.where(F.col("locale") == reference).select("key")
    locales = have.where(F.col("locale") != reference).select("locale").distinct()
    every = keys.crossJoin(F.broadcast(locales))  # as many locales as the registry has
    marked = every.join(have.withColumn("here", F.lit(True)), ["locale", "key"], "left")
    counted = marked.groupBy("locale").agg(F.count("*").alias("total"), F.count("here").alias("translated"), F.array_sort(F.collect_list(F.when(F.col("here").isNull(), F.col("key")))).alias("missing"))
    none = locales.select("locale", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("translated"), F.array().cast("array<string>").alias("missing"))
    return counted.unionByName(none.join(counted.select("locale"), "locale", "left_anti"))


def bundle(keys: DataFrame, locale: str, register: str = "neutral") -> DataFrame:
    """(key, value, matched_locale) that an application would load.

    keys: project_id, name, values (locale to register to text), draft, regulated. Regulated keys
    with a draft in the locale are left out. An empty text sends the search to the next locale.
    """
    chain = R.chain(locale)
    table = lambda tag: F.coalesce(*[F.col("values")[tag][r] for r in (register, "neutral", "formal", "casual")])
    steps = F.array(*(F.struct(F.nullif(table(tag), F.lit("")).alias("value"), F.lit(tag).alias("tag")) for tag in chain))
    first = F.element_at(F.concat(F.filter(steps, lambda s: s["value"].isNotNull()), F.array(F.lit(None).cast("struct<value:string,tag:string>"))), 1)
    open_keys = keys.where(~(F.col("regulated") & F.array_contains("draft", locale)))
    return open_keys.withColumn("best", first).where("best is not null").select(F.col("name").alias("key"), "best.value", F.col("best.tag").alias("matched_locale"))
