"""Translation bundles: a folder of JSON files, one for each locale, as one long table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that make a node a message rather than a namespace.
REGISTERS = ("formal", "neutral", "casual")
PLURALS = ("zero", "one", "two", "few", "many", "other")
SCHEMA = "locale string, key string, register string, plural string, value string, ord int, is_flat boolean"


def is_message(node) -> bool:
    return isinstance(node, str) or (isinstance(node, dict) and bool(node) and any(all(k in names for k in node) for names in (REGISTERS, PLURALS)))


def _leaves(node, register=None, plural=None) -> Iterator[tuple]:
    if isinstance(node, str):
        yield register, plural, node
    elif isinstance(node, dict):
        for name, inner in node.items():
            yield from _leaves(inner, name if name in REGISTERS else register, name if name in PLURALS else plural)


def flatten(bundle: dict, message_rule: bool = True) -> Iterator[tuple]:
    """(key, register, plural, value, ord, is_flat); without the rule every string is a key of its own."""
    work = [(name, node, True) for name, node in reversed(bundle.items())]
    while work:
        path, node, flat = work.pop()
        if message_rule and is_message(node):
            for i, (register, plural, value) in enumerate(_leaves(node)):
                yield path, register, plural, value, i, flat
        elif isinstance(node, dict):
            work += [(f"{path}.{name}", inner, False) for name, inner in reversed(node.items())]
        elif not message_rule and isinstance(node, str):
            yield path, None, None, node, 0, flat


def flatten_bundles(files: DataFrame, message_rule: bool = True) -> DataFrame:
    """The long table of files (locale, body). A body that is no JSON object fails with the locale's name."""

    def run(frames):
        for f in frames:
            rows = []
            for locale, body in zip(f["locale"], f["body"], strict=True):
                try:
                    bundle = json.loads(body)
                except (TypeError, ValueError) as error:
                    raise ValueError(f"bundle {locale} is not valid JSON: {error}") from None
                rows += [(locale, *r) for r in flatten(bundle, message_rule)]
            yield pd.DataFrame(rows, columns=["locale", "key", "register", "plural", "value", "ord", "is_flat"])

    found = files.select("locale", "body").mapInPandas(run, SCHEMA)
    # A key stored flat wins over the same one stored in namespaces.
    best = found.groupBy("locale", "key").agg(F.max("is_flat").alias("has_flat"))
    return found.join(best, ["locale", "key"]).where(F.col("is_flat") == F.col("has_flat")).drop("has_flat")


def read_bundles(spark: SparkSession, folder: str, message_rule: bool = True) -> DataFrame:
    """The long table of a folder's *.json files; a file's name is its locale."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return flatten_bundles(files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("locale"), F.col("value").alias("body")), message_rule)


def annotated(text):
    """(text, offsets) of a sentence whose words are divided by |, as columns."""
    parts = F.split(text, r"\|")
    ends = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out")))["out"]
    return F.array_join(parts, "").alias("text"), F.slice(ends, F.lit(1), F.size(ends) - 1).alias("offsets")
