"""Search over tables of texts by an inverted index of the grams of their search keys.

At each place of a key begins one gram of GRAM letters (at its end, filled up with U+0000). A query meets the texts that
have its rarest gram, and only those are verified; a query shorter than a gram meets the grams that begin with it. So
the work goes with what the rarest grams bring up, not with queries times texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scripts import to_search_key

GRAM = 3
#: Fills up the last grams of a key.
END = "\0"


def keyed(texts: DataFrame) -> DataFrame:
    """(id, locale, key) of texts (id, text, locale) that have a key: the text folded as its locale asks."""
    key = to_search_key(F.col("text"), F.col("locale"))
    return texts.select("id", "locale", key.alias("key")).where("key != ''")


def indexed(keys: DataFrame, gram: int = GRAM) -> DataFrame:
    """(locale, gram, id): each gram of each key once. What a table is stored as, to be searched again and again."""
    filled = F.concat("key", F.lit(END * (gram - 1)))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substr(filled, i, F.lit(gram))))
    return keys.select("locale", "id", F.explode(grams).alias("gram"))


def searched(queries: DataFrame, texts: DataFrame, index: DataFrame | None = None, gram: int = GRAM) -> DataFrame:
    """(query_id, id) for each of queries (query_id, text, locale) and each of texts (id, text, locale) of its locale that it finds.

    A query finds a text if its key is not empty and in the text's. Ids of texts are unique. index: that of the
    texts, if it is there already. Null texts, and queries without a key, find nothing. Keys and grams are shuffled,
    never broadcast: a small file may hold many, and Spark rates them by the file.
    """
    keys = keyed(texts)
    index = indexed(keys, gram) if index is None else index
    asked = queries.select("query_id", "locale", to_search_key(F.col("text"), F.col("locale")).alias("query")).where("query != ''")
    long, short = asked.where(F.length("query") >= gram), asked.where(F.length("query") < gram)
    counts = index.groupBy("locale", "gram").agg(F.count("*").alias("n"))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("query") - (gram - 1)), lambda i: F.substr(F.col("query"), i, F.lit(gram))))
    grams = long.select("query_id", "locale", "query", F.explode(own).alias("gram"))
    rated = grams.join(counts.hint("merge"), ["locale", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("query_id", "locale", "query").agg(F.min(F.struct("n", "gram")).alias("best")).where("best.n > 0")
    met = index.hint("merge").join(rarest.select("query_id", "locale", "query", F.col("best.gram").alias("gram")), ["locale", "gram"])
    begun = short.select("query_id", "locale", "query", F.length("query").alias("size"))
    heads = index.select("locale", "id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(gram - 1)), lambda s: F.left("gram", s))).alias("query")).where(~F.contains("query", F.lit(END))).distinct()
    shorts = heads.hint("merge").join(begun, ["locale", "query"]).select("query_id", "id")
    found = met.select("query_id", "id", "query").join(keys.select("id", "key").hint("merge"), "id").where(F.contains("key", "query"))
    return found.select("query_id", "id").unionByName(shorts)
