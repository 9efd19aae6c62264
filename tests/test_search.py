"""Search by grams against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lontar.functions.scripts import search_matches
from lontar.operators import search


@pytest.mark.parametrize("gram", [2, 3])
def test_against_all_pairs(spark, gram):
    rng = random.Random(gram)
    letters = "abcđéỗ ABน้ำก၁1Й"
    made = lambda least, most: "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
    texts = [(i, made(0, 12), rng.choice(["vi", "th"])) for i in range(300)] + [(900, None, "vi"), (901, "ေက်ာင္း", "my"), (902, "aaaa aaaa", "vi")]
    queries = [(i, made(0, 4), rng.choice(["vi", "th"])) for i in range(150)] + [(900, None, "vi"), (901, "ကျောင်း", "my"), (902, "aaaaa", "vi"), (903, " ", "vi"), (904, "zzz", "vi")]
    a = spark.createDataFrame(queries, "query_id int, text string, locale string")
    b = spark.createDataFrame(texts, "id int, text string, locale string")
    got = search.searched(a, b, gram=gram)
    pairs = a.alias("a").join(b.alias("b"), F.col("a.locale") == F.col("b.locale")).where(search_matches(F.col("a.text"), F.col("b.text"), F.col("a.locale"))).select("query_id", "id")
    want = sorted(map(tuple, pairs.collect()))
    assert sorted(map(tuple, got.collect())) == want and (901, 901) in want and len(want) > 300
    stored = search.indexed(search.keyed(b), gram)
    assert sorted(map(tuple, search.searched(a, b, stored, gram).collect())) == want
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert search.searched(a, b.limit(0)).collect() == [] and search.searched(a.limit(0), b).collect() == []
