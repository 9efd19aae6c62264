"""Revisions by keyed state, against a plain loop, over restarts."""

import random

from pyspark.sql import functions as F

from lontar.streaming.revisions import PROVIDER, revision_stream, state_on_disk

SCHEMA = "id long, key string, locale string, register string, value string, user string, source string, at timestamp"


def test_revisions_as_state(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, f"k{draw.randrange(9)}", draw.choice(["th", "vi"]), "neutral", draw.choice([None, "", f"v{i}"]), "u", draw.choice(["human", "ai", None])) for i in range(300)]
    edits = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumn("at", F.timestamp_seconds(F.col("id") / 2 - F.col("id") / 2 % 1))
    values = spark.createDataFrame([("k1", "th", "neutral", "old"), ("k2", "vi", "neutral", None), ("never", "vi", "neutral", "x")], "key string, locale string, register string, value string")
    regulated = spark.createDataFrame([("k3",), ("k3",)], "key string")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    setting = spark.conf.get(PROVIDER, None)

    def go():
        stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 1).parquet(source)
        with state_on_disk(spark):
            query = revision_stream(stream, values, regulated).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
            query.awaitTermination()
        assert spark.conf.get(PROVIDER, None) == setting

    for low, high in ((0, 80), (80, 200), (200, 300)):  # each time, the stream starts again where it was
        edits.where((F.col("id") >= low) & (F.col("id") < high)).coalesce(1).write.mode("append").parquet(source)
        go()
    go()  # nothing new
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("id", "key", "locale", F.coalesce("before", F.lit("-")), F.coalesce("after", F.lit("-"))).collect())

    held, want = {(r["key"], r["locale"]): r["value"] for r in values.collect()}, []
    for i, key, locale, _, value, _, source_of in rows:
        if key == "k3" and source_of == "ai":
            continue
        before = held.get((key, locale))
        want.append((i, key, locale, "-" if before is None else before, "-" if value is None else value))
        held[key, locale] = value
    assert got == want
