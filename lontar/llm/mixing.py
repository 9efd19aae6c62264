"""Mixing sources to target weights by pivotal dependent rounding. DataFrame operations only.

A source whose target is f times its words takes each of its documents floor(f) times, and once more
with the rest p of f. Which ones is settled by pairs: of two documents with fractions left, words
move from one to the other, in a random direction that keeps each one's expectation, until one of
them is whole. Pairs keep the sum of words, so a source's words come within one document of its
target. Blocks of bounded size are settled side by side, each leaves one document with a fraction,
and those meet in the blocks of the next level of a reduction tree, until one is left, which is drawn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut, prepare, told_apart, unused

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 200
SEED = 20_011
#: Sources are broadcast up to so many; more are joined by a shuffle.
FEW = 50_000


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with their place from 0 in order of code points, null last; in ranges, never in one task."""
    order = F.col("source").asc_nulls_last()
    parts = cut(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition, no more
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = parts.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    return own.join(F.broadcast(before), "part").withColumn("place", F.col("own") - 1 + F.col("before")).drop("part", "own", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above most times its size.

    What is left of all words after full sources is shared by the others by weight; those that would
    get more than their bound are full, too, and so on until none is. Each round is one sum over the sources.
    """
    share = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    rows = cut(ranked(sources).select("source", "source_size", share.alias("w"), (most * F.col("source_size")).cast("double").alias("cap")))
    full = F.lit(False)
    every = rows.agg(F.sum("source_size")).first()[0] or 0
    number = -1
    while True:
        n, held, loose = rows.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("w")))).first()
        level = (every - held) / loose if loose else 0.0
        if n == number:
            break
        number, full = n, F.col("cap") < F.col("w") * F.lit(level)
    # level is that of the same full sources that were counted: they stay full as it rises
    return rows.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def _settle(level: int, kind: str) -> F.Column:
    """Fold over the documents of a block: (left: the one with a fraction, done: documents and copies)."""
    a, b = "acc.one", "x"
    up = f"least((1 - {a}.p) * {a}.size, {b}.p * {b}.size)"  # words that can move to the left one
    down = f"least({a}.p * {a}.size, (1 - {b}.p) * {b}.size)"
    draw = f"pmod(xxhash64({a}.mark, {b}.mark, {SEED + level}), 1000003) / 1000003D"
    to_left = f"({draw} * ({up} + {down}) < {down})"
    done = lambda one, more: f"struct({one}.row, {one}.size, {one}.source_size, {one}.target, {one}.base + {more} as copies)"
    rest = lambda one, p: f"struct({one}.row, {one}.size, {one}.source_size, {one}.target, {one}.base, {p} as p, {one}.mark)"
    step = lambda left, out: f"struct({left} as one, array_append(acc.done, {out}) as done)"
    return F.expr(f"""aggregate(slice(items, 2, size(items)),
      struct(items[0] as one, cast(array() as array<struct<row: {kind}, size: bigint, source_size: bigint, target: double, copies: int>>) as done),
      (acc, x) -> CASE
        WHEN {to_left} AND (1 - {a}.p) * {a}.size <= {b}.p * {b}.size
          THEN {step(rest(b, f"({b}.p * {b}.size - (1 - {a}.p) * {a}.size) / {b}.size"), done(a, 1))}
        WHEN {to_left} THEN {step(rest(a, f"({a}.p * {a}.size + {b}.p * {b}.size) / {a}.size"), done(b, 0))}
        WHEN (1 - {b}.p) * {b}.size <= {a}.p * {a}.size
          THEN {step(rest(a, f"({a}.p * {a}.size - (1 - {b}.p) * {b}.size) / {a}.size"), done(b, 1))}
        ELSE {step(rest(b, f"({a}.p * {a}.size + {b}.p * {b}.size) / {b}.size"), done(a, 0))}
      END)""")


def _drawn(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(row, size, source, source_size, target, copies) for each row of sized (row: a struct, source, size). Equal rows are drawn one by one."""
    sized, kind = cut(told_apart(sized)), dict(sized.dtypes)["row"]
    sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    few = sources.count() <= FEW
    named = sources.select(F.col("source").alias("of"), "source_size", "target")
    rows = sized.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("of")))
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(times).cast("int")).withColumn("p", times - F.floor(times))
    whole = (F.col("p") <= 1e-12) | (F.col("size") == 0)
    out = [rows.where(whole).select("row", "size", "source", "source_size", "target", F.col("base").alias("copies"))]

    item = ["row", "size", "source_size", "target", "base", "p", "mark"]
    left = rows.where(~whole).withColumn("mark", F.xxhash64("row.*", "size", "occurrence", F.lit(SEED))).select("source", *item)
    open_by = cut(left.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n")))
    most_open = open_by.agg(F.max("n")).first()[0] or 0
    level = 0
    while most_open:
        parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(BLOCK) ** (level + 1)))).cast("int")
        counted = open_by.select(F.col("of").alias("o"), parts.alias("parts"))
        dealt = left.join(F.broadcast(counted) if few else counted, F.col("source").eqNullSafe(F.col("o"))).withColumn("part", F.pmod(F.xxhash64("mark", F.lit(level)), F.col("parts")))
        blocks = dealt.groupBy("source", "part").agg(F.sort_array(F.collect_list(F.struct("mark", F.struct(*item).alias("item")))).alias("items"))
        settled = cut(blocks.withColumn("items", F.col("items.item")).select("source", _settle(level, kind).alias("s")).select("source", "s.one", "s.done"))
        out.append(settled.select("source", F.inline("done")).select("row", "size", "source", "source_size", "target", "copies"))
        left = settled.select("source", "one.*").select("source", *item)
        last = BLOCK ** (level + 1) >= most_open
        level += 1
        if last:
            one = F.pmod(F.xxhash64("mark", F.lit(SEED - 1)), F.lit(1000003)) / F.lit(1000003.0) < F.col("p")
            out.append(left.select("row", "size", "source", "source_size", "target", (F.col("base") + one.cast("int")).alias("copies")))
            break
    return reduce(DataFrame.unionByName, out)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each row of docs (doc_id, text, source, ...): doc_id, size, source, source_size, target, copies, taken.

    size: words of the text (null: none). Sources in order of code points, null last, have the
    weights in turn. A document is taken copies times, at most `most`; taken is copies times size.
    Documents without words are taken as often as their source's whole part. The draw depends on ids,
    sources and sizes alone, so reruns agree, however rows are partitioned; repeated rows are drawn one by
    one, and so are rows without an id. An empty table gives no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    sized = docs.select(F.struct(F.col("doc_id").cast("long").alias("id")).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    every = _drawn(sized, weights, most)
    return every.select(F.col("row.id").alias("doc_id"), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken.

    Rows are known by two hashes of all their columns (maps left out), so that what is taken of a row doesn't
    depend on the order of rows; equal rows are one row to be taken as often as all of them. Columns of docs
    stay as they are, whatever their names. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    columns = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    h1, h2, copies = (unused(docs.columns, f"__{c}") for c in ("h1", "h2", "copies"))
    rows = docs.withColumns({h1: F.xxhash64(*columns), h2: F.xxhash64(F.lit(SEED), *columns)})
    sized = rows.select(F.struct(F.col(h1).alias("h1"), F.col(h2).alias("h2")).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    plan = _drawn(sized, weights, most).groupBy(F.col("row.h1").alias(h1), F.col("row.h2").alias(h2)).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    taken = rows.dropDuplicates([h1, h2]).join(plan, [h1, h2])
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_pivotal(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents."""
    mix = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")
