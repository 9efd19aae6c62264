"""Repeated lines, by levelled sorted runs of line hashes.

A run is a table (h1, h2, n, top): for each line key its 128-bit hash, in how many documents it
occurs and the largest doc_id among them, bucketed and sorted by hash. Documents come in batches by a
hash of their id, of a size that grows with the input. Each batch is merge-anti-joined with the runs:
keys that no run has become a run of level 0, and what the batch adds to known keys goes into a list
of updates, which is small, as only repeated keys are in it. As soon as a level has FANIN runs they
are merged into one of the next level. Runs and batches share their buckets, so that no join or merge
among them shuffles. After the last batch updates meet their keys, and the few keys that are in many
documents meet the lines.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..ship import spread
from .cluster import cut, met, prepare, shared_folder, unused

SHORTEST, COMMON = 40, 5
#: Lines in a batch, and batches at most: beyond that batches grow with the input.
BATCH_LINES, BATCHES, FANIN = 25_000, 4, 2
#: Positions of lines that go are broadcast up to so many bytes; more are joined by a shuffle. Keys in many documents, too.
SMALL = 16 << 20
#: Groups that a line in very many documents is counted in.
SALTS = 64
#: The white space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: F.Column) -> F.Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


class Tables:
    """Tables in the shared folder, bucketed and sorted by (h1, h2). Their names are dropped at the end; files stay, as checkpoints do."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(self, df: DataFrame, *more: str) -> DataFrame:
        """df as a table, in folders by more columns."""
        self.names.append(f"runs_{uuid.uuid4().hex}")
        writer = df.write.format("parquet").option("path", shared_folder(self.spark, "runs")).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        (writer.partitionBy(*more) if more else writer).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


class LineRuns:
    """Levels of sorted runs of (h1, h2, n, top), with the updates to their keys."""

    def __init__(self, tables: Tables, fanin: int = FANIN):
        self.tables, self.fanin, self.levels, self.updates = tables, fanin, [[]], []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def new_lines(self, lines: DataFrame) -> DataFrame:
        """Those of lines (h1, h2, ...) that no run has."""
        return reduce(lambda left, run: left.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti"), self.runs(), lines)

    def add(self, batch: DataFrame) -> None:
        """Keys of a batch (h1, h2, n, top): new ones become a run, known ones updates; full levels are merged with it."""
        parts, level = [batch], 0
        if self.runs():
            known = [batch.join(run.select("h1", "h2"), ["h1", "h2"], "left_semi") for run in self.runs()]
            self.updates.append(cut(reduce(DataFrame.unionByName, known)))
            parts = [self.new_lines(batch)]
        while level < len(self.levels) and len(self.levels[level]) + 1 >= self.fanin:
            parts += self.levels[level]
            self.levels[level] = []
            level += 1
        if level == len(self.levels):
            self.levels.append([])
        if self.updates:
            every = reduce(DataFrame.unionByName, parts)
            batch = self.tables.stored(every.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top")))
        self.levels[level].append(batch)

    def common(self, least: int) -> DataFrame:
        """(h1, h2, n, top) of the keys in least or more documents."""
        if not self.updates:
            return reduce(DataFrame.unionByName, self.runs()).where(F.col("n") >= least)
        more = reduce(DataFrame.unionByName, self.updates).groupBy("h1", "h2").agg(F.sum("n").alias("more"), F.max("top").alias("later"))
        more, n = cut(more), F.col("n") + F.coalesce("more", F.lit(0))
        summed = [run.join(more, ["h1", "h2"], "left").select("h1", "h2", n.alias("n"), F.greatest("top", "later").alias("top")) for run in self.runs()]
        return reduce(DataFrame.unionByName, summed).where(F.col("n") >= least)


def _split(docs: DataFrame) -> tuple[F.Column, F.Column, F.Column]:
    """doc_id, null the lowest number; the text, null the empty one; a hash of it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")), text, F.xxhash64(text)


def arrivals(keyed: DataFrame) -> DataFrame:
    """(h1, h2, n, top, batch) of lines (doc, h1, h2, batch): what each batch has of a key, bucketed.

    A line counts once in a document. Lines are counted in salted groups before they meet by key.
    """
    salted = keyed.select("h1", "h2", "doc", "batch", F.pmod(F.xxhash64("doc", F.lit(29)), F.lit(SALTS)).alias("salt"))
    once = salted.repartition("h1", "h2", "salt").distinct()
    counted = once.groupBy("h1", "h2", "salt", "batch").agg(F.count("*").alias("n"), F.max("doc").alias("top"))
    return counted.repartition(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h1", "h2").groupBy("h1", "h2", "batch").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def repeated_positions(docs: DataFrame, shortest: int = SHORTEST, common: int = COMMON, batch_lines: int = BATCH_LINES, batches: int = BATCHES) -> DataFrame:
    """(doc, t, positions): for each document the lines that go. doc: the doc_id, null the lowest number; t: a hash of the text."""
    doc, text, mark = _split(docs)
    split = docs.select(doc.alias("doc"), mark.alias("t"), F.split(text, "\n", -1).alias("parts"))  # a text is hashed once, not for each line
    lines = split.select("doc", "t", F.posexplode("parts").alias("at", "line"))
    long = lines.where(F.length("line") >= shortest)  # a key is no longer than its line
    keyed = long.select("doc", "t", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= shortest)
    keyed = cut(keyed.select("doc", "t", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2")))
    number = max(1, min(batches, -(-keyed.count() // batch_lines)))
    with Tables(docs.sparkSession) as tables:
        every = tables.stored(arrivals(keyed.withColumn("batch", F.pmod(F.xxhash64("doc", F.lit(23)), F.lit(number)).cast("int"))), "batch")
        runs = LineRuns(tables)
        for batch in range(number):
            runs.add(every.where(F.col("batch") == batch).drop("batch"))
        known = cut(runs.common(common).select("h1", "h2", "top"))
    hot = F.broadcast(known) if known.count() * 24 <= SMALL else None
    gone = (keyed.join(hot, ["h1", "h2"]) if hot is not None else met(keyed, known, "h1", "h2")).where("doc != top")
    return gone.groupBy("doc", "t").agg(F.sort_array(F.collect_set("at")).alias("positions"))


@F.arrow_udf(StringType())
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines at some places. Texts that keep all their lines come as nulls."""
    out: list[str | None] = []
    for text, places in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        held = set(places or ())
        out.append(None if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if i not in held))
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST, common: int = COMMON, batch_lines: int = BATCH_LINES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with its text cleaned, and the numbers of its lines and of those dropped beside it.

    A text is split at line feeds; null and empty texts are one empty line. A line's key is the line
    without white space at its ends, A-Z lower-cased. Keys of shortest code points or more that are
    in common or more documents lose their lines everywhere but in the largest doc_id that has them,
    where all stay. Rows with one doc_id are one document to this count, and so are those without a
    doc_id, which is lower than any. An empty table gives no rows. The numbers come in columns named
    by counts, in place of such of docs; all other columns, whatever their names, stay as they are.
    """
    prepare(docs.sparkSession)
    gone = cut(repeated_positions(docs, shortest, common, batch_lines))
    size = gone.agg(F.coalesce(F.sum(F.size("positions") * 8 + 40), F.lit(0))).first()[0]
    doc_at, text_at, mark_at, gone_at = (unused([*docs.columns, *counts], f"__{c}") for c in ("doc", "text", "mark", "gone"))
    doc, text, mark = _split(docs)
    gone = gone.select(F.col("doc").alias(doc_at), F.col("t").alias(mark_at), F.col("positions").alias(gone_at))
    rows = docs.withColumns({doc_at: doc, text_at: text, mark_at: mark}).join(F.broadcast(gone) if size <= SMALL else gone, [doc_at, mark_at], "left")
    whole = F.col(gone_at).isNull()
    cleaned = F.when(whole, F.col(text_at)).otherwise(_without(F.when(~whole, F.col(text_at)), F.col(gone_at)))
    dropped = F.when(F.col(gone_at).isNull(), 0).otherwise(F.size(gone_at))
    lines = F.length(text_at) - F.length(F.replace(F.col(text_at), F.lit("\n"), F.lit(""))) + 1
    own = [cleaned.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns if c not in counts]
    return rows.select(*own, lines.cast("long").alias(counts[0]), dropped.cast("long").alias(counts[1]))


def op6_line_runs(spark, sf_dir: str) -> DataFrame:
    """Digests of all documents without their repeated lines."""
    clean = dedup_lines(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, i AS pos, lines[i] AS line,
         translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), hot AS (
  SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.*, hot.key IS NOT NULL AND l.doc_id <> hot.top AS gone FROM l LEFT JOIN hot ON l.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
