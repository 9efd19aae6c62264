"""What every operator here shares: where lineage is cut, how much a Python worker gets at once, names, equal rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Rows that a Python worker gets at once.
RECORDS = 1000
#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Equal rows are dealt out in lots of so many.
LOT = 10_000


def prepare(spark: SparkSession) -> SparkSession:
    """Give the session a checkpoint folder if the cluster names none, and ship this package once.

    Without a named folder, one beside the warehouse is taken, which a cluster shares; a temporary one serves a
    single machine only.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            alone = sc.master.startswith("local")
            named = tempfile.mkdtemp(prefix="checkpoints-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        sc.setCheckpointDir(named)
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > RECORDS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORDS))  # texts can be long
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so a lost executor costs no recomputation.

    The files of its own shuffles go as soon as it stands there, so that disks hold those of one step and not of all.
    """
    spark = prepare(df.sparkSession)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, which takes the setting and is run once
    finally:
        spark.conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def unused(columns: Iterable[str], name: str) -> str:
    """The name, or the first of name_2, name_3, ... that no column has, in whatever case."""
    taken, out, n = {c.lower() for c in columns}, name, 1
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def told_apart(df: DataFrame, name: str = "occurrence") -> DataFrame:
    """df with a number from 0 in each set of equal rows.

    Equal rows are counted before the shuffle and dealt out in lots, so that no task gets all of a large set; the
    numbers don't depend on how rows were partitioned.
    """
    own = df.columns
    counts = df.groupBy(*own).agg(F.count("*").alias("__n"))
    lots = counts.select("*", F.explode(F.expr(f"sequence(0L, (__n - 1) div {LOT})")).alias("__lot")).repartition(*own, "__lot")
    return lots.select(*own, F.explode(F.expr(f"sequence(__lot * {LOT}, least((__lot + 1) * {LOT}, __n) - 1)")).alias(name))


#: Keys are hot if they are among so many of the most frequent ones and have more than WARM rows; they are met in SALTS parts.
HOT, WARM, SALTS = 1000, 500, 64


def met(rows: DataFrame, table: DataFrame, *keys: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with table, which has one row for each value of the keys.

    Rows of a hot key are salted and its row of the table is copied to each salt, so that no task meets them all.
    The driver learns hashes of at most HOT hot keys; any other key has less than a HOT-th of the rows.
    counts: how many rows each key has (`n`), if that is known.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    mark = F.xxhash64(*keys)
    hot = [r[0] for r in counts.where(F.col("n") > WARM).orderBy(F.desc("n")).limit(HOT).select(mark).collect()]  # HOT at most
    out = [*rows.columns, *(c for c in table.columns if c not in keys)]
    if not hot:
        return rows.join(table, list(keys), how).select(*out)
    salt = F.when(mark.isin(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(mark.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("__salt", salt).join(table.withColumn("__salt", F.explode(salts)), [*keys, "__salt"], how).select(*out)
