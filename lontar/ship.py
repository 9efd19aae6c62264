"""How this package reaches the executors of a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, "_shipped_package", False):
        archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(PACKAGE.rglob("*.py")):
                z.write(path, f"{PACKAGE.name}/{path.relative_to(PACKAGE)}")
        sc.addPyFile(archive)
        sc._shipped_package = True
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path on storage that all machines share: below the checkpoint folder that the session names."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="work-")
    return f"{named}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows: int | None = None, *keys: str) -> DataFrame:
    """df over all cores, if it comes in fewer partitions than there are, as a small file does; else as it is.

    rows: over so many partitions, too, that each has about so many rows, dealt by keys. This counts the rows of df.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        least = max(least, -(-df.count() // rows))
    return df.repartition(least, *keys) if df.rdd.getNumPartitions() < least else df
