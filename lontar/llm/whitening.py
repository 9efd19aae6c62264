"""Whitening of embeddings by their covariance, summed without loss.

Entries become integers, so sums are exact. Each task holds one pair of arrays, high and low parts of a
double-double: centred outer products are split into a product and its error by error-free transformations
and summed pair by pair, rows first, batches then. Tasks' parts are merged, high and low, in a tree of
groups of FANIN; only the last one reaches the driver, a matrix of as many rows as vectors have entries.
Its eigenvectors are found there by LAPACK's syevd, which makes the matrix tridiagonal and solves that by
divide and conquer. The vectors are then projected where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import prepare

#: What entries are scaled by and shifted by, and how many components are returned.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries from here on are no whole number that a double holds, once scaled.
LARGEST = 2.0**43
#: Parts of tasks that are merged at once, and numbers in an array of products.
FANIN, PRODUCTS = 64, 200_000


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = a * 134217729.0  # 2 ** 27 + 1
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b and its rounding error (Dekker)."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles, errors of both parts kept."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def summed(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of rows of double-doubles, in pairs."""
    while len(high) > 1:
        half = len(high) // 2
        rest = high[2 * half :], low[2 * half :]
        high, low = added(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        high, low = np.concatenate([high, rest[0]]), np.concatenate([low, rest[1]])
    return high[0], low[0]


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    s, e = two_sum(x, -mean[0])
    return two_sum(s, e - mean[1])


def products(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of centred outer products, upper triangles, over rows of x in lots."""
    i, j = np.triu_indices(x.shape[1])
    lot = max(1, PRODUCTS // len(i))
    for at in range(0, len(x), lot):
        high, low = centred(x[at : at + lot], mean)
        p, e = two_product(high[:, i], high[:, j])
        yield summed(*two_sum(p, e + (high[:, i] * low[:, j] + low[:, i] * high[:, j])))


def integers(vectors: np.ndarray) -> np.ndarray:
    """Scaled and shifted entries, as whole doubles."""
    return np.floor(SCALE * vectors) + SHIFT


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def accumulated(vectors: DataFrame, each: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum, over all of vectors (vector), of the arrays that each gives for the rows of a matrix.

    Each task gives one array; groups of FANIN tasks are merged until one is left, in order of tasks, so that
    the result does not depend on which ended first.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            if len(batch):
                for high, low in each(_matrix(batch)):
                    held = (high, low) if held is None else added(*held, high, low)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "high": pa.array([held[0]], pa.list_(pa.float64())), "low": pa.array([held[1]], pa.list_(pa.float64()))})

    def merged(group):
        import pandas as pd

        group = group.sort_values("task")
        high, low = summed(np.stack(group["high"].to_numpy()), np.stack(group["low"].to_numpy()))
        return pd.DataFrame({"task": [group["task"].iloc[0] // FANIN], "high": [high], "low": [low]})

    kind, tasks = "task long, high array<double>, low array<double>", vectors.rdd.getNumPartitions()
    parts = vectors.mapInArrow(part, kind)
    while tasks > 1:
        parts = parts.groupBy((F.col("task") / FANIN).cast("long")).applyInPandas(merged, kind)
        tasks = -(-tasks // FANIN)
    row = parts.first()  # one array
    return np.asarray(row["high"]), np.asarray(row["low"])


def _mean(sums: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    every = [Fraction(h) / n + Fraction(l) / n for h, l in zip(*sums, strict=True)]
    high = np.array([float(m) for m in every])
    return high, np.array([float(m - Fraction(h)) for m, h in zip(every, high, strict=True)])


def covariance(vectors: DataFrame, values: Callable[[np.ndarray], np.ndarray], n: int) -> tuple[tuple, tuple, np.ndarray]:
    """Sums and mean of values(rows), as double-doubles, and their covariance with divisor n."""
    sums = accumulated(vectors, lambda x: iter([summed(v := values(x), np.zeros_like(v))]))
    mean = _mean(sums, n)
    high, low = accumulated(vectors, lambda x: products(values(x), mean))
    size = len(sums[0])
    out = np.zeros((size, size))
    i, j = np.triu_indices(size)
    out[i, j] = out[j, i] = (high + low) / n
    return sums, mean, out


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums of (n x - S) ** 2, exact; None where a long can't hold them."""
    bound = n * int(np.abs(x).max()) + max(map(abs, total))
    if bound < 2**62:
        apart = n * x.astype(np.int64) - np.array(total, np.int64)
        if int(np.abs(apart).max()) ** 2 * x.shape[1] < 2**63:
            return (apart * apart).sum(axis=1).tolist()
        rows = apart.tolist()
    else:
        rows = [[n * int(v) - s for v, s in zip(row, total, strict=True)] for row in x]
    return [d if (d := sum(v * v for v in row)) < 2**63 else None for row in rows]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row of rows (vec_id, embedding, ...) and component.

    Rows without a vector, with an empty one, or one with null or non-finite entries or any of LARGEST or more
    are left out, and so are vectors of another length than most have (the longer one, if as many have it).
    Entries become floor(1024 c) + 100000; all figures are over all rows left, repeated ones and those without a
    vec_id too. Components are ordered by falling eigenvalue, their largest entry positive; those whose
    eigenvalue is no more than rounding (constant entries, fewer rows than entries) have no whitened value and are
    left out. A deviation that a long can't hold is null. An empty table gives no rows. Other columns are not read.
    """
    spark = prepare(rows.sparkSession)
    whole = F.col("embedding").cast("array<double>")
    fine = F.size(whole) > 0
    fine &= F.forall(whole, lambda c: c.isNotNull() & (F.abs(F.coalesce(c, F.lit(0.0))) < LARGEST))  # not of NaN, which is above all
    vectors = rows.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))
    most = vectors.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()  # one row
    if most is None:
        return spark.createDataFrame([], SCHEMA)
    size, n = most["size"], most["n"]
    vectors = vectors.where(F.size("vector") == size)
    only = vectors.select("vector")
    sums, mean, matrix = covariance(only, integers, n)
    total = [int(h) + int(l) for h, l in zip(*sums, strict=True)]
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    found = int((values > size * np.finfo(float).eps * max(values[0], 0.0)).sum())
    kept = min(components, found)
    if not kept:
        return spark.createDataFrame([], SCHEMA)
    axes = axes[:, :kept] * np.where(axes[np.abs(axes[:, :kept]).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    scaled = axes / np.sqrt(values[:kept])
    explained = values[:kept] / np.trace(matrix)

    def projected(vectors: np.ndarray) -> np.ndarray:
        high, low = centred(integers(vectors), mean)
        return high @ scaled + low @ scaled

    error = float(np.abs(covariance(only, projected, n)[2] - np.eye(kept)).max())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            raw = _matrix(batch)
            deviation = np.repeat(np.array(_deviation(integers(raw), n, total), object), kept)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), kept))),
                    "component": pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(batch))),
                    "n": pa.array(np.full(len(batch) * kept, n, np.int64)),
                    "deviation": pa.array(deviation.tolist(), pa.int64()),
                    "whitened": pa.array(projected(raw).reshape(-1)),
                    "explained": pa.array(np.tile(explained, len(batch))),
                    "identity_error": pa.array(np.full(len(batch) * kept, error)),
                }
            )

    return vectors.mapInArrow(each, SCHEMA)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their eight leading components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
