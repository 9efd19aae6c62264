"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are lengthened by one coordinate that makes all norms equal, so that the largest inner
product is the smallest angle, and turned by rotations learned on a bounded sample (principal axes,
then iterative quantisation); the signs are the code. Codes are split into substrings, each with an
index. By the pigeonhole principle, probing m substrings to radius r retrieves every code within
m (r + 1) - 1 bits. What is retrieved is reranked by the vectors themselves.

How long substrings are, how many, and the radius are learned, too: of those that hold nearly all
true neighbours of the sample, the ones that cost least. As the nearest k of n rows are about the
nearest k s / n of a sample of s (of which a few more are taken), larger tables get tighter radii. A query that finds k or fewer in a
block probes on with larger radii.

Rows are dealt to blocks that fit in memory, each in one block, whose index is built once; the
queries, a twentieth of the rows, pass by each block in a stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut, prepare
from .vectors import usable

K, EVERY = 20, 20
#: Rotations, each of as many bits as a vector has components and one more.
ROTATIONS = 24
#: Lengths of substrings and radii to choose from.
LENGTHS, RADII = (12, 14, 16), (0, 1, 2)
#: Vectors that rotations and substrings are learned on, and the share of true neighbours that must be found.
SAMPLE, HELD = 6000, 0.94
#: What a block may hold, and the rows that are worth a task.
BLOCK_BYTES, BLOCK_ROWS = 64 << 20, 8192
#: Queries that are probed together.
TOGETHER = 64


@dataclass
class Codes:
    """Rotations, and how their bits are cut into substrings and probed."""

    norm: float
    rotations: np.ndarray
    length: int = 16
    parts: int = 1
    radius: int = 0

    @staticmethod
    def learned(sample: np.ndarray, norm: float, rows: int, k: int = K, seed: int = 5) -> Codes:
        """From a sample of `rows` rows, of which the longest has that norm."""
        rng = np.random.default_rng(seed)
        own = Codes(norm or 1.0, np.zeros((sample.shape[1] + 1, 0)))
        long = own.lengthened(sample)
        axes = np.linalg.eigh(long.T @ long)[1][:, ::-1]
        turned = long @ axes
        own.rotations = np.concatenate([axes @ _quantised(turned, rng) for _ in range(ROTATIONS)], axis=1)
        asked = np.arange(0, len(sample), max(1, len(sample) // 400))
        scores = sample[asked] @ sample.T
        scores[np.arange(len(asked)), asked] = -np.inf
        near = min(len(sample) - 1, k, math.ceil(1.5 * k * len(sample) / max(rows, 1)) + 1)
        if near > 0:
            best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
            bits, query = own.bits(long), own.bits(own.asked(sample[asked]))
            true = (bits[best] ^ query[:, None, :]).reshape(-1, bits.shape[1])
            other = (bits[rng.integers(0, len(sample), (len(asked), 60))] ^ query[:, None, :]).reshape(-1, bits.shape[1])
            own.choose(true, other, min(rows, BLOCK_ROWS))
        return own

    def choose(self, true: np.ndarray, other: np.ndarray, rows: int) -> None:
        """The substrings that find enough of true, pairs of a query and a neighbour, for the least probes and rows fetched."""
        best = None
        for length in LENGTHS:
            most = true.shape[1] // length
            if not most:
                continue
            far = [x[:, : most * length].reshape(len(x), most, length).sum(axis=2, dtype=np.int32) for x in (true, other)]
            for radius in RADII:
                found, fetched = (np.maximum.accumulate(f <= radius, axis=1).mean(axis=0) for f in far)
                enough = np.flatnonzero(found >= HELD)
                parts = int(enough[0]) + 1 if len(enough) else most
                cost = (len(_masks(length, radius)) * parts * 0.02 + fetched[parts - 1] * rows * 0.2, -found[parts - 1])
                if best is None or (len(enough) > 0, -cost[0], -cost[1]) > best[0]:
                    best = ((len(enough) > 0, -cost[0], -cost[1]), length, parts, radius)
        if best:
            _, self.length, self.parts, self.radius = best

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(axis=1, keepdims=True)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1)

    def bits(self, long: np.ndarray) -> np.ndarray:
        return long @ self.rotations >= 0

    def values(self, long: np.ndarray) -> np.ndarray:
        """Each code's substrings as numbers."""
        used = self.length * self.parts
        bits = (long @ self.rotations[:, :used] >= 0).reshape(len(long), self.parts, self.length)
        return bits @ (1 << np.arange(self.length))


def _quantised(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """A rotation that brings x near to the corners of a cube."""
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ v).T
    return r


def _masks(length: int, radius: int) -> np.ndarray:
    """All numbers of so many bits with at most radius ones."""
    return np.asarray([sum(1 << b for b in on) for n in range(min(radius, length) + 1) for on in combinations(range(length), n)], np.int64)


class MultiIndex:
    """The rows of a block with an index on each substring of their codes."""

    def __init__(self, codes: Codes, x: np.ndarray):
        self.codes, self.rows = codes, len(x)
        self.tables = []
        for value in codes.values(codes.lengthened(x)).T:
            ends = np.cumsum(np.bincount(value, minlength=1 << codes.length))
            self.tables.append((np.argsort(value, kind="stable").astype(np.int32), np.concatenate([[0], ends])))

    def fetched(self, values: np.ndarray, radius: int) -> np.ndarray:
        """Which rows a query, of those with these substrings, fetches: a row of marks for each."""
        out = np.zeros((len(values), self.rows), bool)
        flat, masks = out.reshape(-1), _masks(self.codes.length, radius)
        base = np.repeat(np.arange(len(values)) * self.rows, len(masks))
        for (order, ends), value in zip(self.tables, values.T, strict=True):
            probe = (value[:, None] ^ masks[None, :]).reshape(-1)
            first, n = ends[probe], ends[probe + 1] - ends[probe]
            stops = np.cumsum(n)
            if stops[-1]:
                flat[order[np.arange(stops[-1]) + np.repeat(first - (stops - n), n)] + np.repeat(base, n)] = True
        return out


class Block:
    """Rows of one length; answers queries."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, codes: Codes | None, k: int):
        self.x, self.ids, self.k = x.astype(np.float64), ids, k
        self.codes = codes if codes is not None and x.shape[1] + 1 == len(codes.rotations) else None
        self.index = MultiIndex(self.codes, self.x) if self.codes is not None else None
        self.scale = np.abs(self.x).max() * np.sqrt(x.shape[1])
        self.rough = (self.x / self.scale).astype(np.float32)
        self.asked = self.seen = 0

    def answer(self, q: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int, float]]:
        q = q.astype(np.float64)
        for at in range(0, len(q), TOGETHER):
            part, names = q[at : at + TOGETHER], own[at : at + TOGETHER]
            if self.index is None:
                marks = np.ones((len(part), len(self.x)), bool)
            else:
                values = self.codes.values(self.codes.asked(part))
                radius, marks = self.codes.radius, self.index.fetched(values, self.codes.radius)
                few = np.flatnonzero(marks.sum(axis=1) <= self.k)
                while len(few) and radius < self.codes.length and self.k < len(self.x):
                    radius += 1
                    marks[few] = self.index.fetched(values[few], radius) if radius < 4 else True
                    few = few[marks[few].sum(axis=1) <= self.k]
            if len(self.x) <= self.k:
                marks[:] = True
            self.asked, self.seen = self.asked + len(part), self.seen + int(marks.sum())
            for query, name, mark in zip(part, names, marks, strict=True):
                yield from ((int(name), v, s) for v, s in self.best(np.flatnonzero(mark), query, name))

    def best(self, rows: np.ndarray, query: np.ndarray, own: int) -> list[tuple[int, float]]:
        rows = rows[self.ids[rows] != own]
        if len(rows) > self.k:  # in single precision first, with room for its error
            unit = query / np.abs(query).max()
            rough = self.rough[rows] @ unit.astype(np.float32)
            bound = np.partition(rough, len(rough) - self.k)[len(rough) - self.k]
            rows = rows[rough >= bound - 1e-5 * np.linalg.norm(unit)]
        score = np.einsum("ij,j->i", self.x[rows], query)
        order = np.lexsort((self.ids[rows], -score))[: self.k]
        return [(int(self.ids[rows[i]]), float(score[i])) for i in order]


def _searcher(codes: Codes | None, k: int):
    """For a partition in order of (size, block, asks): the nearest in each block for its queries."""

    def matrix(column: pa.ListArray, size: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, names, block = None, [], [], None
        for batch in batches:
            size, number, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "block", "asks", "id"))
            breaks = np.flatnonzero((size[1:] != size[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            out: list[tuple[int, int, float]] = []
            for a, b in zip([0, *breaks], [*breaks, len(ids)], strict=True):
                if a == b:
                    continue
                if key != (size[a], number[a]):
                    key, held, names, block = (size[a], number[a]), [], [], None
                x = matrix(batch.column("x").slice(a, b - a), size[a])
                if not asks[a]:
                    held.append(x)
                    names.append(ids[a:b])
                elif held:
                    block = block or Block(np.concatenate(held), np.concatenate(names), codes, k)
                    out += block.answer(x, ids[a:b])
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by every its k nearest of the other rows.

    Nearness is the inner product in double precision, ties go to the smaller vec_id. Rows without a
    vec_id take no part, nor vectors that are null, zero or have null or non-finite components; a
    vector is held against those of its own length only. Repeated rows of a vec_id count once. An
    empty table gives no rows. Other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("x"))
    rows = cut(rows.where(usable("x") & F.col("id").isNotNull()).dropDuplicates(["id", "x"]).withColumn("size", F.size("x")))
    n, norm, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v))), F.max("size")).first()
    sample = [r["x"] for r in rows.select("x", F.xxhash64("id", F.lit(7)).alias("h")).orderBy("h").limit(SAMPLE).collect()]
    codes = None
    if sample:
        sizes = [len(x) for x in sample]
        usual = max(set(sizes), key=sizes.count)
        codes = Codes.learned(np.asarray([x for x in sample if len(x) == usual], np.float64), norm, n, k)
    fits = BLOCK_BYTES // (4 * (longest or 1))
    blocks = max(1, -(-n // fits), min(spark.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS)))
    own = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(blocks)).cast("int")
    cells = rows.select("id", "x", "size", F.lit(False).alias("asks"), own.alias("block"))
    asks = rows.where(F.pmod("id", F.lit(every)) == 0)
    cells = cells.unionByName(asks.select("id", "x", "size", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))
    dealt = cells.repartitionByRange(blocks, "block", "size").sortWithinPartitions("size", "block", "asks", "id")
    found = dealt.mapInArrow(_searcher(codes, k), "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_multi_index(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
