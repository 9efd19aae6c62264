"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of c are at most sqrt(2 - 2c) = epsilon apart. Rotated to principal axes
(fitted on a bounded sample), vectors of a label are ordered by their cells of side epsilon on the
leading axes. The order is cut into intervals of bounded size; two intervals are joined only if the
boxes around their leading coordinates are within epsilon. A task joins one pair of intervals
recursively, halving them and leaving out halves whose boxes are too far apart, and compares the rest
exactly. It returns a count for each vector and a star for each class it sees, never the pairs.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, met, prepare
from .graph import components

THRESHOLD = 0.93
#: Leading principal axes that the grid is laid on.
AXES = 6
#: Vectors in an interval of the order.
INTERVAL = 2048
#: Vectors the axes are fitted on. They only decide what is compared with what, never the result.
SAMPLE = 4096
LEAF = 256


def usable(column: str) -> F.Column:
    """Whether the vector has only finite components, and one that is not zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame, column: str, order: str, sample: int) -> np.ndarray:
    """All principal axes, leading first, of a sample drawn by a hash of the id."""
    rows = vectors.select(F.col(column).alias("x"), F.xxhash64(F.col(order), F.lit(3)).alias("h")).orderBy("h").limit(sample).select("x").collect()
    if not rows:
        return np.eye(1)
    most = max(len(r[0]) for r in rows)
    x = np.asarray([r[0] for r in rows if len(r[0]) == most], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(most))[1][:, ::-1]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _gridder(axes: np.ndarray, lead: int, eps: float):
    """Adds the leading coordinates and a sortable key of cells to (id, label, x)."""

    def run(frames):
        for f in frames:
            if not len(f):
                yield f.assign(lead=[], cell=[])[["id", "label", "n", "x", "lead", "cell"]]
                continue
            coords = np.zeros((len(f), lead))
            size = f["x"].map(len).to_numpy()
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                u = _unit(np.asarray(f["x"].iloc[own].tolist(), np.float64))
                turned = u @ axes if d == len(axes) else u
                k = min(lead, turned.shape[1])
                coords[own, :k] = turned[:, :k]
            cells = np.floor((coords + 1) / eps).astype(int)
            yield f.assign(lead=list(coords), cell=["".join(chr(97 + max(0, c)) for c in row) for row in cells])[["id", "label", "n", "x", "lead", "cell"]]

    return run


def _intervals(size: int):
    """Numbers the intervals of a partition that is in order; none holds two labels or more than size rows."""

    def run(frames):
        from pyspark import TaskContext

        number, held, last = TaskContext.get().partitionId() << 32, 0, None
        for f in frames:
            own = np.zeros(len(f), np.int64)
            for i, label in enumerate(f["label"]):
                if held == size or label != last:
                    number, held, last = number + 1, 0, label
                own[i] = number
                held += 1
            yield f.assign(own=own)

    return run


class _Join:
    """Counts and links among the rows of two intervals (or of one with itself)."""

    def __init__(self, x: np.ndarray, lead: np.ndarray, weight: np.ndarray, threshold: float):
        self.x, self.lead, self.weight, self.threshold = x, lead, weight, threshold
        self.u, self.norm = _unit(x), np.sqrt(np.einsum("ij,ij->i", x, x))
        self.far = math.sqrt(2 - 2 * threshold) + 1e-6
        self.links = np.zeros(len(x), np.int64)
        self.parent = np.arange(len(x))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def exact(self, i: int, j: int) -> bool:
        dot = math.fsum(a * b for a, b in zip(self.x[i].tolist(), self.x[j].tolist(), strict=True))
        a, b = (math.sqrt(math.fsum(v * v for v in self.x[k].tolist())) for k in (i, j))
        return dot / (a * b) >= self.threshold

    def leaf(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        c = self.u[a] @ self.u[b].T
        hit = c >= self.threshold
        for i, j in zip(*np.nonzero(np.abs(c - self.threshold) < 1e-12), strict=True):
            hit[i, j] = self.exact(a[i], b[j])
        if same:
            np.fill_diagonal(hit, False)
        np.add.at(self.links, a, hit @ self.weight[b])
        if not same:
            np.add.at(self.links, b, self.weight[a] @ hit)
        for i in np.flatnonzero(hit.any(axis=1)):
            for j in self.unlinked(a[i], b[hit[i]]):
                p, q = sorted((self.root(a[i]), self.root(j)))
                self.parent[q] = p

    def unlinked(self, one: int, others: np.ndarray) -> np.ndarray:
        """Of the others, one for each class that isn't one's class yet."""
        while (up := self.parent[self.parent]).tolist() != self.parent.tolist():
            self.parent = up
        roots, first = np.unique(self.parent[others], return_index=True)
        return others[first[roots != self.parent[one]]]

    def run(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        if not len(a) or not len(b):
            return
        if not same:
            gap = np.maximum(0, np.maximum(self.lead[a].min(0) - self.lead[b].max(0), self.lead[b].min(0) - self.lead[a].max(0)))
            if np.sqrt((gap * gap).sum()) > self.far:
                return
        if max(len(a), len(b)) <= LEAF:
            self.leaf(a, b, same)
            return
        (a1, a2), (b1, b2) = (np.array_split(v, 2) for v in (a, b))
        self.run(a1, b1, same)
        self.run(a2, b2, same)
        self.run(a1, b2, False)
        if not same:
            self.run(a2, b1, False)


def _joiner(threshold: float):
    def run(group):
        import pandas as pd

        out = [pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})]
        size = group["x"].map(len)
        for _, part in group.groupby(size, sort=False):
            part = part.sort_values(["own", "cell", "id"], kind="stable")
            join = _Join(np.asarray(part["x"].tolist(), np.float64), np.asarray(part["lead"].tolist(), np.float64), part["n"].to_numpy(np.int64), threshold)
            first = np.flatnonzero(part["own"].to_numpy() == part["i"].iloc[0])
            second = np.flatnonzero(part["own"].to_numpy() == part["j"].iloc[0])
            same = part["i"].iloc[0] == part["j"].iloc[0]
            join.run(first, second, same)
            ids = part["id"].to_numpy(np.int64)
            roots = np.asarray([join.root(i) for i in range(len(ids))])
            kept = (join.links > 0) | (roots != np.arange(len(ids)))
            out.append(pd.DataFrame({"id": ids[kept], "links": join.links[kept], "to": ids[roots[kept]]}))
        return pd.concat(out)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, interval: int = INTERVAL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label, ...).

    Rows link if their labels are equal and not null and the cosine is threshold or more. A vector
    that is null, zero or has null or non-finite components links with nothing, nor do vectors of
    different lengths. Equal vectors of a label are compared once and counted as often as they occur,
    rows of one vec_id too. A null vec_id has no links, a null component and is kept. An empty table
    gives no rows. Other columns are not read.
    """
    prepare(vectors.sparkSession)
    eps = math.sqrt(2 - 2 * threshold)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    named = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("x"), F.col("label").alias("label"))
    named = named.withColumn("ok", usable("x") & F.col("id").isNotNull() & F.col("label").isNotNull())
    whole = named.where("ok").select("id", "label", "x")
    # Vectors are equal if 128 bits of hashes are; only these are shuffled for it.
    marked = cut(whole.select("id", "label", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(19), "x").alias("h2")))
    sets = marked.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    member = cut(met(marked, sets.withColumnRenamed("n", "copies"), "label", "h1", "h2", counts=sets))
    own = member.where("id = rep").select("id", "label", "h1", "copies").distinct()
    # Of rows of one vec_id and label with unequal vectors each is a vector of its own.
    every = whole.join(own.withColumnRenamed("label", "its"), "id").where("label = its and xxhash64(x) = h1")
    equal = cut(every.dropDuplicates(["id", "label", "h1"]).select("id", "label", F.col("copies").alias("n"), "x"))
    axes = principal_axes(equal, "x", "id", SAMPLE)
    lead = min(AXES, len(axes))
    grid = equal.mapInPandas(_gridder(axes, lead, eps), f"id long, label {dict(named.dtypes)['label']}, n long, x {kind}, lead array<double>, cell string")

    order = ["label", "cell", "id"]
    spots = cut(grid.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_intervals(interval), f"{grid.schema.simpleString()[7:-1].replace(':', ' ')}, own long"))

    axis = [F.col("lead")[k] for k in range(lead)]
    boxes = spots.groupBy("label", "own").agg(*(F.min(c).alias(f"lo{k}") for k, c in enumerate(axis)), *(F.max(c).alias(f"hi{k}") for k, c in enumerate(axis)))
    cells = lambda low, high, more: F.explode(F.sequence(F.floor((low + 1) / eps) - more, F.floor((high + 1) / eps) + more))
    a, b = (boxes.select([F.col(c).alias(f"{name}_{c}") for c in boxes.columns]) for name in "ab")
    for k in range(min(2, lead)):
        a = a.withColumn(f"slab{k}", cells(F.col(f"a_lo{k}"), F.col(f"a_hi{k}"), 1))
        b = b.withColumn(f"slab{k}", cells(F.col(f"b_lo{k}"), F.col(f"b_hi{k}"), 0))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")), 2) for k in range(lead)), F.lit(0.0))
    same = [a[f"slab{k}"] == b[f"slab{k}"] for k in range(min(2, lead))]
    near = a.join(b, reduce(and_, same, F.col("a_label") == F.col("b_label")) & (F.col("a_own") <= F.col("b_own")) & (gap <= (eps + 1e-6) ** 2))
    near = near.select(F.col("a_own").alias("i"), F.col("b_own").alias("j")).distinct()
    ends = near.select("i", "j", F.col("i").alias("own")).unionByName(near.where("i < j").select("i", "j", F.col("j").alias("own")))
    found = cut(spots.join(ends, "own").select("id", "n", "x", "lead", "cell", "own", "i", "j").groupBy("i", "j").applyInPandas(_joiner(threshold), "id long, links long, to long"))

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("id").alias("u"), F.col("to").alias("v")))
    told = equal.select("id").distinct().join(links, "id", "left").join(classes, F.col("id") == F.col("node"), "left")
    told = told.select(F.col("id").alias("rep"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component_id"))
    good = met(member.select("id", "rep", "copies"), told, "rep").select(F.col("id").alias("vec_id"), (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    rest = named.where("not ok").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_epsilon_grid(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION SELECT r.node, p.v FROM reach r JOIN pairs p ON p.u = r.seen
), low AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), n AS (SELECT u, count(*) AS n_links FROM pairs GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.node = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""
