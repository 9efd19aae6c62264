"""Quality grades by cumulative-link regression on hashed text.

Labelled documents have ordered grades: 0 toxic, 1 of low quality, 2 good. One weight vector w
over hashed features and ordered thresholds t0 < t1 give P(grade <= j) = 1 / (1 + exp(w.x - tj)); the
expected grade and the tail P(grade >= 2) follow, and the tail selects. Words can only lower a grade,
so that a long text doesn't outweigh what is wrong with it. The model is fitted on a bounded sample of
labelled documents, whose features come from executors as hashes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import prepare, unused

BITS = 18
MARKS = 1 << 13
GRADES = 3
#: Labelled documents that the model is fitted on, drawn by a hash of their ids.
SAMPLE = 8000
#: A feature needs so many documents of the sample.
RAREST = 3
#: Chi-square that a feature's presence needs with one of the grades.
TELLING = 30.0
KEEP = 0.5
REMEMBERED = 120_000

_edge = re.compile(r"^\W+|\W+$")
_marks = (0.0, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7)


def bucket(name: str) -> int:
    """A word's bucket; what features() says of a text as a whole has the last MARKS buckets to itself."""
    value = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"))
    return value % ((1 << BITS) - MARKS) if name.startswith("w ") else (1 << BITS) - MARKS + value % MARKS


def shape(token: str) -> str:
    """Letters, digits and marks of a token in short; two or more marks at its end count as many."""
    out = []
    for c in token:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else "."
        if out and out[-1] == kind == ".":
            out[-1] = ":"
        elif not out or out[-1].replace(":", ".") != kind:
            out.append(kind)
    return "".join(out[:6])


class _Tokens(dict):
    def __missing__(self, token: str) -> tuple[int, str]:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[token] = (bucket("w " + _edge.sub("", token).lower()), shape(token))
        return value


_tokens = _Tokens()


def _level(share: float) -> int:
    return sum(share > m for m in _marks)


def features(text: str | None) -> np.ndarray:
    """Buckets of the words of a text, of how many of its tokens have each shape, and of how much it repeats itself."""
    counts = Counter((text or "").split())
    n = sum(counts.values())
    if not n:
        return np.asarray([bucket("empty")], np.int32)
    found, shapes = set(), Counter()
    for token, count in counts.items():
        word, form = _tokens[token]
        found.add(word)
        shapes[form] += count
    marks = [f"s {form} {_level(count / n)}" for form, count in shapes.items()]
    marks.append(f"many {min(8, n.bit_length())}")
    marks.append(f"own {min(8, n.bit_length())} {_level(1 - len(counts) / n)}")
    marks.append(f"most {_level(max(counts.values()) / n)}")
    found.update(map(_mark, marks))
    return np.fromiter(found, np.int32, len(found))


def _mark(name: str, known: dict[str, int] = {}) -> int:  # noqa: B006
    if name not in known:
        if len(known) > 50_000:
            known.clear()
        known[name] = bucket("m " + name)
    return known[name]


def telling(flat: np.ndarray, grade: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Which features depend on a grade: by a chi-square of presence and grade, so that chance words of a few documents get no weight."""
    size, n = 1 << BITS, float(len(grades))
    every = np.bincount(flat, minlength=size).astype(np.float64)
    out = np.zeros(size, bool)
    for g in range(GRADES):
        own, of = np.bincount(flat[grade == g], minlength=size).astype(np.float64), float((grades == g).sum())
        spread = every * (n - every) * of * (n - of)
        with np.errstate(divide="ignore", invalid="ignore"):
            out |= np.where(spread > 0, n * (own * n - every * of) ** 2 / spread, 0) >= TELLING
    return out & (every >= RAREST)


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))

    @staticmethod
    def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.3, decay: float = 1e-3, seed: int = 1) -> Ordinal:
        size = 1 << BITS
        lengths = np.asarray([len(r) for r in rows])
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
        names = np.flatnonzero(telling(flat, np.repeat(grades, lengths), grades))
        word = names < size - MARKS
        code = np.full(size, -1, np.int64)
        code[names] = np.arange(len(names))
        ids, owner = code[flat], np.repeat(np.arange(len(rows)), lengths)
        ids, owner = ids[ids >= 0], owner[ids >= 0]
        start = np.searchsorted(owner, np.arange(len(rows) + 1))
        w, t = np.zeros(len(names)), np.arange(GRADES - 1, dtype=np.float64) - (GRADES - 2) / 2 - 1
        gw, gt = np.full(len(names), 1e-6), np.full(GRADES - 1, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                n = start[own + 1] - start[own]
                ends = np.cumsum(n)
                spots = np.arange(ends[-1]) + np.repeat(start[own] - (ends - n), n)
                x, who = ids[spots], np.repeat(np.arange(len(own)), n)
                score = np.bincount(who, w[x], len(own))
                y = grades[own]
                # P(y) = F(up) - F(down) with F the logistic function; fu and fd are its slopes there
                up, down = (1 / (1 + np.exp(-np.clip(np.concatenate([[-np.inf], t, [np.inf]])[y + k] - score, -40, 40))) for k in (1, 0))
                up, down = np.where(y == GRADES - 1, 1.0, up), np.where(y == 0, 0.0, down)
                fu, fd, p = up * (1 - up), down * (1 - down), np.maximum(up - down, 1e-9)
                slope = (fu - fd) / p  # of the loss, as scores rise
                g = np.bincount(x, slope[who], len(w)) / len(own) + decay * w
                gw += g * g
                w -= rate * g / np.sqrt(gw)
                w[word] = np.minimum(w[word], 0)
                d = np.zeros(GRADES - 1)
                np.add.at(d, y[y < GRADES - 1], -(fu / p)[y < GRADES - 1] / len(own))
                np.add.at(d, y[y > 0] - 1, (fd / p)[y > 0] / len(own))
                gt += d * d
                t -= rate * d / np.sqrt(gt)
                t = np.maximum.accumulate(t + np.arange(GRADES - 1) * 1e-3)
        weights = np.zeros(size)
        weights[names] = w
        return Ordinal(weights, t)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    """A model of the labelled documents; None without any. Labels with nulls are not used."""
    spark = prepare(docs.sparkSession)
    good = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    good = good.select("id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2).alias("grade")).groupBy("id").agg(F.min("grade").alias("grade"))
    drawn = good.orderBy(F.xxhash64("id", F.lit(29)), "id").limit(sample).collect()
    if not drawn:
        return None
    chosen = F.broadcast(spark.createDataFrame(drawn, "id long, grade int"))  # sample rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(chosen, "id").select("id", "grade", "text")
    texts = texts.withColumn("mark", F.xxhash64("text")).dropDuplicates(["id", "mark"])  # at most a sample's texts

    def hashed(frames):
        for f in frames:
            yield f.assign(x=[features(t) for t in f["text"]])[["id", "mark", "grade", "x"]]

    # Of the texts of one doc_id, the one with the smallest hash: as many rows as the sample has.
    found = texts.mapInPandas(hashed, "id long, mark long, grade int, x array<int>").groupBy("id").agg(F.min_by(F.struct("grade", "x"), "mark").alias("one"))
    rows = found.select("id", "one.*").orderBy("id").toPandas()
    if not len(rows):
        return None
    return Ordinal.fit([np.asarray(x, np.int32) for x in rows["x"]], rows["grade"].to_numpy(np.int64))


def graded(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, names: tuple[str, str] = ("expected_grade", "p_keep")) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with its expected grade and the chance of the highest beside it, in columns of those names.

    Null and empty texts have the features of no text. Without any labels both are null. Repeated
    rows and null doc_ids are graded like others; an empty table gives no rows. Columns of docs stay as
    they are, whatever their names, except such of the two names, which are replaced.
    """
    spark = prepare(docs.sparkSession)
    own = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in names])
    model = train(docs, labels, sample)
    if model is None:
        return own.withColumns({c: F.lit(None).cast("double") for c in names})
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    @F.pandas_udf("expected double, tail double")
    def grade(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, thresholds = shared.value
        held = Ordinal(weights, thresholds)
        for t in texts:
            tails = held.tails(np.asarray([float(weights[features(x)].sum(dtype=np.float64)) for x in t], np.float64))
            yield pd.DataFrame({"expected": tails.sum(axis=1), "tail": tails[:, -1]})

    both = unused(own.columns, "__grade")
    kept = [F.col(f"`{c}`") for c in own.columns]
    return own.withColumn(both, grade(F.col("text").cast("string"))).select(*kept, F.col(f"`{both}`.expected").alias(names[0]), F.col(f"`{both}`.tail").alias(names[1]))


def op9_ordinal(spark, sf_dir: str) -> DataFrame:
    """Grades of all documents, and which are kept."""
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")]
    return graded(tables[0].select("doc_id", "text"), tables[1]).select("doc_id", "expected_grade", "p_keep", F.coalesce(F.col("p_keep") >= KEEP, F.lit(True)).alias("kept"))
