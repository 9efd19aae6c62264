"""Near-duplicate documents by BagMinHash bands and exact multiset overlap.

A text is the multiset of its runs of five words (split at white space, letters as they are). Two
texts are linked if the sum of the smaller counts is at least 0.8 of the sum of the larger ones.

1. Equal texts collapse to their smallest doc_id by a pre-aggregated hash of the text.
2. BagMinHash signs each text: weights are discretised at the integers, cut into the dyadic blocks
   (0,1], (1,2], (2,4], ... Each (shingle, block) is the root of its own hierarchy of Poisson
   processes. A process is known by its first point; it splits into halves, of which one has that
   point and the other a later one of its own, and a half beyond the shingle's count is dropped.
   Processes of a single level make their points in order of time, each on a random component.
   All stop where they pass the largest value of the signature, so that a long text takes little
   more than a point per shingle.
3. Bands of components are joined; each member of a band's bucket links to the bucket's smallest
   doc_id. Components of these links are the candidate groups: any two texts that share a band are
   in the same one.
4. Texts that share a band and are not joined yet are held against each other, by exact overlap of the
   multisets: that is the one rule, whatever the size of their group. Groups over a bound of size are cut
   into blocks, contract block by block, and then compare what is still apart in pairs of blocks: memory is
   bounded and no link between classes is lost. Groups of very many blocks that are still apart (chains
   over passages that many texts share) are taken apart into their buckets first, which only spares pairs
   without a common band. Output is a star for each class and task, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import spread
from .cluster import cut, met, prepare
from .graph import components
from .words import GOLDEN, bag, mix

WIDTH, THRESHOLD = 5, 0.8
#: 40 bands of 6: a pair at 0.8 shares no band in 5 of a million cases.
BANDS, ROWS = 40, 6
#: A task's block holds about so many texts and so many shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 400, 400_000
#: Groups of more blocks than that are compared by buckets, of which a text is in at most BANDS: the same pairs in fewer blocks.
MOST_BLOCKS = BANDS
#: Texts are signed together until they have so many shingles.
CHUNK = 150_000


def _gap(r: np.ndarray, rate) -> np.ndarray:
    """How long a Poisson process of that rate waits for its next point."""
    return -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate


def _part(r: np.ndarray, size: int) -> np.ndarray:
    """The component that a point falls on."""
    return ((mix(r ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class _Signing:
    """Signatures in the making: the earliest point of each component, and the latest of those for each text."""

    def __init__(self, texts: int, size: int):
        self.sig, self.size, self.limit = np.full((texts, size), np.inf), size, np.full(texts, np.inf)

    def take(self, owner: np.ndarray, part: np.ndarray, time: np.ndarray) -> None:
        np.minimum.at(self.sig.reshape(-1), owner * self.size + part, time)
        touched = np.unique(owner)
        self.limit[touched] = self.sig[touched].max(axis=1)

    def run(self, node: np.ndarray, owner: np.ndarray, time: np.ndarray) -> None:
        """Points of processes of one level, in order of time after the given one, until they come too late to matter."""
        made, active = 0, np.flatnonzero(time < self.limit[owner])
        time = time.copy()
        while len(active):
            k = int(np.clip(60_000 // len(active), 1, 256))
            r = mix(node[active][:, None] + np.arange(made + 1, made + k + 1, dtype=np.uint64)[None, :] * GOLDEN)
            t = _gap(r, float(self.size))
            t[:, 0] += time[active]
            t = np.cumsum(t, axis=1)
            own = np.broadcast_to(owner[active][:, None], t.shape)
            ok = t < self.limit[own]
            self.take(own[ok], _part(r[ok], self.size), t[ok])
            time[active] = t[:, -1]
            made += k
            active = active[time[active] < self.limit[owner[active]]]

    def split(self, node: np.ndarray, owner: np.ndarray, count: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        """Processes over the levels (low, low + width], by their first point, halved down to single levels.

        The first point belongs to one half, the other's first one comes later; a half beyond the count is dropped,
        and so is what comes too late.
        """
        r = mix(node)
        time, part = _gap(r, width * float(self.size)), _part(r, self.size)
        while len(node):
            alive = time < self.limit[owner]
            node, owner, count, low, width, time, part = (x[alive] for x in (node, owner, count, low, width, time, part))
            single = width == 1
            if single.any():
                self.take(owner[single], part[single], time[single])
                self.run(node[single], owner[single], time[single])
            node, owner, count, low, width, time, part = (x[~single] for x in (node, owner, count, low, width, time, part))
            half, right = width // 2, mix(node ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(63)
            halves = []
            for side in (0, 1):
                own = mix(node + np.full(1, side + 2, np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
                r, first, base = mix(own), right == side, low + side * half
                t = np.where(first, time, time + _gap(r, half * float(self.size)))
                held = base < count
                halves.append(tuple(x[held] for x in (own, owner, count, base, half, t, np.where(first, part, _part(r, self.size)))))
            node, owner, count, low, width, time, part = (np.concatenate(x) for x in zip(*halves, strict=True))


def sign(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash signatures: a row of size points in time for each (shingles, counts); no shingles: infinite."""
    signing = _Signing(len(bags), size)
    if not bags or not sum(len(s) for s, _ in bags):
        return signing.sig
    shingle = np.concatenate([s for s, _ in bags])
    count = np.concatenate([c for _, c in bags]).astype(np.int64)
    owner = np.repeat(np.arange(len(bags)), [len(s) for s, _ in bags])
    low, width = 0, 1
    while len(shingle):
        root = mix(shingle + np.full(1, low, np.uint64) * GOLDEN)
        if width == 1:
            signing.run(root, owner, np.zeros(len(root)))
        else:
            signing.split(root, owner, count, np.full(len(root), low), np.full(len(root), width))
        low, width = low + width, max(1, low + width)
        more = count > low
        shingle, count, owner = shingle[more], count[more], owner[more]
    return signing.sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band. Times lose their last bits, which libraries may round differently."""
    v = ((sig.view(np.uint64) + np.uint64(1 << 11)) >> np.uint64(12)).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(sig), bands))
    for j in range(rows):
        key = mix(key + v[:, :, j])
    return key.view(np.int64)


def _signer(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < len(batch):
                bags, held, start = [], 0, at
                while at < len(batch) and held < CHUNK and at - start < 1024:
                    bags.append(bag(batch.column(1)[at].as_py(), width))
                    held += len(bags[-1][0])
                    at += 1
                keys = band_keys(sign(bags, bands * rows), bands, rows)
                total = pa.array([int(c.sum()) for _, c in bags], pa.int64())
                offsets = pa.array(np.concatenate([[0], np.cumsum([bands if len(s) else 0 for s, _ in bags])]).astype(np.int32))
                filled = np.asarray([len(s) > 0 for s, _ in bags])
                values = pa.array(np.ascontiguousarray(keys[filled]).reshape(-1))
                rest = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(2), rest.column(3), total, pa.ListArray.from_arrays(offsets, values)], ["id", "h1", "h2", "n", "bands"])

    return run


class Block:
    """Bags of a block with shingles numbered, so that overlaps are sums over arrays."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]]):
        self.total = np.asarray([int(c.sum()) for _, c in bags], np.int64)
        self.length = np.asarray([len(s) for s, _ in bags], np.int64)
        names = np.concatenate([s for s, _ in bags]) if bags else np.zeros(0, np.uint64)
        known, self.code = np.unique(names, return_inverse=True)
        self.count = np.concatenate([c for _, c in bags]).astype(np.int64) if bags else np.zeros(0, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.mark = np.zeros(len(known), np.int64)

    def overlap(self, one: int, others: np.ndarray) -> np.ndarray:
        """Sum of the smaller counts of one and each of the others."""
        a = slice(self.start[one], self.start[one + 1])
        self.mark[self.code[a]] = self.count[a]
        n = self.length[others]
        ends = np.cumsum(n)
        flat = np.arange(ends[-1]) + np.repeat(self.start[others] - (ends - n), n)
        out = np.add.reduceat(np.minimum(self.mark[self.code[flat]], self.count[flat]), ends - n)
        self.mark[self.code[a]] = 0
        return out


def spanning(bags: list[tuple[np.ndarray, np.ndarray]], threshold: float, classes: np.ndarray | None = None, keys: list[np.ndarray] | None = None) -> np.ndarray:
    """A label for each bag; those joined by links with similarity threshold or more have the same.

    classes: what is joined already. Only bags of different labels are compared, each pair at most once; of bags
    with keys, only those with one in common.
    """
    block = Block(bags)
    shared = None if keys is None else Block([(k, np.ones(len(k), np.int64)) for k in keys])
    label = np.arange(len(bags)) if classes is None else np.unique(classes, return_inverse=True)[1]
    for one in range(len(bags) - 1):
        if not block.length[one]:
            continue
        rest = slice(one + 1, None)
        a, b = block.total[one], block.total[rest]
        near = (label[rest] != label[one]) & (block.length[rest] > 0) & (np.minimum(a, b) >= threshold * np.maximum(a, b) * (1 - 1e-12))
        others = np.flatnonzero(near) + one + 1
        if shared is not None and len(others):
            others = others[shared.overlap(one, others) > 0]
        if not len(others):
            continue
        both = block.overlap(one, others)
        linked = others[both >= threshold * (a + block.total[others] - both) * (1 - 1e-12)]
        if len(linked):
            label[np.isin(label, label[linked])] = label[one]
    return label


def _verifier(width: int, threshold: float):
    """(u, v) from every text of a block, or its class if it has one, to the smallest joined with it."""

    def run(group):
        import pandas as pd

        group = group.sort_values("id", kind="stable")
        keys = [np.asarray(k, np.int64).view(np.uint64) for k in group["keys"]]
        label = spanning([bag(t, width) for t in group["text"]], threshold, group["class"].to_numpy(), keys)
        node = group["class"].to_numpy(np.int64)
        low = pd.Series(node).groupby(label).transform("min").to_numpy()
        out = pd.DataFrame({"u": node, "v": low})
        return out[out["u"] != out["v"]].drop_duplicates()

    return run


def _verified(blocks: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links found within each block of (id, class, component, block)."""
    rows = blocks.select("id", "class", "component", "block").join(texts, "id")
    return cut(rows.groupBy("component", "block").applyInPandas(_verifier(width, threshold), "u long, v long"))


def _weight() -> F.Column:
    """How many blocks rows with n shingles each fill."""
    return F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("n") / BLOCK_SHINGLES)


def _dealt(nodes: DataFrame, level: int) -> DataFrame:
    """nodes (id, component, n) with the number of blocks of their component and a block of their own."""
    parts = nodes.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(_weight())).cast("int").alias("parts"))
    return cut(met(nodes, parts, "component").withColumn("block", F.expr(f"pmod(xxhash64(id, {level}), parts)")).withColumn("class", F.col("id")))


def _in_pairs(rows: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links between texts of different classes, for rows (id, class, component, n): each component in pairs of blocks.

    Large classes have blocks of their own, small ones share blocks; a class needs no block paired with its own.
    """
    sizes = rows.groupBy("component", "class").agg(_weight().alias("weight"))
    sizes = sizes.withColumn("group", F.when(F.col("weight") >= 0.5, F.col("class")))
    grouped = sizes.groupBy("component", "group").agg(F.greatest(F.lit(1), F.ceil(F.sum("weight"))).cast("int").alias("parts"))
    classes = sizes.alias("s").join(grouped.alias("g"), (F.col("s.component") == F.col("g.component")) & F.col("s.group").eqNullSafe(F.col("g.group"))).select("s.component", "s.class", "s.group", "g.parts")
    rows = met(rows, classes, "component", "class").select("id", "class", "component", F.xxhash64(F.coalesce("group", F.lit(-1)), F.expr("pmod(xxhash64(id, 77), parts)")).alias("own"), "group")
    rows = cut(rows)
    blocks = rows.select("component", "own", "group").distinct()
    other = blocks.select("component", F.col("own").alias("own2"), F.col("group").alias("group2"))
    pairs = blocks.join(other, "component").where((F.col("own") <= F.col("own2")) & ~F.coalesce(F.col("group") == F.col("group2"), F.lit(False)))
    pairs = pairs.select("component", "own", "own2", F.xxhash64("own", "own2").alias("block"))
    ends = pairs.select("component", "own", "block").unionByName(pairs.where("own < own2").select("component", F.col("own2").alias("own"), "block"))
    return _verified(rows.join(ends, ["component", "own"]), texts, width, threshold)


def _by_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (id, class, component, n) with buckets (id, key) for components; those of one class go, and of equal buckets all but one."""
    held = cut(rows.drop("component").join(buckets, "id"))
    every = held.groupBy("key").agg(F.count("*").alias("count"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("marks"), F.min("class").alias("low"), F.max("class").alias("high"))
    chosen = every.where("low < high").groupBy("count", "marks", "low", "high").agg(F.min("key").alias("key")).select("key")
    return cut(met(held, chosen, "key").select("id", "class", F.col("key").alias("component"), "n"))


def _joined(nodes: DataFrame, texts: DataFrame, buckets: DataFrame, width: int, threshold: float) -> DataFrame:
    """(node, component): classes of links among nodes (id, component, n), each component for itself.

    A component that fits a block is settled by it. A larger one first contracts: its blocks are
    settled side by side, one text of each class goes on, and again, until that no longer helps. So
    a large group of near copies shrinks to few texts in linear work. Only where classes remain apart
    are texts of different classes compared, in pairs of blocks of bounded size: blocks of the
    component or, if it has very many, of its buckets.
    """
    first = dealt = _dealt(nodes, 0)
    links = [_verified(dealt, texts, width, threshold)]
    large = first.where("parts > 1")
    if large.isEmpty():
        return components(links[0])
    level, count = 0, large.count()
    while count:
        gone = links[-1].select(F.col("u").alias("id")).distinct()
        left = cut(dealt.where("parts > 1").select("id", "component", "n").join(gone, "id", "left_anti"))
        level, before, count = level + 1, count, left.count()
        if count > 0.7 * before:
            break
        dealt = _dealt(left, level)
        links.append(_verified(dealt, texts, width, threshold))
    every = reduce(DataFrame.unionByName, links)
    classes = components(every)
    held = cut(large.drop("class", "block").join(classes.select(F.col("node").alias("id"), F.col("component").alias("class")), "id", "left").withColumn("class", F.coalesce("class", "id")))
    apart = held.groupBy("component").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("component")
    rows = cut(met(held, apart, "component"))
    across = [_in_pairs(rows.where(F.col("parts") <= MOST_BLOCKS).select("id", "class", "component", "n"), texts, width, threshold)]
    many = rows.where(F.col("parts") > MOST_BLOCKS)
    if not many.isEmpty():
        across.append(_in_pairs(_by_bucket(many.select("id", "class", "component", "n"), buckets), texts, width, threshold))
    return components(reduce(DataFrame.unionByName, across, every))


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, component_id, kept) for each row of docs (doc_id, text, ...).

    component_id is the smallest doc_id reached by links, kept says that it is the row's own. Null
    texts are empty. Equal texts, empty ones too, are linked; else a text without words links with
    nothing, and one of fewer than five words is one shingle. Rows with one doc_id are one document.
    Rows without a doc_id are in no class: component_id is null, kept true. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = named.where("id is not null")
    signed = cut(known.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(11), "text").alias("h2")).mapInArrow(_signer(width, bands, rows), "id long, h1 long, h2 long, n long, bands array<long>"))
    first = signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    member = met(signed, first.drop("n"), "h1", "h2", counts=first)
    member = cut(member.select("id", "rep", "n", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")))

    bucket = member.where("bands is not null").select("id", F.explode("bands").alias("key"))
    lead = cut(bucket.groupBy("key").agg(F.min("id").alias("v"), F.max("id").alias("top"), F.count("*").alias("n")).where("v < top"))
    held = cut(met(bucket, lead.select("key", "v"), "key", counts=lead).select("id", "key", "v"))
    group = components(held.where("id > v").select(F.col("id").alias("u"), "v").distinct())

    nodes = cut(member.where("id = rep").select("id", "n").distinct().join(group, F.col("id") == F.col("node")).select("id", "component", "n"))
    # Texts of the candidates go out of all texts once; what follows shuffles these alone. Repeated rows count once.
    texts = known.join(nodes.select("id").distinct(), "id", "left_semi").withColumn("same", F.xxhash64("text"))
    keys = held.groupBy("id").agg(F.collect_set("key").alias("keys"))  # BANDS at most of each text, those that another has
    texts = cut(texts.dropDuplicates(["id", "same"]).select("id", "text").join(keys, "id"))
    classes = _joined(nodes, texts, bucket.distinct(), width, threshold)

    named_classes = classes.select(F.col("node").alias("rep"), "component")
    out = met(member.select("id", "rep"), named_classes, "rep", how="left").select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.unionByName(named.where("id is null").select(F.col("id").alias("doc_id"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    """Classes of near duplicates among all documents."""
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
