"""Shards by fixed virtual slots.

A record's slot is a hash of its doc_id and text and never changes; an edited text is another record. Bytes are
summed for each slot, and a small versioned map says which shard holds which slot. Rebalancing edits the map: whole slots move from
the fullest shards to the emptiest, so that the sizes of shards come near each other and few records
move. Maps have as many rows as there are slots, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import cut, prepare, told_apart

SLOTS = 8192
SHARDS = 40


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot, in a version."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @staticmethod
    def initial(slots: int, shards: int) -> SlotMap:
        return SlotMap(0, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, sizes: dict[int, int], shards: int | None = None) -> SlotMap:
        """The next version, with near equal sizes over the shards (as many as before unless said).

        Slots move from shards above the mean, the largest that fits first, to the emptiest shard;
        then slots of the fullest and emptiest shards are exchanged or moved while that narrows them.
        """
        shards = shards or self.shards
        owner = [o if o < shards else None for o in self.owner]
        load, held = [0] * shards, [[] for _ in range(shards)]
        for slot, o in enumerate(owner):
            if o is not None:
                load[o] += sizes.get(slot, 0)
                held[o].append(slot)
        mean = sum(sizes.values()) / shards
        loose = [s for s, o in enumerate(owner) if o is None]
        for shard in range(shards):
            for slot in sorted(held[shard], key=lambda s: (-sizes.get(s, 0), s)):
                size = sizes.get(slot, 0)
                if 0 < size <= load[shard] - mean:
                    load[shard] -= size
                    held[shard].remove(slot)
                    loose.append(slot)
        heap = [(load[s], s) for s in range(shards)]
        heapq.heapify(heap)
        for slot in sorted(loose, key=lambda s: (-sizes.get(s, 0), s)):
            _, shard = heapq.heappop(heap)
            load[shard] += sizes.get(slot, 0)
            held[shard].append(slot)
            heapq.heappush(heap, (load[shard], shard))
        for _ in range(2000):
            top, low = max(range(shards), key=lambda s: (load[s], s)), min(range(shards), key=lambda s: (load[s], s))
            gap = load[top] - load[low]
            best = None
            small = sorted((sizes.get(s, 0), s) for s in held[low])
            for slot in held[top]:
                size = sizes.get(slot, 0)
                for other, back in [(0, None), *_near(small, size - gap / 2)]:
                    moved = size - other
                    if 0 < moved < gap and (best is None or abs(gap - 2 * moved) < best[0]):
                        best = (abs(gap - 2 * moved), slot, back, moved)
            if best is None:
                break
            _, slot, back, moved = best
            held[top].remove(slot)
            held[low].append(slot)
            if back is not None:
                held[low].remove(back)
                held[top].append(back)
            load[top] -= moved
            load[low] += moved
        new = [0] * len(self.owner)
        for shard, slots in enumerate(held):
            for slot in slots:
                new[slot] = shard
        return SlotMap(self.version + 1, shards, tuple(new))

    def grown(self, shards: int) -> SlotMap:
        """The next version with more shards: slots move into the new ones only, as many from each as its share."""
        keep = len(self.owner) / shards
        held: dict[int, list[int]] = {s: [] for s in range(self.shards)}
        for slot, o in enumerate(self.owner):
            held[o].append(slot)
        spare = [s for o in sorted(held) for s in held[o][int(keep) + (o < len(self.owner) % shards) :]]
        owner = list(self.owner)
        for i, slot in enumerate(spare):
            owner[slot] = self.shards + i % (shards - self.shards)
        return SlotMap(self.version + 1, shards, tuple(owner))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, s, o) for s, o in enumerate(self.owner)], "version int, shards int, vslot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version beside the earlier ones."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/map_version={self.version}")

    @staticmethod
    def latest(spark: SparkSession, path: str) -> SlotMap | None:
        """The latest version stored under path, if any is."""
        from pyspark.errors import AnalysisException

        try:
            return SlotMap.load(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest unless said."""
        every = spark.read.parquet(f"{path}/map_version=*")
        version = every.agg(F.max("version")).first()[0] if version is None else version
        rows = every.where(F.col("version") == version).orderBy("vslot").collect()  # one for each slot
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def _near(ordered: list[tuple[int, int]], size: float) -> Iterable[tuple[int, int]]:
    import bisect

    at = bisect.bisect_left(ordered, (size, -1))
    return ordered[max(0, at - 1) : at + 1]


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text, ...): doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot.

    size: UTF-8 bytes of the text (null: none) and 16. The law is `bytes`. vslot: the virtual slot, a
    hash of doc_id, text and, for repeated rows, their number; slot: the row's place in its shard,
    gapless from 0, by virtual slot. grown_shard is null under this law. Under path, if given, maps are
    kept: the latest one, with as many slots and shards, is rebalanced and stored as the next version, so
    that few slots move; without one the first map is. Repeated rows and null doc_ids each have a place
    of their own; equal texts are spread like others. An empty table gives no rows. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = cut(told_apart(rows, "number").withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "number"), F.lit(slots)).cast("int")))
    held = {r["vslot"]: (r["bytes"], r["n"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # one row for each slot
    last = SlotMap.latest(spark, path) if path else None
    if last is None or (last.shards, len(last.owner)) != (shards, slots):
        last = SlotMap(last.version + 1 if last else 0, shards, SlotMap.initial(slots, shards).owner)
        if path:
            last.save(spark, path)
    balanced = last.rebalanced({s: b for s, (b, _) in held.items()})
    if path:
        balanced.save(spark, path)
    starts, ends = [], [0] * shards
    for slot, shard in enumerate(balanced.owner):
        starts.append((slot, shard, ends[shard]))
        ends[shard] += held.get(slot, (0, 0))[1]
    places = F.broadcast(spark.createDataFrame(starts, "vslot int, shard int, before long"))  # as many rows as slots
    own = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "number"))
    placed = rows.withColumn("own", own).join(places, "vslot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op5_slots(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes. The map of this table is kept in the shared folder: a later run edits its latest version."""
    prepare(spark)
    table = f"{sf_dir}/documents.parquet"
    kept = f"{spark.sparkContext.getCheckpointDir()}/slot-maps/{hashlib.sha256(table.encode()).hexdigest()[:32]}"
    return shard_documents(spark.read.parquet(table), path=kept)
