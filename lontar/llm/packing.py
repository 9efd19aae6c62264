"""Token sequences packed by best-fit decreasing.

Which pieces share a sequence depends on their lengths alone, so best-fit decreasing runs on the
histogram of lengths, which is as small as a sequence is long, whatever the corpus. A segment tree
over remaining capacities gives the tightest open sequence for a length in logarithmic time; all
equal sequences take their pieces at once, exactly as one after the other would. The plan says which
ranks of a length go to which sequences; ranks are numbered in salted groups, never in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, partial
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import spread
from .cluster import cut, prepare, told_apart

LENGTH = 2048
#: Groups in which equal lengths are numbered.
SALTS = 1024
#: Words that a Python worker remembers, none longer than LONG; texts are encoded together up to so many characters.
REMEMBERED, LONG, TOGETHER = 120_000, 64, 1 << 18


class Encoder:
    """Ids of the tokenizer's file, as little-endian unsigned 32-bit bytes.

    A single space before a word starts a new piece for this tokenizer, and a single line feed is a
    piece of its own, so texts with single ones are encoded word by word. Words seen before come from
    a table of bounded size; all others of many texts are encoded in one go and told apart by their
    first byte. Texts with line feeds beside other white space are encoded whole by the same library;
    further white space, texts that hold special tokens and letters outside Latin script go to the
    tokenizer itself.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.path = path
        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = partial(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy, disallowed_special=())
        #: Ids that begin with a space or a line feed, as the first of each word does and no other.
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for token, i in ranks.items() if token[:1] in b" \n"]] = True
        self.known: dict[str, bytes] = {}
        self.same = os.path.basename(path) == "byte_bpe_50k.json"

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def exact(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def library(self, text: str) -> np.ndarray:
        return self.fast(text).astype("<u4", copy=False)

    def learn(self, new: list[str]) -> None:
        """Put words into the table; those that begin with a line feed have no space before them."""
        ids = self.library("".join(w if w[0] == "\n" else " " + w for w in new))
        raw, ends = ids.tobytes(), [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
        self.known.update(zip(new, (raw[a:b] for a, b in pairwise(ends)), strict=True))

    def plain(self, text: str) -> bool:
        """Whether the library of this class gives the tokenizer's ids."""
        return self.same and not _OTHER.search(text) and "  " not in text and " " not in (text[:1], text[-1:]) and "<|endoftext|>" not in text

    @staticmethod
    def words(text: str) -> list[str] | None:
        """A plain text's words, each with the line feed before it and the first with one for the start; None if there are runs of white space."""
        text = "\n" + text
        return None if "\n\n" in text or " \n" in text or "\n " in text else text.replace("\n", " \n")[1:].split(" ")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        plain = [self.plain(t) for t in texts]
        divided = [self.words(t) if p else None for t, p in zip(texts, plain, strict=True)]
        known = self.known
        new = list(set(chain.from_iterable(filter(None, divided))).difference(known))
        if len(known) >= REMEMBERED and 3 * len(new) > sum(len(words or ()) for words in divided):
            known.clear()  # other words than before
            new = list(set(chain.from_iterable(filter(None, divided))))
        room = REMEMBERED - len(known)
        if new:
            self.learn(new)
        out = []
        for text, p, words in zip(texts, plain, divided, strict=True):
            if words:
                out.append(b"".join(map(known.__getitem__, words))[4:])  # without the line feed for the start
            else:
                out.append(self.library(text).tobytes() if p else self.exact(text))
        for w in new:
            if room > 0 and len(w) <= LONG:
                room -= 1
            else:
                del known[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


#: White space other than the space and the line feed, and all that is beyond Latin script.
_OTHER = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")
_encoders: dict[str, Encoder] = {}


def _together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of up to TOGETHER characters, or of one longer text."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > TOGETHER:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def _pieces(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode_all = _encoders[path].encode_all
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                texts = [text or "" for text in part.column(1).to_pylist()]
                for doc, own in zip(part.column(0).to_pylist(), chain.from_iterable(map(encode_all, _together(texts))), strict=True):
                    ids = memoryview(own + b"\0\0\0\0")
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        size = (n % most or most) if not start and n > most else min(most, n - start)
                        rows.append((doc, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                        start, piece = start + size, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class OpenBins:
    """Open sequences by remaining capacity, over a segment tree of which capacities have any."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = [False] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def _set(self, capacity: int) -> None:
        at = capacity + self.size
        self.any[at] = bool(self.groups[capacity])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def add(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.groups[capacity].append((first, count))
            self._set(capacity)

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of length or more that a sequence has left."""
        at = length + self.size
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None

    def take(self, capacity: int) -> tuple[int, int]:
        out = self.groups[capacity].pop()
        self._set(capacity)
        return out


def best_fit_plan(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, pieces in each, offset of the first) for best-fit decreasing."""
    bins, plan, opened = OpenBins(most), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = bins.tightest(length)
            if capacity is None:
                capacity, first, count = most, opened, -(-left // (most // length))
                opened += count
            else:
                first, count = bins.take(capacity)
            each = capacity // length
            full = min(count, left // each)
            rest = min(each, left - full * each) if full < count else 0
            taken = full * each + rest
            plan.append((length, rank, rank + taken - 1, first, each, most - capacity))
            bins.add(capacity - each * length, first, full)
            if rest:
                bins.add(capacity - rest * length, first + full, 1)
            untouched = count - full - bool(rest)
            if untouched:
                bins.add(capacity, first + full + bool(rest), untouched)
            rank, left = rank + taken, left - taken
    return plan


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, tokenizer: str, most: int = LENGTH) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text, ...): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids end with id 0; null and empty texts are that id alone. Only texts of more than most
    ids are cut, into pieces of most ids, the first of which may be shorter. Pieces of a sequence lie
    gapless from offset 0. Repeated rows, equal and null doc_ids are each packed for themselves; an
    empty table gives no rows. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    pieces = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer, most), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    salted = told_apart(pieces, "number").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "number"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length
    plan = best_fit_plan(totals, most)
    rows = spark.createDataFrame(plan, "plan_length long, low long, high long, first long, each long, base long")
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32", "number")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("own") - 1 + F.col("before"))
    placed = ranked.join(F.broadcast(rows) if len(plan) <= 100_000 else rows, (F.col("length") == F.col("plan_length")) & F.col("rank").between(F.col("low"), F.col("high")))
    at = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + at % F.col("each") * F.col("length")).cast("long").alias("offset"))


def op3_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), tokenizer_path())
