"""License notices, by base phrases and by an exact set-similarity join with templates.

A template is a clause of a license, as the set of its words. For a template of L words, the blocks of a
text are its runs of 2 L words at every multiple of L, so that L words in a row are in one block whole.
A block and a template are linked if the block has THRESHOLD or more of the template's words. Words are
ordered by how many documents have them, rarest first, counted over all documents. By that order

- prefix: a linked block has one of the template's few rarest words, which an index finds, among the
  first of its own words that leave enough of them for a link;
- length: it has as many of the templates' words as a link needs;
- position: from the first word in common on, both have enough words left.

What passes is counted exactly, so no link is lost and none is wrong. Words that no template has can't be
in common and are left out of blocks. Templates go to the tasks in parts of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import spread
from .cluster import prepare

THRESHOLD = Fraction(4, 5)
#: Templates that a task holds at once, by the bytes of their texts; more are taken in parts.
PART = 4 << 20
#: What is lower-cased, and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Base phrases.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Clauses of public licenses.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
_SPACED = str.maketrans(UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))


def spaced(text: F.Column) -> F.Column:
    """The text with A-Z lower-cased and a space for every character that is in no word."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))


def split_words(spaced_text: str) -> list[str]:
    return [w for w in spaced_text.split(" ") if w]


def text_words(text: str | None) -> list[str]:
    return split_words((text or "").translate(_SPACED))


@dataclass(frozen=True)
class Template:
    label: str
    length: int  # in words
    words: tuple[int, ...]  # distinct ones by rank, rarest first
    least: int  # of them make a link

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.words[: len(self.words) - self.least + 1]


@dataclass
class Index:
    """Templates filed under the words of their prefixes, by length."""

    rank: dict[str, int]
    templates: list[Template]
    #: For each length in words: which ranks are in a prefix, and the (template, place) of each.
    families: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = field(default_factory=dict)

    @staticmethod
    def of(templates: list[tuple[str, str]], counts: dict[str, int], threshold: Fraction) -> Index:
        every = [(label, text_words(text)) for label, text in templates]
        vocabulary = sorted({w for _, words in every for w in words}, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(vocabulary)}
        index = Index(rank, [])
        for label, words in every:
            own = tuple(sorted({rank[w] for w in words}))
            if not own:
                continue  # no words, no block
            template = Template(label, len(words), own, max(1, math.ceil(threshold * len(own))))
            flags, filed = index.families.setdefault(template.length, (np.zeros(len(rank) + 1, bool), defaultdict(list)))
            for place, word in enumerate(template.prefix):
                flags[word] = True
                filed[word].append((len(index.templates), place))
            index.templates.append(template)
        return index

    def links(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(template, start of the block, words in common) of every link of a text."""
        get = self.rank.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = []
        if not (codes >= 0).any():
            return out
        for length, (flags, filed) in self.families.items():
            hits = np.flatnonzero(flags[codes])  # the last flag, of -1, is false
            if not len(hits):
                continue
            steps = np.unique(np.concatenate([hits // length, hits // length - 1]))
            for start in (steps[steps >= 0] * length).tolist():
                block = np.unique(codes[start : start + 2 * length])
                block = block[block >= 0]
                out += [(t, start, both) for t, both in self._linked(block, filed)]
        return out

    def _linked(self, block: np.ndarray, filed: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
        size, met, held = len(block), set(), None
        for at, word in enumerate(block.tolist()):
            for t, place in filed.get(word, ()):
                template = self.templates[t]
                if t in met:
                    continue
                met.add(t)  # the first word in common decides
                if size < template.least or at > size - template.least:  # length, and the block's own prefix
                    continue
                if 1 + min(len(template.words) - place - 1, size - at - 1) < template.least:  # position
                    continue
                held = set(block.tolist()) if held is None else held
                both = sum(w in held for w in template.words)
                if both >= template.least:
                    yield t, both


def base_places(words: list[str], phrases: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where the words of a phrase stand in a row."""
    joined = f" {' '.join(words)} "
    out = []
    for label, phrase in phrases:
        own = f" {phrase} "
        at = joined.find(own)
        seen, last = 0, 0
        while at >= 0:
            seen, last = seen + joined.count(" ", last, at), at
            out.append((seen, label))
            at = joined.find(own, at + 1)
    return sorted(out)


def word_counts(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """In how many rows of docs (spaced) each word of a vocabulary is. Tasks send a row for each word that they have seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(vocabulary.intersection(text.split(" ")))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counted = docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}  # of the vocabulary only


_LINKS = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("words", pa.int32()), ("containment", pa.float64())]))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, links array<struct<label:string,template:int,start:long,words:int,containment:double>>"


def license_links(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: Fraction = THRESHOLD) -> DataFrame:
    """A row for each row of docs (doc_id, text, ...): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, links.

    links: each block that is linked with a template: its label and number, the block's first word (from 0) and
    length in words, and the share of the template's words that it has. score: the largest share, 1 where a base
    phrase stands, 0 without either. A null text is empty and has no words; repeated rows and rows without
    a doc_id are judged each for itself; templates without words link with nothing. An empty table gives no
    rows. Other columns are not read. Templates are taken in parts of PART bytes, each of which passes over the texts
    twice, to count its words in all of them and to join.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(F.col("text")).alias("spaced"))
    parts, held = [[]], 0
    for number, (label, text) in enumerate(templates):
        held += len(text.encode())
        if held > PART and parts[-1]:
            parts.append([])
            held = len(text.encode())
        parts[-1].append((number, label, text))
    only, indexes = texts.select("spaced"), []
    for part in parts:
        vocabulary = {w for _, _, text in part for w in text_words(text)}
        worded = [(number, label, text) for number, label, text in part if text_words(text)]
        counts = word_counts(only, vocabulary) if vocabulary else {}
        indexes.append(([number for number, _, _ in worded], Index.of([(label, text) for _, label, text in worded], counts, threshold)))
    known = [(label, " ".join(text_words(phrase))) for label, phrase in phrases]
    spark = docs.sparkSession
    if len(indexes) == 1:
        return texts.mapInArrow(_finder(spark.sparkContext.broadcast(indexes[0]), known), SCHEMA)
    rows = texts.withColumn("links", F.array().cast(SCHEMA.partition("links ")[2]))
    for one in indexes:
        rows = rows.mapInArrow(_gatherer(spark.sparkContext.broadcast(one)), f"doc_id long, spaced string, links {SCHEMA.partition('links ')[2]}")
    return rows.mapInArrow(_finder(None, known), SCHEMA)


def _found(words: list[str], held: tuple[list[int], Index]) -> list[dict]:
    numbers, index = held
    out = []
    for t, start, both in index.links(words):
        template = index.templates[t]
        out.append({"label": template.label, "template": numbers[t], "start": start, "words": min(2 * template.length, len(words) - start), "containment": both / len(template.words)})
    return out


def _gatherer(held):
    """Adds the links of one part of the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, links = (batch.column(i) for i in range(3))
            more = [old + _found(split_words(t), held.value) for t, old in zip(texts.to_pylist(), links.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, texts, pa.array(more, _LINKS)], ["doc_id", "spaced", "links"])

    return run


def _finder(held, phrases: list[tuple[str, str]]):
    """The result of each text, from its links if they are there, or those it finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = defaultdict(list)
            given = batch.column(2).to_pylist() if held is None else None
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = split_words(text)
                base = base_places(words, phrases)
                links = sorted(_found(words, held.value) if given is None else given[row], key=lambda x: (x["start"], x["template"]))
                named = {label for _, label in base}
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(base[0][0] if base else None)
                out["last_word"].append(base[-1][0] if base else None)
                out["base_labels"].append(",".join(sorted(named)))
                out["labels"].append(",".join(sorted(named | {x["label"] for x in links})))
                out["score"].append(1.0 if base else max((x["containment"] for x in links), default=0.0))
                out["links"].append(links)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _LINKS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc_id", *out]) if out else pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([], k) for k in kinds)], [c.split(" ")[0] for c in SCHEMA.split(", ")])

    return run


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    """License phrases and clauses in all documents."""
    return license_links(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).drop("links")
