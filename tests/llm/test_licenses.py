"""License scans: the join against all pairs of blocks and templates."""

import random
import re
from fractions import Fraction

import pyarrow.parquet as pq

from lontar.llm import licenses

DOCS = "doc_id long, text string, links string, spaced string, n_words int, word string"


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, templates=licenses.TEMPLATES, threshold=Fraction(4, 5)):
    words = brute_words(text)
    base = sorted((i, label) for label, phrase in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    links = []
    for t, (label, clause) in enumerate(templates):
        own = brute_words(clause)
        for start in range(0, len(words), max(1, len(own))):
            both = len(set(own) & set(words[start : start + 2 * len(own)]))
            if own and Fraction(both, len(set(own))) >= threshold:
                links.append((start, t, label, both / len(set(own))))
    return len(words), base, sorted(links)


def held(row, want):
    n, base, links = want
    named = {label for _, label in base}
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (n, len(base), base[0][0] if base else None, base[-1][0] if base else None)
    assert [(x.start, x.template, x.label, x.containment) for x in row.links] == links
    assert row.base_labels == ",".join(sorted(named)) and row.labels == ",".join(sorted(named | {x[2] for x in links}))
    assert row.score == (1.0 if base else max((x[3] for x in links), default=0.0))


def made(spark, texts, **more):
    got = licenses.license_links(spark.createDataFrame([(i, t, "x", "y", 3, "z") for i, t in texts], DOCS), **more).collect()
    return sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))


def drawn(rng, templates):
    """Words of clauses, some left out or changed, between others."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        out += [rng.choice(["the", "software", "of", "zzz", "ÄÖ", "license", "7"]) for _ in range(rng.randrange(30))]
        words = brute_words(rng.choice(templates)[1])
        share = rng.choice([0, 0.1, 0.2, 0.3])
        out += [w.upper() if rng.random() < 0.2 else w for w in words if rng.random() >= share]
        if rng.random() < 0.3:
            out += rng.choice(licenses.PHRASES)[1].split()
    return rng.choice([" ", "\n", ", ", "\0"]).join(out)


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    more = (*licenses.TEMPLATES, ("none", "  -- "), ("one", "zzz"), ("twice", "the the of the software of"))
    texts = [drawn(rng, licenses.TEMPLATES) for _ in range(120)]
    for part in (licenses.PART, 300):
        monkeypatch.setattr(licenses, "PART", part)
        got = made(spark, list(enumerate(texts)), templates=more)
        assert len(got) == 120 and any(r.links for r in got)
        for row in got:
            held(row, brute(texts[row.doc_id], more))


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "word " * 200_000 + "under the MIT-license. CC BY-NC, cc by nc"), (4, "under the mit license"), (4, "under the mit license"), (None, "Apache License, Version 2"), (5, "ünder the mit license under the mité license"), (6, "\0cc\0by\0nc\0"), (7, "cc by nc cc by nc")]
    got = made(spark, texts)
    for row, (_, text) in zip(got, sorted(texts, key=lambda r: (r[0] is None, r[0])), strict=True):
        held(row, brute(text))
    assert made(spark, []) == [] and [r.n_base for r in made(spark, texts, templates=())] == [0, 0, 3, 1, 1, 0, 1, 2, 1]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = dict(zip(*pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    got = licenses.op13_licenses(spark, folder).collect()
    assert len(got) == len(texts)
    for row in got:
        n, base, links = brute(texts[row.doc_id])
        assert (row.n_words, row.n_base) == (n, len(base)) and row.labels == ",".join(sorted({x[1] for x in base} | {x[2] for x in links}))
    assert {"mit", "apache-2", "cc-by-nc", "gpl-3"} <= {x for r in got for x in r.labels.split(",")}
