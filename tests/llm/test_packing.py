import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lontar.llm import packing


def best_fit(lengths, most):
    """Best-fit decreasing, one piece after the other."""
    open_, done = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(open_) if room >= n]
        if fits:
            i = min(fits, key=lambda i: open_[i])
            open_[i] -= n
        else:
            open_.append(most - n)
    return Counter(open_)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    most = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, most) for _ in range(rng.randint(1, 300))]
    plan = packing.best_fit_plan(Counter(lengths), most)
    room = defaultdict(lambda: most)
    for length, low, high, first, each, base in plan:
        for rank in range(low, high + 1):
            at = rank - low
            sequence, offset = first + at // each, base + at % each * length
            assert offset == most - room[sequence]
            room[sequence] -= length
    assert min(room.values()) >= 0 and Counter(room.values()) == best_fit(lengths, most)


@pytest.fixture(scope="module")
def tokenizer():
    return packing.tokenizer_path()


def test_encoder_agrees_with_the_tokenizer(tokenizer):
    encoder = packing.Encoder(tokenizer)
    rng = random.Random(3)
    marks = ["word", "été", "I'm", "a\nb", "x1,5", "  ", "\t", "\n\n", "你好", "<|endoftext|>", "!!", "über...", "​", " ", "", "don't", "Àé" * 9, "﻿", "\x85"]
    for _ in range(400):
        text = rng.choice([" ", "", "\n"]).join(rng.choice(marks) for _ in range(rng.randint(0, 12)))
        assert encoder.encode(text) == encoder.exact(text), repr(text)


def test_encoder_agrees_at_line_feeds(tokenizer):
    encoder = packing.Encoder(tokenizer)
    rng = random.Random(7)
    for _ in range(3000):
        letters = rng.choice(["a \n", "a\n\n", "ab1., \n'", "aé \n.", "s't \n", "0½a_ \n", "a \n\0|"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert encoder.encode(text) == encoder.exact(text), repr(text)


def test_unseen_words_are_encoded_in_one_go(tokenizer):
    encoder = packing.Encoder(tokenizer)
    calls, fast = [], encoder.fast
    encoder.fast = lambda text: calls.append(text) or fast(text)
    text = " ".join(f"w{i}x{i * 7919}" for i in range(1000)) + "\nend."
    assert encoder.encode(text) == encoder.exact(text) and len(calls) <= 3
    calls.clear()
    assert encoder.encode(text) == encoder.exact(text) and len(calls) <= 1


def test_remembered_words_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    encoder = packing.Encoder(tokenizer)
    rng = random.Random(11)
    for turn in range(60):
        texts = [" ".join(f"{'xy'[turn // 30]}{rng.randint(0, 80)}" for _ in range(rng.randint(0, 40))) for _ in range(5)] + ["z" * 200, "", "a\n\nb", "你 好"]
        assert encoder.encode_all(texts) == [encoder.exact(t) for t in texts]
        assert len(encoder.known) <= 50 and max(map(len, encoder.known)) <= packing.LONG


def test_texts_are_taken_together(monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 10)
    texts = ["", "abc", "d" * 7, "e", "f" * 25, "", "g"]
    assert list(packing._together(texts)) == [["", "abc", "d" * 7], ["e"], ["f" * 25], ["", "g"]]
    assert list(packing._together([])) == []


def check(rows, texts, tokenizer, most):
    exact = packing.Encoder(tokenizer).exact
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc, text in texts.items():
        ids = np.frombuffer(exact(text or "") + b"\0\0\0\0", "<u4")
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert all(r.length == most for r in own[1:]) and (len(own) == 1 or len(ids) > most)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
    return len(sequences)


def test_documents(spark, sf, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op3_best_fit(spark, sf).collect()
    n = check(rows, texts, tokenizer, packing.LENGTH)
    assert n == sum(best_fit([r.length for r in rows], packing.LENGTH).values())


def test_edges(spark, tokenizer):
    rows = [(1, None, 9), (2, "", 9), (None, "hello", 9), (3, "a b " * 3000, 9), (3, "a b " * 3000, 9)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), tokenizer, 64).collect()
    assert [r.length for r in got if r.doc_id in (1, 2)] == [1, 1] and {r.doc_id for r in got} == {1, 2, 3, None}
    three = [r for r in got if r.doc_id == 3]
    assert len(three) == 2 * len({r.piece for r in three})
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer).collect() == []
