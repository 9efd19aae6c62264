import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard

from lontar.llm import secrets

KEY = "AKIA" + "ABCDEFGH12345678"


def brute(text):
    """Base spans character by character from the definition."""
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans():
    for text in ("", "Password: abcdefghijkl", "password: token: abcdefghijklmnop", "API_KEY='a.b-c/d+e=f_g' x token=short", KEY + " AKIAshort AKIA12", "deadbeefdeadbeef0 DEADBEEFDEADBEEF", "é" * 5 + "secret=" + "z" * 12, "ſecret=abcdefghijkl", "token=secret=abcdefghijklmnop"):
        assert secrets.base_spans(text) == brute(text), text


def found(text):
    base, every, *_ = secrets.scan(text)
    assert set(base) <= set(every) and base == brute(text)
    return [(k, s, e) for s, k, e in every if (s, k, e) not in base]


def test_layers():
    plain = f"password={'s3cr3t' * 3}"
    quoted = "".join(f"%{ord(c):02X}" for c in plain)
    assert found(f"see {quoted} ") == [(0, 4, 4 + len(quoted))]
    twice = quoted.replace("%", "%25")
    assert found(f"see {twice} ") == [(0, 4, 4 + len(twice))]
    escaped = "".join(f"\\u{ord(c):04x}" for c in KEY)
    assert found(escaped) == [(1, 0, len(escaped))]
    coded = base64.b64encode(f"say {plain} now".encode()).decode()
    (kind, s, e), *_ = found(f"<{coded}>")
    assert kind == 0 and 1 <= s < e <= 1 + len(coded)
    packed = base64.urlsafe_b64encode(gzip.compress(KEY.encode())).decode()
    assert (1, 2, 2 + len(packed)) in [(k, s, e) for k, s, e in found("x " + packed)]
    deep = base64.b64encode(zlib.compress(base64.b64encode(KEY.encode()))).decode()
    assert [x for x in found(deep) if x[0] == 1] == [(1, 0, len(deep))]
    nested = urllib.parse.quote(base64.b64encode(quoted.encode()).decode(), safe="")
    assert any(k == 0 for k, _, _ in found(nested))


def test_layers_that_are_not_all_printable():
    for c in "\u00a0\u202f\u3000\u200b\u200d\u00ad\ufeff\0\x1b\U000e0fff":
        for form, code in ((f"clé{c}: {KEY} fin", "utf-8"), (f"{KEY} fin{c}", "utf-8"), (f"{c}{KEY}{c}", "utf-16-le"), (f"é{c}{KEY}{c}", "utf-16-be")):
            data = form.encode(code)
            coded = base64.b64encode(data).decode()
            ((kind, s, e),) = found(f"<{coded}>")
            at = data.index(KEY.encode(code))
            assert kind == 1 and s == 1 + at * 4 // 3 and e <= 1 + len(coded), (c, data)
            assert (1, 1) in {(k, s) for k, s, _ in found("<" + base64.b64encode(gzip.compress(data)).decode())}
    for data in (f"clé {KEY} é".encode("latin-1"), KEY.encode() + b"\xff\xfe\x80", b"\x80\x81" + base64.b64encode(b"\xff" + KEY.encode() + b"\xff") + b"\x82"):
        assert [k for k, _, _ in found(base64.b64encode(data).decode())] == [1]
    name = base64.urlsafe_b64encode(f"{KEY}\u00a0".encode() * 2).decode()
    assert [k for k, _, _ in found(f"a/{name}")] == [1, 1]


def wrapped(data, width, cut="\n"):
    coded = base64.b64encode(data).decode()
    return cut.join(coded[i : i + width] for i in range(0, len(coded), width))


def test_base64_over_line_breaks():
    for width, cut in ((76, "\n"), (64, "\r\n"), (75, "\n  "), (10, "\n\t"), (61, " \r")):
        for lead in range(30, 60):
            data = b"x" * lead + b" " + KEY.encode() + b" end"
            text = "see\n" + wrapped(data, width, cut) + "\nregards"
            once = base64.b64encode(data).decode()
            spots = [i for i in range(4, len(text)) if text[i] in once and text[i] not in cut]
            at = data.index(b"A")
            want = (1, spots[at * 4 // 3], spots[-(-(at + len(KEY)) * 4 // 3) - 1] + 1)
            assert want in found(text), (width, lead)
    prose = b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(40))
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        text = "-----BEGIN LONGER CERTIFICATE-----\n" + wrapped(pack(prose + KEY.encode()), 64) + "\n-----END"
        assert any(k == 1 and text[s:e].startswith(text[35:60]) for k, s, e in found(text)), pack


def test_all_members_of_packed_data():
    one, two = b"nothing here", KEY.encode()
    for pack in (gzip.compress, zlib.compress, lambda x: bz2.compress(x, 1), lzma.compress, zstandard.compress):
        for data in (pack(one) + pack(two), pack(one) * 3 + b"\0" * 4 + pack(two), pack(one) + gzip.compress(two), pack(one) + two):
            _, every, _, refused = secrets.scan(base64.b64encode(data).decode())
            assert [k for _, k, _ in every] == [1] and refused == 0, (pack, data)
        prose = b"".join(hashlib.sha256(b"%d" % i).hexdigest().upper().encode() for i in range(9000))
        data = pack(two + b" " + prose)
        for cut in (data[:-20], data[: len(data) // 2] + bytes(40)):
            _, every, _, refused = secrets.scan(base64.b64encode(cut).decode())
            assert refused == 1 and 1 in [k for _, k, _ in every], pack
            assert secrets.scan(wrapped(cut, 76))[3] >= 1
        assert secrets.scan(wrapped(data, 76))[3] == 0
    frame = b"\x50\x2a\x4d\x18\x04\0\0\0skip"
    assert [k for _, k, _ in secrets.scan(base64.b64encode(frame + zstandard.compress(two)).decode())[1]] == [1]


def test_packed_data_in_escapes():
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        data = pack(KEY.encode() + b" " + hashlib.sha512(KEY.encode()).digest() * 2)
        forms = ["".join(f % b for b in data) for f in ("%%%02X", "\\x%02x", "\\u%04x", "&#%d;")]
        forms += [urllib.parse.quote(data, safe=""), urllib.parse.quote_plus(data), repr(data)[2:-1]]
        for form in forms:
            assert (1, 4, 4 + len(form)) in found(f"see {form} x ~"), (pack, form)
            assert secrets.scan(f"see {form} x ~")[3] == 0


def test_escapes_that_are_not_all_valid():
    quoted = "".join(f"%{ord(c):02X}" for c in KEY)
    for before, after in (("%E9", ""), ("", "%E9"), ("%C3", "%C3%A9%FF"), ("%F0%9F", "%80")):
        assert found(before + quoted + after) == [(1, len(before), len(before + quoted))]
    escaped = "".join(f"\\u{ord(c):04x}" for c in KEY)
    for before, after in (("\\ud83d", ""), ("", "\\ude00"), ("\\U00110000", "\\ud83d\\ude00")):
        assert found(before + escaped + after) == [(1, len(before), len(before + escaped))]


def test_packed_many_times():
    data = KEY.encode()
    for _ in range(40):
        data = gzip.compress(data)
    _, every, _, refused = secrets.scan(base64.b64encode(data).decode())
    assert [k for _, k, _ in every] == [1] and refused == 0
    inner = gzip.compress(gzip.compress(b"x") + b" " + KEY.encode())
    assert [k for _, k, _ in secrets.scan(base64.b64encode(inner).decode())[1]] == [1]


def test_large_layers_are_scanned_in_blocks(monkeypatch):
    monkeypatch.setattr(secrets, "LARGEST", 1 << 14)
    monkeypatch.setattr(secrets, "MOST", 1 << 18)
    for at in (0, (1 << 14) - 10, 3 << 14, (1 << 17) - 5):
        data = b" " * at + KEY.encode() + b" " * ((1 << 17) - at)
        _, every, _, refused = secrets.scan(base64.b64encode(gzip.compress(data)).decode())
        assert [k for _, k, _ in every] == [1] and refused == 1, at
    assert secrets.scan(base64.b64encode(gzip.compress(b" " * (1 << 19))).decode())[3] == 1


def test_bombs_are_refused():
    bomb = base64.b64encode(gzip.compress(b"a" * (secrets.LARGEST + 10))).decode()
    assert secrets.scan(bomb)[3] == 1


def test_frames(spark):
    long = "word " * 100_000 + KEY
    rows = [(1, None, "x"), (2, "", "x"), (None, KEY, "x"), (3, long, "x"), (3, long, "x")]
    got = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].spans == by[2].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[None].n_access == 1 and by[3].spans == f"access:500000:{500000 + len(KEY)}"
    assert secrets.secret_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in secrets.op2_secrets(spark, sf).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(secrets.joined(want).encode()).hexdigest()


def _encoders():
    b64 = lambda b: base64.b64encode(b).decode()
    return {
        "percent": lambda t: "".join(f"%{x:02X}" for x in t.encode()),
        "quoted": lambda t: urllib.parse.quote(t, safe=""),
        "u": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        "braces": lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t),
        "x": lambda t: "".join(f"\\x{x:02x}" for x in t.encode()),
        "entity": lambda t: "".join(f"&#{ord(c)};" for c in t),
        "base64": lambda t: b64(t.encode()),
        "url64": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
        "mime": lambda t: base64.encodebytes(t.encode()).decode(),
        "utf16": lambda t: b64(t.encode("utf-16-le")),
        "gzip": lambda t: b64(gzip.compress(t.encode())),
        "twice": lambda t: b64(gzip.compress(zlib.compress(t.encode()))),
        "zlib": lambda t: b64(zlib.compress(t.encode())),
        "bz2": lambda t: b64(bz2.compress(t.encode())),
        "xz": lambda t: base64.encodebytes(lzma.compress(t.encode())).decode(),
        "zstd": lambda t: b64(zstandard.compress(t.encode())),
    }


@pytest.mark.parametrize("seed", range(40))
def test_keys_are_found_in_any_nesting(seed):
    """One to thirty random encoders around a key: it is found, inside of what was encoded."""
    rng = random.Random(seed)
    encoders, packers = _encoders(), ("gzip", "twice", "zlib", "bz2", "xz", "zstd")
    inner, used = f"id AKIA{''.join(rng.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k=16))} and so on, {rng.random()}", []
    for _ in range(rng.randint(1, 30)):
        used.append(rng.choice(packers if len(inner) > 3000 else list(encoders)))
        inner = encoders[used[-1]](inner)
    before = rng.choice(["see ", "x=", "é: ", "token list (", "data:;base64,", "Ab3" if used[-1] in ("base64", "gzip", "zlib", "twice", "zstd") else "- "])
    text = f"{before}{inner} end."
    base, every, _, refused = secrets.scan(text)
    places = [(s, e) for s, k, e in every if k == 1]
    assert any(s >= len(before) - 1 and e <= len(before) + len(inner) for s, e in places), used
    assert set(base) <= set(every) and refused < 10  # some bytes within packed data look like the head of more


def _took(text):
    import time

    best = 9e9
    for _ in range(2):
        start = time.process_time()
        secrets.scan(text)
        best = min(best, time.process_time() - start)
    return best


def test_long_wrapped_text_takes_time_in_proportion():
    """Lines that all look like the head of packed data, and one run of such heads."""
    line = base64.b64encode(b"\x78\x9c" + bytes(range(55))).decode()
    for small, large in (("\n".join([line] * 1000), "\n".join([line] * 8000)), (line[:64].rstrip("=") * 1000, line[:64].rstrip("=") * 8000)):
        assert _took(large) < 8 * 1.6 * _took(small) + 0.5


def test_packed_data_behind_packed_data_in_lines():
    first, second = (base64.encodebytes(gzip.compress(t.encode() * 3)).decode() for t in ("nothing to see here. ", "token = abcdefghijklmnop1 "))
    for text in (first.rstrip() + "\n" + second, "x\n" + second + first):
        assert any(kind == 0 for _, kind, _ in secrets.scan(text)[1]), text
