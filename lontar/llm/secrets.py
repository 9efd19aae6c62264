"""Secrets in texts, also inside nested encodings.

A layer is a text with the place in the document that each of its characters stands for. The
document is the first layer. A worklist takes a layer, scans it, and adds what it unwraps to:
percent escapes, Unicode escapes (\\uXXXX, \\u{X}, \\UXXXXXXXX, \\xXX, &#N;), base64 (standard or
URL-safe), and gzip, zlib, bzip2, xz or zstd data in base64 or in escapes. It ends when no layer is new;
layers already seen (same text for the same place) are not taken again, which ends cycles.
Decoded bytes need not be a text: all that is looked for is ASCII, so bytes are read one by one, and
again as UTF-16 where ASCII and zero bytes alternate; bytes of other kinds between are no hindrance.
Base64 in several lines is also taken as one: joined over the breaks and indentation, from each of the
four places where a group of its characters can begin (other words may be joined to its ends), and from
each line at which packed data begins. A run in one line that is no text as a whole is read from each of
these places, too, and unpacked from where packed data begins in it.
A finding in a layer is reported at the place in the document that its characters came from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import spread
from .cluster import prepare

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: One of these is in every text, lower-cased, that ASSIGN can match.
WORDS = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ESCAPE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
#: Single bytes of packed data in escapes: percent (in forms + is a space), and those of strings in programs, JSON and XML.
PERCENT_BYTE, PLUS_BYTE = re.compile(r"%[0-9A-Fa-f]{2}"), re.compile(r"%[0-9A-Fa-f]{2}|\+")
ESCAPED_BYTE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|\\[abfnrtv0\\'\"/]")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over line breaks and indentation. From its start only, so that a long run is passed over once.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+(?:\r*+\n|\r)[\x20\t]*+[A-Za-z0-9+/_-]++)++")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: All that bytes can hold, matches and nested layers, is in a run of so many ASCII characters.
READABLE = re.compile(rb"[\t-\r -~]{16}")
#: Such runs in UTF-16 of either byte order.
WIDE = (re.compile(rb"(?:[\t-\r -~]\x00){16,}"), re.compile(rb"(?:\x00[\t-\r -~]){16,}"))
#: How packed data begins.
PACKED = re.compile(rb"\x1f\x8b|\x78[\x01\x20\x3f\x5e\x7d\x9c\xbb\xda\xf9]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Packed data that unfolds to more bytes than LARGEST is counted in n_refused and scanned in blocks of that size, which
#: overlap by a quarter. One place in a layer may unfold to MOST bytes in all, so that data that grows for ever ends.
LARGEST, MOST = 64 << 20, 1 << 30
#: Packed bytes are taken so many at a time, which bounds what each step unfolds to.
FEED = 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; leftmost non-overlapping matches of each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _engine(data: bytes, at: int):
    """What unpacks the member of packed data that begins at a place; None if none does."""
    head = data[at : at + 6]
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd" or (head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5):  # a frame to be skipped is one, too
        return zstandard.ZstdDecompressor().decompressobj()
    return None


_BROKEN = (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError)


class Unpacking:
    """Pieces that packed data unfolds to, member after member. Then end says where its last member
    ends, and whole is false if that one breaks off or is damaged; pieces before that are given."""

    def __init__(self, data: bytes):
        self.data, self.end, self.whole = data, 0, True

    def pieces(self) -> Iterator[bytes]:
        data, at = self.data, 0
        while at < len(data) and (engine := _engine(data, at)):
            given, stop = False, at
            try:
                while stop < len(data) and not engine.eof:
                    piece = engine.decompress(data[stop : stop + FEED])
                    stop = min(len(data), stop + FEED)
                    if piece:
                        given = True
                        yield piece
            except _BROKEN:
                for piece in self._last(at, stop):
                    given = True
                    yield piece
            if not engine.eof:
                if given or data[at : at + 1] != b"\x78":  # two bytes of zlib occur by chance
                    self.end, self.whole = len(data), False
                return
            at = stop - len(engine.unused_data)
            self.end = at
            while data[at : at + 1] == b"\0":  # padding
                at += 1

    def _last(self, at: int, stop: int) -> Iterator[bytes]:
        """What the damaged stretch from stop on still gives, byte by byte."""
        engine = _engine(self.data, at)
        for i in range(at, stop, FEED):
            engine.decompress(self.data[i : i + FEED])
        for i in range(stop, min(len(self.data), stop + FEED)):
            try:
                piece = engine.decompress(self.data[i : i + 1])
            except _BROKEN:
                return
            if piece:
                yield piece


def _is_text(data: bytes) -> bool:
    """Whether the bytes are nothing but printable UTF-8."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return bool(text) and text.translate(dict.fromkeys(range(9, 14))).isprintable()


def _wide(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of runs of UTF-16. A run in one byte order is also one in the other, a byte on: the longer
    counts, and of equal ones that at an even place."""
    taken: list[tuple[int, int]] = []
    for a, b in sorted(m.span() for order in WIDE for m in order.finditer(data)):
        if not taken or a >= taken[-1][1] - 2:
            taken.append((a, b))
        elif (b - a, a % 2 == 0) > (taken[-1][1] - taken[-1][0], taken[-1][0] % 2 == 0):
            taken[-1] = (a, b)
    return taken


class Layer:
    """A text and where in the document it came from: starts[i], ends[i] for its character i, or spot for all. None: it is the document."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None, spot: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.spot = text, starts, ends, spot

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.spot:
            return self.spot
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def rewritten(self, pattern: re.Pattern, decode) -> Layer | None:
        """This layer with each match replaced by decode(match) -> [(characters, start, end)]; None if nothing changes."""
        if self.spot:
            text = pattern.sub(lambda m: m[0] if (pieces := decode(m)) is None else "".join(c for c, _, _ in pieces), self.text)
            return None if text == self.text else Layer(text, spot=self.spot)
        parts, starts, ends, at, changed = [], [], [], 0, False

        def keep(a: int, b: int) -> None:
            parts.append(self.text[a:b])
            starts.extend(range(a, b) if self.starts is None else self.starts[a:b])
            ends.extend(range(a + 1, b + 1) if self.ends is None else self.ends[a:b])

        for m in pattern.finditer(self.text):
            pieces = decode(m)
            if pieces is None:
                continue
            keep(at, m.start())
            at, changed = m.end(), True
            for c, a, b in pieces:
                a, b = self.place(m.start() + a, m.start() + b)
                parts.append(c)
                starts.extend([a] * len(c))
                ends.extend([b] * len(c))
        if not changed:
            return None
        keep(at, len(self.text))
        return Layer("".join(parts), starts, ends)

    def read(self, data: bytes | memoryview, spots: Sequence[int], packed: bool) -> Iterator[Layer]:
        """Layers of the bytes that the base64 characters at spots hold; packed: after unpacking, when each stands for all of it."""
        data = bytes(data)
        if READABLE.search(data) or _is_text(data):
            yield self._inner(data, range(len(data)), 1, spots, packed)
        for a, b in _wide(data):
            low = data[a] == 0
            yield self._inner(data[a + low : b : 2], range(a, b, 2), 2, spots, packed)

    def _inner(self, data: bytes, at: range, width: int, spots: Sequence[int], packed: bool) -> Layer:
        text = data.decode("latin-1")
        if packed or self.spot:
            return Layer(text, spot=self.place(spots[0], spots[-1] + 1))
        last = len(spots)
        starts = [spots[i * 4 // 3] for i in at]
        ends = [spots[min(last, -(-(i + width) * 4 // 3)) - 1] + 1 for i in at]
        if self.starts is not None:
            starts, ends = [self.starts[i] for i in starts], [self.ends[i - 1] for i in ends]
        return Layer(text, starts, ends)


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    """UTF-8; bytes that aren't are characters by themselves."""
    out, at = [], 0
    for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
        bad = 0xDC80 <= ord(c) < 0xDD00
        n = 3 if bad else 3 * len(c.encode("utf-8"))
        out.append((chr(ord(c) - 0xDC00) if bad else c, at, at + n))
        at += n
    return out


def _unicode(m: re.Match) -> list[tuple[str, int, int]]:
    """Characters of the escapes; half a pair and what is no code point become U+FFFD."""
    out: list[tuple[str, int, int]] = []
    for e in ESCAPE.finditer(m[0]):
        code = int(e[2]) if e[2] else int(e[1] or e[3], 16)
        if out and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, a, _ = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), a, e.end()))
        else:
            out.append((chr(code) if code <= 0x10FFFF else "\ufffd", e.start(), e.end()))
    return [("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c, a, b) for c, a, b in out]


def _byte(m: re.Match) -> list[tuple[str, int, int]] | None:
    """The byte that an escape stands for."""
    if m[0] == "+":
        code = 0x20
    elif m[0][0] == "%":
        code = int(m[0][1:], 16)
    elif e := ESCAPE.fullmatch(m[0]):
        code = int(e[2]) if e[2] else int(e[1] or e[3], 16)
    else:
        code = ord("\a\b\f\n\r\t\v\0\\'\"/"["abfnrtv0\\'\"/".index(m[0][1])])
    return [(chr(code), 0, len(m[0]))] if code < 256 else None


class _View(Sequence):
    """A part of a sequence, without a copy."""

    def __init__(self, base: Sequence[int], at: range | None = None):
        self.base, self.at = base, range(len(base)) if at is None else at

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i):
        return _View(self.base, self.at[i]) if isinstance(i, slice) else self.base[self.at[i]]


def _carried(layer: Layer, escape: re.Pattern, refused: list[int]) -> Iterator[Layer]:
    """Layers in packed data of which some bytes are escaped and others stand as they are."""
    raw = layer.rewritten(escape, _byte)
    if raw is None:
        return
    data, after = raw.text.encode("latin-1", "replace"), 0
    for m in PACKED.finditer(data):
        at = m.start()
        if at < after:
            continue
        try:
            _engine(data, at).decompress(data[at : at + FEED])
        except _BROKEN:
            continue
        packed, left = Unpacking(memoryview(data)[at:]), MOST
        for piece in packed.pieces():
            left -= len(piece)
            if left < 0:
                break
        if packed.end or left < 0:
            after = at + (packed.end or len(data) - at)
            yield from _packed(raw, data[at:after], range(at, after), refused)


def _bytes(run: str) -> bytes | None:
    """What base64 without its padding holds."""
    run = run.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True) if len(run) % 4 != 1 else None
    except (binascii.Error, ValueError):
        return None


def _packed(layer: Layer, data: bytes | memoryview, spots: Sequence[int], refused: list[int]) -> Iterator[Layer]:
    """Layers in packed data, and in what follows it, from the base64 characters at spots.

    Returns how many bytes are packed: 0 if it is no packed data, 1 if it breaks off.
    """
    work, seen, left, inside, end = [data], set(), MOST, False, 0
    while work:  # packed again without a text layer between
        data = work.pop()
        packed, out, large = Unpacking(data), bytearray(), False
        for piece in packed.pieces():
            out += piece
            left -= len(piece)
            if left < 0:
                large, packed.end = True, len(data)
                break
            if len(out) > LARGEST:
                large = True
                yield from layer.read(bytes(out), spots, True)
                del out[: -(LARGEST // 4)]
        if large or not packed.whole:
            refused.append(1)
        if not packed.end:
            if not inside:
                return 0
            yield from layer.read(data, spots, True)
            continue
        end = end or (packed.end if packed.whole else 1)
        if not inside and packed.end < len(data):
            around, spots = spots, spots[: -(-packed.end * 4 // 3) if len(spots) > len(data) else packed.end]
        else:
            around = spots
        rest = data[packed.end :]
        if READABLE.search(rest) or _wide(rest):
            yield from layer.read(data, around, inside)
        inside = True
        if large:
            yield from layer.read(bytes(out), spots, True)
        elif (mark := hashlib.blake2b(out, digest_size=16).digest()) not in seen:
            seen.add(mark)
            work.append(bytes(out))
    return end


def _from_base64(layer: Layer, start: int, end: int, refused: list[int], read: bool = True) -> Iterator[Layer]:
    """Layers in the base64 from start to end; not read: if it is packed only. Returns whether it was packed, and whether it is a text."""
    data = _bytes(layer.text[start:end].rstrip("="))
    if data is None:
        return False, False
    spots = range(start, end)
    packed = yield from _packed(layer, data, spots, refused)
    if packed or not read:
        return packed, False
    yield from layer.read(data, spots, False)
    return False, _is_text(data)


def _shifted(layer: Layer, start: int, end: int, refused: list[int]) -> Iterator[Layer]:
    """Layers in a run of base64 that has letters or digits of something else before or behind it."""
    run = layer.text[start:end].rstrip("=")
    for skip in range(4):
        part = run[skip:]
        odd = len(part) % 4 == 1
        data = _bytes(part[:-1] if odd else part)
        if not data:
            continue
        spots = range(start + skip, start + skip + len(part) - odd)
        if (skip or odd) and (READABLE.search(data) or _wide(data)):
            yield from layer.read(data, spots, False)
        for m in PACKED.finditer(data):
            if m.start() % 3 == 0 and (m.start() or skip or odd):
                own: list[int] = []
                if (yield from _packed(layer, memoryview(data)[m.start() :], spots[m.start() // 3 * 4 :], own)):
                    refused += own if len(m[0]) > 2 else []  # heads of two bytes occur by chance
                    break


def _from_lines(layer: Layer, start: int, end: int, refused: list[int]) -> Iterator[Layer]:
    """Layers in the lines of base64 from start to end, joined."""
    lines = [m.span() for m in LINE.finditer(layer.text, start, end)]
    run = "".join(layer.text[a:b] for a, b in lines)
    if len(run) < 16:
        return
    spots = _View([i for a, b in lines for i in range(a, b)])
    phases = []
    for skip in range(4):  # the places where a group of its characters can begin
        part = run[skip:]
        data = _bytes(part[:-1] if len(part) % 4 == 1 else part) or b""
        phases.append(memoryview(data))
        if data and (READABLE.search(data) or _wide(data)):
            yield from layer.read(data, spots[skip:], False)
    at, after, counted = 0, 0, refused
    for n, (a, b) in enumerate(lines):
        data = phases[at % 4][at // 4 * 3 :]
        if n + 1 < len(lines) and at >= after and PACKED.match(data[:9]):
            if end := (yield from _packed(layer, data, spots[at:], counted)):
                counted = []  # lines within packed data may look like the head of some
                after = at + end * 4 // 3  # whole data is passed over
        at += b - a


def unwrap(layer: Layer, refused: list[int]) -> Iterator[Layer]:
    text = layer.text
    if "%" in text and (out := layer.rewritten(PERCENT, _percent)):
        yield out
        for escape in (PERCENT_BYTE, PLUS_BYTE) if "+" in text else (PERCENT_BYTE,):
            yield from _carried(layer, escape, refused)
    if ("\\" in text or "&#" in text) and (out := layer.rewritten(UNICODE, _unicode)):
        yield out
        yield from _carried(layer, ESCAPED_BYTE, refused)
    lines = [m.span() for m in WRAPPED.finditer(text)] if "\n" in text or "\r" in text else []
    for a, b in lines:
        yield from _from_lines(layer, a, b, refused)
    ends = iter([*lines, (len(text), len(text))])
    a, b = next(ends)
    for m in BASE64.finditer(text):
        while m.start() >= b and b < len(text):
            a, b = next(ends)
        # Of packed data in lines, one line alone is a stream broken off, which must not be counted.
        # Nor is what goes on in escapes, which another layer has whole.
        counted = [] if a <= m.start() < b or text[m.end() : m.end() + 1] in ("%", "\\", "&") or text[max(0, m.start() - 3) : m.start() - 2] == "%" else refused
        packed, is_text = yield from _from_base64(layer, m.start(), m.end(), counted)
        if is_text:
            continue
        if not packed:
            yield from _shifted(layer, m.start(), m.end(), counted)
        for part in re.finditer(r"[A-Za-z0-9+]{16,}", m[0]) if re.search(r"[/_-]", m[0]) else ():  # a path or a name around it
            if packed and not part.start():
                continue
            end = m.start() + part.end()
            end = m.end() if end >= m.end() - 2 and m[0].endswith("=") else end
            # A part that begins with a group of the whole has been read with it, if that could be decoded.
            # What follows a stroke within packed data is no stream broken off.
            yield from _from_base64(layer, m.start() + part.start(), end, [] if packed or part[0][0] == "e" else counted, part.start() % 4 != 0 or len(m[0].rstrip("=")) % 4 == 1)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Spans of the text itself, all spans, layers seen and layers refused."""
    text = text or ""
    base = base_spans(text)
    found, refused, seen = set(base), [], set()
    work = [unwrap(Layer(text), refused)]  # depth first, so that few layers are held at a time
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        mark = (hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *inner.place(0, len(inner.text)))
        if mark in seen:
            continue
        seen.add(mark)
        for s, k, e in base_spans(inner.text):
            a, b = inner.place(s, e)
            found.add((a, k, b))
        work.append(unwrap(inner, refused))
    return base, sorted(found), len(seen), len(refused)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()), ("n_refused", pa.int64())])


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            rows = []
            for i in range(len(part)):
                base, every, layers, refused = scan(part.column(1)[i].as_py())
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), layers, refused))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:], strict=True))], schema=_OUT)


def secret_spans(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text, ...), in one pass without a shuffle.

    n_assign, n_access, n_hex, base_sha256: what the text itself holds; spans: with what its layers
    hold, as kind:start:end in code points of the document. n_layers: layers unwrapped; n_refused:
    packed data that unfolds to more than 64 MiB (scanned in overlapping blocks up to 1 GiB, but not unpacked
    again) or that breaks off or is damaged (what could be unpacked was scanned), or looks so by chance. Null and empty texts have no spans; repeated
    rows and null doc_ids are kept as they are. Other columns are not read.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scanner, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_refused long")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secret_spans(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
