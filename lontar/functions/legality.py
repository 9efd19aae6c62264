"""Where no text may be broken or cut, judged by pairs of neighbours and not by the rules that divide texts.

Each reason is a pattern whose match stands at the place, so a text is passed over once for each reason, in the JVM;
`illegal_offsets` and `judged` give the places themselves, from arrays of whole batches. Places are counted in
characters (code points), so that none is inside a surrogate pair. Reasons come by name.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans as S

#: What may not stand before a break, what may not stand behind it, marks that neither side may have, and
#: marks that no line begins with.
LAST = {"orphaned-leading-vowel": "เ-ไເ-ໄ"}
FIRST = {
    "break-before-combining-mark": r"\p{M}",
    "coda-split-from-syllable": "[က-ဪဿၐ-ၕၚ-ၝၡၥၦၮ-ၰၵ-ႁႎ][ျ-ှ]*်",
    "orphaned-myanmar-asat": "်",
    "orphaned-myanmar-medial": "[ျ-ှ]",
    "orphaned-trailing-vowel": "[ะาำๅๆະາຳໆ]",
}
STACKS = {"split-khmer-coeng-stack": "្", "split-myanmar-stack": "္"}
START = {"line-starts-with-punctuation": "។៕៖၊။၏ฯๆ๚๛ໆ、。，！？：；"}


def reasons(kind: str = "break") -> list[str]:
    """All reasons against a break, or a cut, by name."""
    return sorted([*LAST, *FIRST, *STACKS, *(START if kind == "break" else [])])


@cache
def _pattern(reason: str) -> str:
    """Matches, without a character, where there is this reason."""
    if reason in LAST:
        return f"(?<=[{LAST[reason]}])(?=.)"
    if reason in STACKS:
        return f"(?<={STACKS[reason]})(?=.)|(?<=.)(?={STACKS[reason]})"
    return f"(?<=.)(?={FIRST.get(reason) or f'[{START[reason]}]'})"


def illegal_count(text: Column, reason: str | None = None, kind: str = "break") -> Column:
    """At how many places a text has a reason, or any."""
    every = [reason] if reason else reasons(kind)
    return F.regexp_count(text, F.lit("(?s)" + "|".join(map(_pattern, every))))


def illegal_counts(text: Column, kind: str = "break") -> Column:
    """(reason, n) of the reasons that a text has, by name."""
    every = F.array(*(F.struct(F.lit(r).alias("reason"), illegal_count(text, r, kind).alias("n")) for r in reasons(kind)))
    return F.when(text.isNotNull(), F.filter(every, lambda x: x["n"] > 0))


@cache
def _flags(letters: str) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(letters, S._every(), regex.V1):
        out[ord(m[0])] = True
    return out


def _reasons_at(texts: S.Texts, kind: str) -> dict[str, np.ndarray]:
    """For each reason, whether each character has it before itself."""
    cp, inside = texts.cp, ~texts.rows
    before = np.append(cp[:1], cp[:-1])
    out = {}
    for reason in reasons(kind):
        if reason in LAST:
            found = _flags(f"[{LAST[reason]}]")[before]
        elif reason in STACKS:
            found = (cp == ord(STACKS[reason])) | (before == ord(STACKS[reason]))
        elif reason == "coda-split-from-syllable":
            found = np.zeros(len(cp), bool)
            letter, rest = FIRST[reason].split("][")
            medial = _flags(FIRST["orphaned-myanmar-medial"])[cp]
            at = np.flatnonzero(_flags(letter + "]")[cp])
            plain = np.append(np.flatnonzero(~medial | texts.rows), len(cp))
            behind = plain[np.searchsorted(plain, at + 1)]
            killed = np.append(cp == ord(rest[-1]), False)[behind] & ~np.append(texts.rows, True)[behind]
            found[at[killed]] = True
        else:
            found = _flags(FIRST.get(reason) or f"[{START[reason]}]")[cp]
        out[reason] = found & inside
    return out


def illegal_offsets(text: Column, kind: str = "break") -> Column:
    """Where a text may not be broken (or cut), ascending, in characters."""

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array) -> pa.Array:
        texts = S.Texts(rows)
        found = np.zeros(len(texts.cp), bool)
        for own in _reasons_at(texts, kind).values():
            found |= own
        at = np.flatnonzero(found)
        base = texts.first[np.searchsorted(texts.first, at, "right") - 1]
        return texts.nulled(texts.lists(at, pa.array((at - base).astype(np.int32))))

    return run(text)


def judged(text: Column, offsets: Column, kind: str = "break") -> Column:
    """(at, reasons) of those offsets at which a text may not be broken (or cut); a text is judged once for all its offsets."""

    @F.arrow_udf("array<struct<at:int,reasons:array<string>>>")
    def run(rows: pa.Array, places: pa.Array) -> pa.Array:
        texts = S.Texts(rows)
        every = _reasons_at(texts, kind)
        out: list = []
        for i, (asked, valid) in enumerate(zip(places.to_pylist(), rows.is_valid().to_pylist(), strict=True)):
            first, end = int(texts.first[i]), int(texts.first[i + 1])
            inside = [at for at in asked or () if at is not None and 0 < at < end - first]
            held = [(at, [r for r, own in every.items() if own[first + at]]) for at in inside]
            out.append([{"at": at, "reasons": names} for at, names in held if names] if valid and asked is not None else None)
        return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("reasons", pa.list_(pa.string()))])))

    return run(text, offsets)
