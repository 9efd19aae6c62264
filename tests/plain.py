"""Words, breaks and truncation character by character, in plain Python: what the array kernel is held against."""

from __future__ import annotations

import math
from itertools import accumulate

import regex

from lontar.functions.clusters import NATIVE, WINDOW, ZWSP, Lexicon, clusters, native_clusters, unknown_costs


def cheapest(units: list[str], lexicon: Lexicon, script: str) -> list[str]:
    """The division of clusters into words of least cost; of equal ones that with the shorter last word."""
    unknown, known, longest = unknown_costs(script), lexicon.cost.get, lexicon.longest
    far = len(unknown)
    ends = list(accumulate(map(len, units), initial=0))
    text = "".join(units)
    costs, steps = [0.0], [0]
    for end in range(1, len(units) + 1):
        best, step, stop = math.inf, 1, ends[end]
        for k in range(1, min(WINDOW, end) + 1):
            start = ends[end - k]
            price = known(text[start:stop]) if stop - start <= longest else None
            if price is None:
                if k >= far:
                    if stop - start > longest:
                        break  # longer words are neither known nor worth it
                    continue
                price = unknown[k]
            price += costs[end - k]
            if price < best:
                best, step = price, k
        costs.append(best)
        steps.append(step)
    out, end = [], len(units)
    while end:
        out.append(text[ends[end - steps[end]] : ends[end]])
        end -= steps[end]
    return out[::-1]


_SPACED = regex.compile(r"(?P<word>\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}][\p{L}\p{N}\p{M}]*(?:['’ʼ‐‑-][\p{L}\p{N}\p{M}]+)*)|(?:(?!(?:\p{N}|[\p{L}\p{M}])).)+", regex.S)
_HAS_LETTER = regex.compile(r"[\p{L}\p{N}]")
_RUNS = {script: regex.compile(f"(?P<native>[{letters}]+)|[^{letters}]+") for script, letters in NATIVE.items()}


def spans(text: str, script: str, lexicon: Lexicon | None = None, engine: str = "lexical") -> list[tuple[str, bool]]:
    """(text, whether it is a word) of consecutive spans, which together are the text.

    engine: lexical, or orthographic, which takes every cluster for a word, as lexical does without a lexicon; or
    whatever has segments(text, script).
    """
    if not isinstance(engine, str):
        return engine.segments(text, script)
    if script not in _RUNS:
        return [(m[0], m["word"] is not None) for m in _SPACED.finditer(text)]
    out: list[tuple[str, bool]] = []
    by_words = lexicon is not None and engine == "lexical"
    for run in _RUNS[script].finditer(text):
        piece = run[0]
        if run["native"] is None:
            out += [(piece, False)] if piece == " " else spans(piece, "Latn")
            continue
        out += _divided(piece, script, lexicon if by_words else None)
    return out


def _divided(run: str, script: str, lexicon: Lexicon | None) -> list[tuple[str, bool]]:
    """Spans of a run of the script's own letters."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    for unit in (*native_clusters(run, script), ""):
        if unit and (unit[0].isalpha() or _HAS_LETTER.search(unit)):
            held.append(unit)
            continue
        if held:
            out += [(w, True) for w in (cheapest(held, lexicon, script) if lexicon else held)]
            held = []
        if unit:
            out.append((unit, False))
    return out


def line_breaks(text: str, script: str, lexicon: Lexicon | None = None, engine: str = "lexical") -> list[int]:
    """Where words begin inside the text."""
    out, at = [], 0
    for piece, is_word in spans(text, script, lexicon, engine):
        if is_word and at:
            out.append(at)
        at += len(piece)
    return out


def with_breaks(text: str, script: str, lexicon: Lexicon | None = None, engine: str = "lexical") -> str:
    """The text with zero-width spaces where a line may break and no space is."""
    near = " \t\n\r" + ZWSP
    out, last = [], 0
    for at in line_breaks(text, script, lexicon, engine):
        if text[at - 1] not in near and text[at] not in near:
            out.append(text[last:at])
            last = at
    return ZWSP.join([*out, text[last:]])


def truncated(text: str, script: str, most: int, ellipsis: str = "…", lexicon: Lexicon | None = None, engine: str = "lexical") -> str:
    """At most `most` clusters, the ellipsis among them, cut behind a word if one ends in time."""
    units = clusters(text, script)
    if len(units) <= most:
        return text
    limit = len("".join(units[: max(1, most - len(clusters(ellipsis, script)))]))
    cut = at = 0
    for piece, _ in spans(text, script, lexicon, engine):
        at += len(piece)
        if at > limit:
            break
        cut = at
    kept = text[: cut or limit].rstrip()
    return (kept or text[:limit]) + ellipsis


def illegal_reasons(text, at, kind="break"):
    """Names of the rules that a break (or a cut) at a place in the text offends, by name."""
    from lontar.functions.legality import FIRST, LAST, STACKS, START

    if not 0 < at < len(text):
        return []
    out = [name for name, letters in LAST.items() if regex.match(f"[{letters}]", text[at - 1])]
    out += [name for name, pattern in FIRST.items() if regex.compile(pattern).match(text, at)]
    out += [name for name, mark in STACKS.items() if mark in text[at - 1 : at + 1]]
    if kind == "break" and text[at] in START["line-starts-with-punctuation"]:
        out.append("line-starts-with-punctuation")
    return sorted(out)
