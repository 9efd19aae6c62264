"""Encodings and writing systems: Vietnamese, Jawi, Myanmar, and keys to search by."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..registry.tables import JAWI_TO_RUMI, JAWI_LETTERS, RUMI_DIGRAPHS, RUMI_LETTERS
from .digits import to_latin_digits
from .locale import by_locale, resolve_locale
from .. import registry as R

#: White space and its like at the ends of a text, for regular expressions.
SPACE = r"(?U)[\s\x{FEFF}]"

# ------------------------------------------------------------ Vietnamese


def _bare(text: str) -> str:
    """A text's letters without the marks U+0300 to U+036F, taken apart; đ is a letter of its own."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F).replace("đ", "d").replace("Đ", "D")


#: First points of blocks that classes of many ranges are parted by.
BLOCKS = (0, 0x300, 0x370, 0x590, 0x900, 0xB00, 0xD00, 0xE00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1700, 0x1AB0, 0x1B00, 0x1DC0, 0x1E00, 0x1F00, 0x2000, 0x2C00, 0x3000, 0x3100, 0xA000, 0xAC00, 0xD7A4, 0xF900, 0xFB00, 0x10000, 0x110000)


def _ranges(points: list[int]) -> str:
    """A class of code points, in ascending order, for regular expressions of the JVM.

    The JVM tries the ranges of a class one after the other. Those of a block stand behind the block's own range, so that
    a character meets those of its block alone.
    """
    out, at = "", 0
    for first, end in zip(BLOCKS, BLOCKS[1:]):
        spans: list[list[int]] = []
        while at < len(points) and points[at] < end:
            if spans and spans[-1][1] == points[at] - 1:
                spans[-1][1] = points[at]
            else:
                spans.append([points[at], points[at]])
            at += 1
        own = "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)
        if own:
            out += f"[\\x{{{first:x}}}-\\x{{{end - 1:x}}}&&[{own}]]" if len(spans) > 2 else own
    return out


def _high(pattern: str, least: int) -> str:
    """A pattern whose first character is `least` or above, which is asked first."""
    return f"(?=[\\x{{{least:x}}}-\\x{{10ffff}}])(?:{pattern})"


@cache
def _folding() -> tuple[str, str, str]:
    """Letters that fold to one, these, and a pattern of what does not: letters that fall into several, marks to be put in order."""
    source, target, rest, marks = [], [], [], []
    for code in [*range(0xC0, 0xD800), *range(0xF900, 0x30000), *range(0xE0100, 0xE01F0)]:
        c = chr(code)
        bare = _bare(c)
        if 0x300 <= code <= 0x36F:
            continue
        if unicodedata.combining(c):
            marks.append(code)
        if bare != c and len(bare) == 1:
            source.append(c)
            target.append(bare)
        elif bare != c:
            rest.append(code)
    loose = "".join(map(chr, range(0x300, 0x370)))
    return "".join(source) + loose, "".join(target), _high(f"[{_ranges(rest)}]|[{_ranges(marks)}][\\x{{300}}-\\x{{36f}}]*[{_ranges(marks)}]", min(rest + marks))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(_bare, na_action="ignore")


def fold_letters(text: Column) -> Column:
    """Letters that fold to one, in the JVM; what falls into several stays."""
    source, target, _ = _folding()
    return F.translate(text, source, target)


def fold_vietnamese(text: Column) -> Column:
    """Letters of all scripts taken apart, without marks U+0300 to U+036F. Only texts with letters that fall into several, such as hangul, leave the JVM."""
    open_ = text.rlike(_folding()[2])
    return F.when(open_, _folded(F.when(open_, text))).otherwise(fold_letters(text))


def slugify_vietnamese(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold_letters(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@cache
def _unsettled() -> str:
    """A pattern of the characters that a text in NFC may lack or join: those with a form of their own, marks that move, and ends of pairs."""
    ends = {0x1161 + i for i in range(21)} | {0x11A8 + i for i in range(27)}
    for code in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(chr(code))
        if parts and parts[0] != "<" and " " in parts:
            ends.add(int(parts.split(" ")[1], 16))
    own = [c for c in range(0xC0, 0x30000) if not 0xD800 <= c < 0xE000 and (c in ends or unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c))]
    own += [c for c in range(0xE0100, 0xE0200) if unicodedata.combining(chr(c))]
    return _high(f"[{_ranges(own)}]", min(own))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def normalize_nfc(text: Column) -> Column:
    """NFC, which Spark has no function of its own for. Texts without a character that NFC can change don't leave the JVM."""
    open_ = (F.length(text) != F.octet_length(text)) & ~text.rlike(r"\A[\x{0}-\x{2ff}]*+\z") & text.rlike(_unsettled())
    return F.when(open_, _nfc(F.when(open_, text))).otherwise(text)


def normalize_vietnamese(text: Column) -> Column:
    return normalize_nfc(text)


def equals_vietnamese(a: Column, b: Column) -> Column:
    return normalize_vietnamese(a) == normalize_vietnamese(b)


#: Combining marks and the tones they stand for.
TONES = {"̀": "huyền", "́": "sắc", "̉": "hỏi", "̃": "ngã", "̣": "nặng"}


def _toned() -> dict[str, str]:
    """Precomposed letters by the tone mark they hold."""
    out = dict(TONES)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        for c in unicodedata.normalize("NFD", chr(code)):
            if c in TONES:
                out[chr(code)] = TONES[c]
    return out


_TONED = _toned()


def tone_of(syllable: Column) -> Column:
    """The tone of the first mark in the syllable, else ngang."""
    first = F.regexp_extract(syllable, f"([{''.join(_TONED)}])", 1)
    by_tone: dict[str, list[str]] = {}
    for c, tone in _TONED.items():
        by_tone.setdefault(tone, []).append(c)
    out = F.lit("ngang")
    for tone, letters in by_tone.items():
        out = F.when(first.isin(*letters), tone).otherwise(out)
    return out


def has_vietnamese_diacritics(text: Column) -> Column:
    return text.rlike(f"[ăâđêôơưĂÂĐÊÔƠƯ{''.join(_TONED)}]|[aAeEoO]̂|[aA]̆|[oOuU]̛")


#: The keys of Telex, for letters and for tones; vowels, and those with a mark of their own.
TELEX_PAIRS = {"aa": "â", "ee": "ê", "oo": "ô", "aw": "ă", "ow": "ơ", "uw": "ư", "dd": "đ"}
TELEX_TONES = {"s": "́", "f": "̀", "r": "̉", "x": "̃", "j": "̣"}
VOWELS, MARKED_VOWELS = "aeiouyăâêôơư", "ăâêôơư"


def _toned_vowel(vowel: Column, key: Column) -> Column:
    """A vowel with the tone of a key."""
    every = VOWELS + VOWELS.upper()
    out = vowel
    for typed, mark in TELEX_TONES.items():
        made = "".join(unicodedata.normalize("NFC", v + mark) for v in every)
        out = F.when(key == typed, F.translate(vowel, every, made)).otherwise(out)
    return out


def _syllables(words: Column) -> Column:
    """Words whose letters are composed, with their tones: parsed into onset, nucleus and coda, of which the nucleus bears the tone.

    The tone's key is the word's last letter, if a vowel comes before it; else the last of those that follow a
    vowel, which all go. The nucleus is the last run of vowels; in it a marked vowel bears the tone, in a closed
    syllable the last vowel, in an open one the last but one.
    """
    both, own, keys = VOWELS + VOWELS.upper(), MARKED_VOWELS + MARKED_VOWELS.upper(), "sfrxjSFRXJ"
    parts = f"(?s)^((?:.*[^{both}])?)([{both}]+)([^{both}]*)$"

    def keyed(word: Column) -> Column:
        at_end = word.rlike(f"(?s)[{both}].*[{keys}]$")
        key = F.when(at_end, F.right(word, F.lit(1))).otherwise(F.regexp_extract(word, f"(?s)^.*(?<=[{both}])([{keys}])", 1))
        bare = F.when(at_end, F.left(word, F.length(word) - 1)).otherwise(F.regexp_replace(word, f"(?<=[{both}])[{keys}]", ""))
        return F.struct(F.lower(key).alias("key"), bare.alias("bare"))

    def parsed(w: Column) -> Column:
        return F.struct(w["key"].alias("key"), w["bare"].alias("bare"), *(F.regexp_extract(w["bare"], parts, i).alias(n) for i, n in enumerate(("onset", "nucleus", "coda"), 1)))

    def toned(w: Column) -> Column:
        nucleus = w["nucleus"]
        marked = F.length(F.regexp_extract(nucleus, f"^([^{own}]*)[{own}]", 1)) + 1
        place = F.when(nucleus.rlike(f"[{own}]"), marked).otherwise(F.greatest(F.lit(1), F.length(nucleus) - F.when(w["coda"] == "", 1).otherwise(0)))
        bearer = _toned_vowel(F.substr(nucleus, place, F.lit(1)), w["key"])
        return F.when((w["key"] == "") | (nucleus == ""), w["bare"]).otherwise(F.concat(w["onset"], F.substr(nucleus, F.lit(1), place - 1), bearer, F.substr(nucleus, place + 1), w["coda"]))

    return F.transform(F.transform(F.transform(words, keyed), parsed), toned)


def from_telex(text: Column) -> Column:
    """Telex keystrokes composed, word by word, in the JVM; in NFC."""
    out = text
    for pair, letter in TELEX_PAIRS.items():  # a letter in capitals makes a capital
        either = f"[{pair[1]}{pair[1].upper()}]"
        for first, made in ((pair[0], letter), (pair[0].upper(), letter.upper())):
            out = F.regexp_replace(out, first + either, made)
    pieces = F.regexp_extract_all(out, F.lit(rf"{SPACE}+|(?:(?!{SPACE})(?s:.))+"), F.lit(0))
    return normalize_nfc(F.array_join(_syllables(pieces), ""))


# ------------------------------------------------------------ Jawi


def rumi_to_jawi(text: Column) -> Column:
    """Latin letters as Jawi; the two letters of a digraph as one. `ng` is the only one that another can overlap, and comes first."""
    out = F.lower(text)
    for pair, letter in RUMI_DIGRAPHS:
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return F.translate(out, RUMI_LETTERS, JAWI_LETTERS)


def jawi_to_rumi(text: Column) -> Column:
    out = F.translate(text, "".join(j for j, r in JAWI_TO_RUMI if len(r) == 1), "".join(r for _, r in JAWI_TO_RUMI if len(r) == 1))
    for j, r in JAWI_TO_RUMI:
        if len(r) > 1:
            out = F.replace(out, F.lit(j), F.lit(r))
    return out


def is_jawi(text: Column) -> Column:
    return text.rlike(r"[؀-ۿݐ-ݿࢠ-ࣿ]")


# ------------------------------------------------------------ Myanmar

#: What tells the encodings apart, and its weight. How it is said is our own.
SIGNALS = (
    ("zawgyi", 3, r"[ဳဴၠ-႗]", "letters that Unicode keeps for Shan, Mon and Karen"),
    ("zawgyi", 3, r"(^|[^က-ဪျ-ှ္])ေ", "vowel E typed ahead of the letter it follows"),
    ("zawgyi", 3, r"(^|[^က-ဪျ-ှ])[ျ-ှ]", "medial typed ahead of the letter it follows"),
    ("unicode", 3, r"င်္", "kinzi in three letters"),
    ("unicode", 3, r"[က-ဪ][ျ-ှ]", "medial behind a letter"),
    ("unicode", 2, r"[က-ဪ]်", "asat behind a letter"),
    ("unicode", 1, r"္[က-အ]", "letters stacked by virama"),
)
MYANMAR = r"[က-႟ꩠ-ꩿ]"


def _points(text: Column) -> dict[str, Column]:
    return {kind: sum((F.when(text.rlike(p), n).otherwise(0) for k, n, p, _ in SIGNALS if k == kind), F.lit(0)) for kind in ("zawgyi", "unicode")}


def detect_myanmar_encoding(text: Column) -> Column:
    """encoding (unicode, zawgyi or unknown), confidence and signals."""
    points = _points(text)
    total = points["zawgyi"] + points["unicode"]
    said = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(s)) for _, _, p, s in SIGNALS)))
    foreign, bare = ~text.rlike(MYANMAR), total == 0
    won = F.greatest(points["zawgyi"], points["unicode"])
    return F.struct(
        F.when(foreign, "unknown").when(points["zawgyi"] > points["unicode"], "zawgyi").otherwise("unicode").alias("encoding"),
        F.when(foreign, 0.0).when(bare, 0.2).otherwise(won / total).alias("confidence"),
        F.when(foreign, F.array(F.lit("no Myanmar characters"))).when(bare, F.array(F.lit("no distinguishing marks"))).otherwise(said).alias("signals"),
    )


def is_zawgyi(text: Column) -> Column:
    points = _points(text)
    return text.rlike(MYANMAR) & (points["zawgyi"] > points["unicode"])


def assert_unicode_myanmar(text: Column, label: str = "text") -> Column:
    found = detect_myanmar_encoding(text)
    said = F.concat(F.lit(f"{label} appears to be Zawgyi-encoded ("), F.array_join(found["signals"], "; "), F.lit(")"))
    return F.when(found["encoding"] == "zawgyi", F.raise_error(said).cast("string")).otherwise(text)


#: Zawgyi letters, and the Unicode text of each.
ZAWGYI = {
    "\u1033": "\u102f",
    "\u1034": "\u1030",
    "\u105a": "\u102b\u103a",
    "\u1060": "\u1039\u1000",
    "\u1061": "\u1039\u1001",
    "\u1062": "\u1039\u1002",
    "\u1063": "\u1039\u1003",
    "\u1064": "\u1004\u103a\u1039",
    "\u1065": "\u1039\u1005",
    "\u1066": "\u1039\u1006",
    "\u1067": "\u1039\u1006",
    "\u1068": "\u1039\u1007",
    "\u1069": "\u1039\u1008",
    "\u106c": "\u1039\u100b",
    "\u106d": "\u1039\u100c",
    "\u106e": "\u100d\u1039\u100d",
    "\u106f": "\u100d\u1039\u100e",
    "\u1070": "\u1039\u100f",
    "\u1071": "\u1039\u1010",
    "\u1072": "\u1039\u1010",
    "\u1073": "\u1039\u1011",
    "\u1074": "\u1039\u1011",
    "\u1075": "\u1039\u1012",
    "\u1076": "\u1039\u1013",
    "\u1077": "\u1039\u1014",
    "\u1078": "\u1039\u1015",
    "\u1079": "\u1039\u1016",
    "\u107a": "\u1039\u1017",
    "\u107b": "\u1039\u1018",
    "\u107c": "\u1039\u1019",
    "\u107d": "\u103b",
    "\u107e": "\u103c",
    "\u107f": "\u103c",
    "\u1080": "\u103c",
    "\u1081": "\u103c",
    "\u1082": "\u103c",
    "\u1083": "\u103c",
    "\u1084": "\u103c",
    "\u1085": "\u1039\u101c",
    "\u1086": "\u103f",
    "\u1087": "\u103e",
    "\u1088": "\u103e\u102f",
    "\u1089": "\u103e\u1030",
    "\u108a": "\u103d\u103e",
    "\u108b": "\u1004\u103a\u1039\u102d",
    "\u108c": "\u1004\u103a\u1039\u102e",
    "\u108d": "\u1004\u103a\u1039\u1036",
    "\u1090": "\u101b",
    "\u1093": "\u1018",
    "\u1096": "\u1039\u1010\u103d",
    "\u1097": "\u100b\u1039\u100b",
}
#: Medials and asat, which Zawgyi has one place further on.
SHIFT = {
    "\u1039": "\u103a",
    "\u103a": "\u103b",
    "\u103b": "\u103c",
    "\u103c": "\u103d",
    "\u103d": "\u103e",
}
#: The order of marks in a syllable, those of a line alike.
ORDER = [
    "\u1039",
    "\u103b",
    "\u103c",
    "\u103d",
    "\u103e",
    "\u1031",
    "\u102d\u102e\u1032",
    "\u102f\u1030",
    "\u102b\u102c",
    "\u103a",
    "\u1036",
    "\u1037",
    "\u1038",
]

#: Letters that marks belong to.
BASES = "\u1000-\u102a\u103f\u104c-\u104f"
_MARKS = "".join(ORDER)


def _in_order(syllable: Column) -> Column:
    """A syllable's base and then its marks, by their rank and, of one rank, as they stood."""
    base, marks = F.regexp_extract(syllable, f"[{BASES}]", 0), F.regexp_replace(syllable, f"[{BASES}]", "")
    ranks = "".join(chr(ord("A") + i) * len(alike) for i, alike in enumerate(ORDER))
    ranked = F.transform(F.split(marks, ""), lambda m, i: F.struct(F.translate(m, _MARKS, ranks).alias("rank"), i.alias("at"), m.alias("mark")))
    return F.when(F.length(syllable) < 2, syllable).otherwise(F.concat(base, F.array_join(F.transform(F.array_sort(ranked), lambda r: r["mark"]), "")))


def zawgyi_to_unicode(text: Column) -> Column:
    """Zawgyi text in Unicode, in the JVM: letters by table, then the marks around each base behind it and in order."""
    single = {k: SHIFT.get(v, v) for k, v in ZAWGYI.items() if len(v) == 1} | SHIFT
    out = F.translate(text, "".join(single), "".join(single.values()))
    for letter, written in ZAWGYI.items():
        if len(written) > 1:
            out = F.replace(out, F.lit(letter), F.lit(written.translate(str.maketrans(SHIFT))))
    pieces = F.regexp_extract_all(out, F.lit(f"[{_MARKS}]*[{BASES}][{_MARKS}]*|[{_MARKS}]+|[^{_MARKS}{BASES}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"[{BASES}]"), _in_order(p)).otherwise(p)), "")


def normalize_myanmar(text: Column) -> Column:
    """Zawgyi converted, other text as it is."""
    return F.when(is_zawgyi(text), zawgyi_to_unicode(text)).otherwise(text)


# ------------------------------------------------------------ search


def to_search_key(text: Column, locale: Column) -> Column:
    """What a text is found by: in NFC, Zawgyi converted, marks and case folded, digits in ASCII, white space collapsed."""
    script = by_locale(resolve_locale(locale), {c: v.script for c, v in R.LOCALES.items()}, "Latn")
    clustered = script.isin("Mymr", "Thai", "Laoo", "Khmr")
    composed = normalize_nfc(F.when(clustered, text))
    bare = (
        F.when(script == "Mymr", F.regexp_replace(normalize_myanmar(composed), r"[ါ-ှ]", ""))
        .when(script == "Thai", F.regexp_replace(composed, r"[็-๎]", ""))
        .when(script == "Laoo", F.regexp_replace(composed, r"[່-ໍ]", ""))
        .when(script == "Khmr", F.regexp_replace(composed, r"[ំ-៓]", ""))
        .otherwise(fold_vietnamese(F.when(~clustered, text)))
    )
    return F.trim(F.regexp_replace(F.lower(to_latin_digits(bare)), SPACE + "+", " "))


def search_matches(query: Column, candidate: Column, locale: Column) -> Column:
    key = to_search_key(query, locale)
    return (key != "") & F.contains(to_search_key(candidate, locale), key)
