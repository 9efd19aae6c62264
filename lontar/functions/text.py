"""Words and sentences of scripts with spaces, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZWSP = "​"
#: Numbers with inner points and commas, or words with inner apostrophes and hyphens.
#: (Common letters stand first in classes and nothing is given back, which only spares time.)
WORD = r"\p{N}++(?:[.,]\p{N}++)*+|[a-zA-Z\p{L}\p{M}][a-zA-Z\p{L}\p{N}\p{M}]*+(?:['’ʼ‐‑-][a-zA-Z\p{L}\p{N}\p{M}]++)*+"
#: Marks that end a sentence, marks that close it, and the space that stays with it.
TERMINATORS = ".!?…។៕၊။。！？"
CLOSERS = "\"'’”)]}»"
_SENTENCE = rf"(?:[{TERMINATORS.replace('.', '')}]|(?<![0-9])\.|\.(?![0-9]))[{TERMINATORS}]*+[\"'’”)\]}}»]*+[ \t\n\r​]*+"

#: What comes before an end: no such mark, but for points between digits.
_INNER = f"[ a-z,A-Z[^{TERMINATORS}]]"
_BODY = rf"{_INNER}*+(?:(?<=[0-9])\.(?=[0-9]){_INNER}*+)*+"
_SENTENCES = rf"{_BODY}{_SENTENCE}|(?!\z){_BODY}"


def spaced_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def spaced_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def sentences(text: Column) -> Column:
    """Sentences with the marks and spaces after them; what is left is the last one. The locale plays no part."""
    return F.regexp_extract_all(text, F.lit(_SENTENCES), F.lit(0))


def sentence_count(text: Column) -> Column:
    """How many sentences() there are, without making them."""
    return F.regexp_count(text, F.lit(_SENTENCES))


def strip_line_break_opportunities(text: Column) -> Column:
    return F.replace(text, F.lit(ZWSP), F.lit(""))


#: Texts of these characters have no cluster of two, but for line ends of two.
PLAIN = r"\A[\x{0}-\x{2FF}&&[^\r]]*+\z"


def single_clusters(text: Column) -> Column:
    """Whether each character of a text is a cluster of its own."""
    return text.rlike(PLAIN)
