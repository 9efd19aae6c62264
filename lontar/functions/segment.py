"""Words, clusters, line breaks and truncation of any locale.

Words of spaced scripts and clusters of plain texts are expressions of the JVM. What else there is, and
scripts without spaces, goes over Arrow to `spans`, which takes whole batches as arrays; a row that needn't go is
null there, so that the source is read once. Lexicons are broadcast once, up to LEXICON_BYTES.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as R
from . import clusters as C
from . import spans as S
from .locale import cluster_script, resolve_locale
from .text import single_clusters, spaced_words

ENGINES = ("lexical", "orthographic")
Lexicons = dict[str, C.Lexicon]
#: The bytes of all words of the lexicons that are broadcast together, at most.
LEXICON_BYTES = 64 << 20


@dataclass(frozen=True)
class Engine:
    """A segmentation engine of the user's: segments(text, script) gives spans (text, whether it is a word) that together are the text."""

    id: str
    segments: Callable[[str, str], list[tuple[str, bool]]]


def lexicon_from(spark, path: str) -> Lexicons:
    """Lexicons from a table (locale, word, rank): words by frequency, the most frequent first; of equal ranks the first by letters.

    The table's size is checked before it comes to the driver, from which it is broadcast.
    """
    rows = spark.read.parquet(path).select("locale", "rank", "word").where("word is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    if size > LEXICON_BYTES:
        raise ValueError(f"words of {size} bytes in {path}; a lexicon may have {LEXICON_BYTES}")
    return lexicons_of(rows)


def lexicons_of(rows: DataFrame) -> Lexicons:
    """Lexicons from rows (locale, word, rank) of a checked size."""
    out: dict[str, list[tuple[int, str]]] = {}
    for row in rows.toLocalIterator():
        out.setdefault(row["locale"], []).append((row["rank"], row["word"]))
    return {code: C.Lexicon.of([w for _, w in sorted(words)]) for code, words in out.items()}


def register_words(lexicons: Lexicons, locale: str, words: list[str]) -> Lexicons:
    """The lexicons with words of the user's at the head of a locale's."""
    code = _code(locale)
    old = lexicons.get(code, C.Lexicon())
    new = C.Lexicon.of([], words)
    return lexicons | {code: C.Lexicon(old.cost | new.cost, max(old.longest, new.longest))}


def lexicon_size(lexicons: Lexicons, locale: str) -> int:
    return len(lexicons.get(_code(locale), C.Lexicon()).cost)


def _code(locale: str) -> str:
    found = R.resolve(locale)
    return "my" if found and found.code == "shn" else found.code if found else locale


def _broadcast(lexicons: Lexicons):
    """The lexicons as arrays, broadcast once for each context."""
    sc = SparkSession.active().sparkContext
    held = sc.__dict__.setdefault("_lexicons", {})
    key = tuple(sorted((code, id(lexicon)) for code, lexicon in lexicons.items()))
    if key not in held:
        size = sum(len(w.encode()) for lexicon in lexicons.values() for w in lexicon.cost)
        if size > LEXICON_BYTES:
            raise ValueError(f"lexicons of {size} bytes; they may have {LEXICON_BYTES}")
        arrays = {code: S.Known(list(lexicon.cost), list(lexicon.cost.values())) for code, lexicon in lexicons.items()}
        held[key] = (sc.broadcast(arrays), lexicons)  # which keeps the ids theirs
    return held[key][0]


def _from_engine(texts: S.Texts, rows: list[str], script: str, engine: Engine) -> tuple[np.ndarray, np.ndarray]:
    starts, word = np.zeros(len(texts.cp), bool), np.zeros(len(texts.cp), bool)
    for at, text in zip(texts.first.tolist(), rows, strict=False):
        for piece, is_word in engine.segments(text, script):
            if piece:
                starts[at], word[at] = True, is_word
            at += len(piece)
    return starts, word


def _udf(kind: str, shape: Callable, lexicons: Lexicons | None, engine: str | Engine):
    """An Arrow UDF of (text, locale, ...) by shape(texts, starts, word, script, ...): rows of one script and lexicon are divided together."""
    held = _broadcast(lexicons) if lexicons and engine == "lexical" else None

    @F.arrow_udf(kind)
    def run(texts: pa.Array, locales: pa.Array, *more: pa.Array) -> pa.Array:
        known = held.value if held is not None else {}
        tags = locales.dictionary_encode()
        groups: dict[tuple[str, str | None], list[int]] = {}
        for i, tag in enumerate(tags.dictionary.to_pylist()):
            found = R.resolve(tag)
            script = found.script if found and found.script in C.NATIVE else "Latn"
            groups.setdefault((script, _code(tag) if script != "Latn" and _code(tag) in known else None), []).append(i)
        codes = np.asarray(tags.indices.fill_null(-1))
        groups.setdefault(("Latn", None), []).append(-1)
        out, order = [], []
        for (script, code), own in groups.items():
            at = np.flatnonzero(np.isin(codes, own))
            if not len(at):
                continue
            rows = texts if len(at) == len(texts) else texts.take(pa.array(at))
            given = S.Texts(rows)
            if isinstance(engine, Engine):
                starts, word = _from_engine(given, [t or "" for t in rows.to_pylist()], script, engine)
            else:
                starts, word = S.divide(given.cp, given.rows, script, known.get(code))
            out.append(shape(given, starts, word, script, *(x.take(pa.array(at)) for x in more)))
            order.append(at)
        if not out:
            return shape(given := S.Texts(texts), np.zeros(0, bool), np.zeros(0, bool), "Latn", *more)
        return out[0] if len(out) == 1 else pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))

    return run


def _words_udf(lexicons: Lexicons | None, engine: str | Engine):
    return _udf("array<string>", lambda t, starts, word, _: S.words(t, starts, word), lexicons, engine)


def words(text: Column, locale: Column, lexicons: Lexicons | None = None, engine: str | Engine = "lexical") -> Column:
    """Words in order; those of spaced scripts don't leave the JVM."""
    if isinstance(engine, Engine):
        return _words_udf(None, engine)(text, locale)
    spaced = F.coalesce(cluster_script(locale) == "Latn", F.lit(True))
    return F.when(spaced, spaced_words(text)).otherwise(_words_udf(lexicons, engine)(F.when(~spaced, text), locale))


def spans(text: Column, locale: Column, lexicons: Lexicons | None = None, engine: str | Engine = "lexical") -> Column:
    """Consecutive spans with their offsets in UTF-16 units."""
    return _udf("array<struct<start:int,end:int,text:string,word_like:boolean>>", lambda t, starts, word, _: S.listed(t, starts, word), lexicons, engine)(text, locale)


def _by_clusters(kind: str, each: Callable):
    """A pandas UDF of (text, locale) from each(clusters)."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series, locales: pd.Series) -> pd.Series:
        found = {tag: R.resolve(tag) for tag in locales.dropna().unique()}
        script = {tag: v.script if v and v.script in C.NATIVE else "Latn" for tag, v in found.items()}
        return pd.Series([None if t is None else each(C.clusters(t, script.get(x, "Latn"))) for t, x in zip(texts, locales, strict=True)], dtype=object)

    return run


def graphemes(text: Column, locale: Column) -> Column:
    plain = single_clusters(text)
    return F.when(plain, F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).otherwise(_by_clusters("array<string>", list)(F.when(~plain, text), locale))


def grapheme_length(text: Column, locale: Column) -> Column:
    plain = single_clusters(text)
    return F.when(plain, F.length(text)).otherwise(_by_clusters("int", len)(F.when(~plain, text), locale))


def insert_line_break_opportunities(text: Column, locale: Column, lexicons: Lexicons | None = None, engine: str | Engine = "lexical") -> Column:
    """Zero-width spaces before words of scripts without spaces; other text as it is, and not sent to Python."""
    spaced = F.coalesce(cluster_script(locale) == "Latn", F.lit(True))
    broken = _udf("string", lambda t, starts, word, _: S.broken(t, starts, word), lexicons, engine)
    return F.when(spaced, text).otherwise(broken(F.when(~spaced, text), locale))


def truncate(text: Column, locale: Column, most: int | Column, ellipsis: str = "…", lexicons: Lexicons | None = None, engine: str | Engine = "lexical") -> Column:
    """At most `most` clusters, the ellipsis among them, cut behind a word if one ends in time; texts that are short enough in code points don't leave the JVM."""
    bound = F.lit(most).cast("int")
    short = F.length(text) <= bound
    cut = _udf("string", lambda t, starts, _, script, n: S.truncated(t, starts, script, n.to_pylist(), ellipsis), lexicons, engine)
    return F.when(short, text).otherwise(cut(F.when(~short, text), locale, bound))


def break_offsets(text: Column, locale: Column, lexicons: Lexicons | None = None, engine: str | Engine = "lexical") -> Column:
    """Where words begin inside the text, in characters."""
    return _udf("array<int>", lambda t, starts, word, _: S.breaks(t, starts, word), lexicons, engine)(text, locale)


def with_words(df: DataFrame, text: str, locale: str, lexicons: Lexicons | None = None, engine: str | Engine = "lexical") -> DataFrame:
    """df with an array `words`."""
    return df.withColumn("words", words(F.col(text), F.col(locale), lexicons, engine))


def with_truncated(df: DataFrame, text: str, locale: str, most: int, ellipsis: str = "…", lexicons: Lexicons | None = None) -> DataFrame:
    """df with `truncated`."""
    return df.withColumn("truncated", truncate(F.col(text), F.col(locale), most, ellipsis, lexicons))


def known_locale(df: DataFrame, locale: str) -> DataFrame:
    return df.where(resolve_locale(F.col(locale)).isNotNull())
