"""Text measures, splitting, packing and cutting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode words; Java's \w alone is ASCII.
WORD = r"(?U)\b\w+\b"
SENTENCE = r"[^.!?]+[.!?]*"
EDGE_SPACE = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def char_count(text: Column, spaces: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.length(text if spaces else F.regexp_replace(text, r"\s", "")).cast("long")


def sentences(text: Column) -> Column:
    """Array of stripped, non-blank sentences."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0)), strip)
    return F.filter(found, lambda x: x != "")


def full_stop(sentence: Column) -> Column:
    """The sentence, with a full stop if it has no mark of .!?:; at its end."""
    return F.when(sentence.rlike(r"[.!?:;]$"), sentence).otherwise(F.concat(sentence, F.lit(".")))


def complexity(text: Column) -> Column:
    """Speech complexity, 1 to 2: punctuation density, word length over 5 and sentence length over 15 words slow speech down."""
    n, words = F.length(text), word_count(text)
    marks = F.length(F.regexp_replace(text, "[^.!?,:;…]", ""))
    word_chars = F.length(F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), ""))
    n_sentences = F.greatest(F.lit(1), F.size(sentences(text)))
    raw = 1 + 0.5 * marks / n + 0.02 * F.greatest(F.lit(0.0), word_chars / words - 5) + 0.01 * F.greatest(F.lit(0.0), words / n_sentences - 15)
    return F.when((F.length(F.trim(F.coalesce(text, F.lit("")))) == 0) | (words == 0), F.lit(1.0)).otherwise(F.least(F.lit(2.0), raw))


def ellipsis(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def middle_ellipsis(text: Column, n: int = 30) -> Column:
    """The first and last n characters around '...', if that is shorter."""
    return F.when(F.length(text) > 2 * n + 3, F.concat(F.substring(text, 1, n), F.lit("..."), F.substring(text, -n, n))).otherwise(text)


def pack(pieces: Column, limit: int) -> Column:
    """Greedy packing of an array of short strings into strings of at most limit characters, joined by single spaces."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s, x):
        fits = (s["open"] == "") | (F.length(s["open"]) + 1 + F.length(x) <= limit)
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x))
        return F.struct(F.when(fits, s["done"]).otherwise(F.array_append(s["done"], s["open"])).alias("done"), F.when(fits, joined).otherwise(x).alias("open"))

    return F.aggregate(pieces, zero, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def hard_cut(word: Column, limit: int) -> Column:
    """A word longer than limit as pieces of limit characters."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(word) - 1) / limit).cast("int")), lambda k: F.substring(word, k * limit + 1, F.lit(limit)))


def pack_sentences(text: Column, limit: int) -> Column:
    """Text as pieces of at most limit characters: whole sentences are packed while they fit; words of an over-long one follow in its place.

    A text within the limit stays one piece; a word beyond it is cut.
    """
    bare = strip(F.coalesce(text, F.lit("")))
    short = lambda s: F.length(s) <= limit
    by_words = lambda s: F.flatten(F.transform(F.filter(F.split(s, r"\s+"), lambda w: w != ""), lambda w: F.when(short(w), F.array(w)).otherwise(hard_cut(w, limit))))
    pieces = F.flatten(F.transform(sentences(bare), lambda s: F.when(short(s), F.array(s)).otherwise(pack(by_words(s), limit))))
    return F.when(bare == "", F.array().cast("array<string>")).when(short(bare), F.array(bare)).otherwise(pack(pieces, limit))
