"""Column builders for the token views every text metric shares.

Each takes and returns a Column and stays inside the JVM. ``null`` text counts as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Z}]+"
EDGE_WS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def txt(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Unicode-aware strip (``trim`` removes only spaces)."""
    return F.regexp_replace(txt(c), EDGE_WS, "")


def is_blank(c: Column) -> Column:
    """Null, empty or only whitespace; ends at the first other character."""
    return ~txt(c).rlike(r"[^\s\p{Z}]")


def alpha_words(c: Column) -> Column:
    """Maximal runs of a-z in the lower-cased text."""
    return F.regexp_extract_all(F.lower(txt(c)), F.lit("[a-z]+"), F.lit(0))


def az09_words(c: Column) -> Column:
    """Maximal runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(txt(c)), F.lit("[a-z0-9]+"), F.lit(0))


def word_runs(c: Column) -> Column:
    """Unicode word runs, the portable form of a word-boundary test."""
    return F.regexp_extract_all(F.lower(txt(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ws_tokens(c: Column) -> Column:
    return F.filter(F.split(txt(c), WS), lambda x: x != "")


def sentence_parts(c: Column) -> Column:
    return F.filter(F.split(F.trim(txt(c)), "[.!?]+"), lambda x: F.trim(F.regexp_replace(x, WS, " ")) != "")


def ngrams(words: Column, n: int, sep: str = " ") -> Column:
    """Word n-grams joined by ``sep``; an array shorter than ``n`` has none."""
    empty = F.array().cast("array<string>")
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), sep))
    return F.when(F.size(words) >= n, grams).otherwise(empty)


def count_in(words: Column, lexicon) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))
