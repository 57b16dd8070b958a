"""Tokens, n-grams and combinations as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, BEGIN, END = "<UNK>", "<s>", "</s>"


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of letters and digits; every other character but a space by itself."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^ \p{L}\p{N}]"), F.lit(0))


def tokenized(text: Column, mode: str) -> Column:
    if mode not in ("char", "token"):
        raise ValueError(f"lm_mode: {mode!r}")
    return characters(text) if mode == "char" else tokens(text)


def words(text: Column) -> Column:
    """What stands between characters that are neither ASCII letters nor digits."""
    return F.split(F.regexp_replace(text, "[^0-9a-zA-Z]+", " "), " ")


def _indices(first: int, last: Column) -> Column:
    """first to last; none if last is smaller (sequence would count down)."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


#: Between the tokens of an n-gram.
BETWEEN = "\x01"


def ngrams(items: Column, low: int, high: int) -> Column:
    """The n-grams of each order from low to high, between low - 1 begin and end marks, as joined strings; of each order
    the last is left out."""
    marks = lambda m: F.array_repeat(F.lit(m), low - 1)
    padded = F.concat(marks(BEGIN), items, marks(END))
    order = lambda p, n: F.transform(_indices(1, F.size(p) - n), lambda i: F.array_join(F.slice(p, i, n), BETWEEN))
    # the padded array is made once, as the only element of an array, not anew for each n-gram
    return F.flatten(F.transform(F.array(padded), lambda p: F.concat(*(order(p, n) for n in range(low, high + 1)))))


def combinations(items: Column, size: int) -> Column:
    """All combinations of positions of a sorted array, as arrays of 1, 2 or 3 items; repeated items count."""
    n = F.size(items)
    at = lambda i: F.element_at(items, i)
    if size == 1:
        return F.transform(items, lambda x: F.array(x))
    rest = lambda i: F.slice(items, i + 1, n)
    pairs = F.flatten(F.transform(_indices(1, n - 1), lambda i: F.transform(rest(i), lambda x: F.array(at(i), x))))
    if size == 2:
        return pairs
    inner = lambda i, j: F.transform(rest(j), lambda x: F.array(at(i), at(j), x))
    third = lambda i: F.flatten(F.transform(F.when(n - 1 > i, F.sequence(i + 1, n - 1)).otherwise(F.array().cast("array<int>")), lambda j: inner(i, j)))
    return F.flatten(F.transform(_indices(1, n - 2), third))
