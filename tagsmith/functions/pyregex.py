"""Python regular expressions in Java's dialect."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of Python's syntax, what Java doesn't have or means otherwise.
_FOREIGN = re.compile(r"\(\?P=|\(\?\(|\(\?[aLux]|\\Z|\\[0-7]{3}|\\N\{")


def to_java(pattern: str) -> str | None:
    """The pattern with Python's meaning of classes, dot and line ends; None if Java has no such pattern."""
    re.compile(pattern)
    if _FOREIGN.search(pattern) or re.search(r"\[[^\]]*(?:\[|&&)", pattern):
        return None
    return "(?dU)" + re.sub(r"\(\?P<", "(?<", pattern)


def search(column: Column, pattern: str) -> Column:
    """Whether re.search finds the pattern; false for null."""
    return _matches(column, pattern, "")


def match(column: Column, pattern: str) -> Column:
    """Whether re.match finds it, so at the start."""
    return _matches(column, pattern, r"\A")


def _matches(column: Column, pattern: str, anchor: str) -> Column:
    java = to_java(pattern)
    if java is not None:
        body = java.removeprefix("(?dU)")
        return F.coalesce(column.cast("string").rlike(f"(?dU){anchor}(?:{body})"), F.lit(False))

    @F.pandas_udf("boolean")
    def python(values: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        find = compiled.match if anchor else compiled.search
        return values.map(lambda v: v is not None and find(v) is not None).astype(bool)

    return F.coalesce(python(column.cast("string")), F.lit(False))
