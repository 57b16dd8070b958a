"""Values as the labels' definitions see them: Python's float(), types by trial, missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIGITS = "[0-9]+(?:_[0-9]+)*"
#: What float() takes, but for white space around it; what int() takes.
FLOAT = rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"
INT = rf"^[+-]?{_DIGITS}$"


def kind_of_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "float" if isinstance(kind, (T.FractionalType, T.DecimalType)) else "int"
    return "str"


def _bare(column: Column) -> Column:
    return F.regexp_replace(F.btrim(column.cast("string"), F.lit(" \t\n\x0b\x0c\r")), "_", "")


def as_float(column: Column, kind: T.DataType) -> Column:
    """float(value), null where it fails. NaN and infinities pass, as text too."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    text = F.btrim(column.cast("string"), F.lit(" \t\n\x0b\x0c\r"))
    word = F.lower(F.regexp_replace(text, "^[+-]", ""))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    special = F.when(word == "nan", F.lit(float("nan"))).when(word.isin("inf", "infinity"), sign * F.lit(float("inf")))
    return F.when(text.rlike(FLOAT), F.coalesce(special, F.expr("try_cast(NULL AS double)"), _bare(column).try_cast("double")))


def missing(column: Column, kind: T.DataType) -> Column:
    """Null, NaN, or the text NaN."""
    out = column.isNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return out | F.isnan(column)
    return out | (column == "NaN") if isinstance(kind, T.StringType) else out


def nulled(df: DataFrame) -> DataFrame:
    """df with every missing marker as null, as exports need it."""
    return df.select(*(F.when(~missing(F.col(f"`{f.name}`"), f.dataType), F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields))


def value_kind(column: Column, kind: T.DataType) -> Column:
    """int, float, none or str, by trial in this order; a float value is an int unless it is NaN or infinite."""
    base = kind_of_type(kind)
    if base in ("int", "bool"):
        return F.when(column.isNull(), "none").otherwise("int")
    if base == "float":
        x = column.cast("double")
        return F.when(column.isNull(), "none").when(F.isnan(x) | (F.abs(x) == float("inf")), "float").otherwise("int")
    text = F.btrim(column.cast("string"), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(column.isNull(), "none").when(text.rlike(INT), "int").when(text.rlike(FLOAT), "float").otherwise("str")
