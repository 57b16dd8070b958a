"""Tables by format or by name."""

from __future__ import annotations

import ast
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str, reader: Callable[..., DataFrame]) -> None:
    """reader(spark, **options)."""
    _SOURCES[name] = reader


def source(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in _SOURCES:
        raise LookupError(f"no source {name!r}; there are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name](spark, **options)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, lists: tuple[str, ...] = ("labels", "_labels"), line_breaks: bool = True) -> DataFrame:
    """A CSV file with names in its first line. Without a schema, types are inferred by a pass over the file. Columns in
    lists that hold rendered label lists become arrays again. line_breaks: values may hold some, so each file is read by
    one task; a large file without any is read by many if that is said."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    for name in lists:
        if name in df.columns and isinstance(df.schema[name].dataType, T.StringType):
            df = df.withColumn(name, parsed_labels(F.col(name)))
    return df


def parsed_labels(text):
    """The strings of a rendered list such as ['A', 'B', 1.5], without its numbers."""
    quoted = F.regexp_extract_all(text, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    return F.transform(quoted, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))


for _name, _reader in {
    "csv": lambda spark, path, **o: read_csv(spark, path, **o),
    "parquet": lambda spark, path: spark.read.parquet(path),
    "json": lambda spark, path, schema=None: spark.read.schema(schema).json(path) if schema else spark.read.json(path),
    "orc": lambda spark, path: spark.read.orc(path),
    "table": lambda spark, name: spark.table(name),
    "CSVDataSource": lambda spark, filename: read_csv(spark, filename),
}.items():
    register_source(_name, _reader)


def literal(text: str):
    """The Python literal that a text is, else the text: configuration values are never run as code."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def dict_to_text(data: dict) -> str | None:
    """JSON; None, with a word in the log, if it has no such form."""
    try:
        return json.dumps(data)
    except (TypeError, ValueError):
        logging.getLogger(__name__).exception("no JSON")
        return None


def text_to_dict(text: str) -> dict | None:
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        logging.getLogger(__name__).exception("no JSON")
        return None
