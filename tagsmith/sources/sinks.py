"""Scored tables to CSV, JSON lines, or a search service's bulk interface."""

from __future__ import annotations

import itertools
import json
import logging
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.functions.coerce import nulled

log = logging.getLogger(__name__)


def rendered_labels(labels: Column, bonus: Column | None = None) -> Column:
    """A list as text: ['A', 'B', 12.5], numbers last."""
    quoted = F.transform(labels, lambda x: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'")))
    every = quoted if bonus is None else F.concat(quoted, F.transform(bonus, lambda x: x.cast("string")))
    return F.concat(F.lit("["), F.array_join(every, ", "), F.lit("]"))


def for_csv(df: DataFrame) -> DataFrame:
    """Arrays of strings as rendered lists, the bonus within the labels, other nested columns as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "bonus" and "labels" in df.columns:
            continue
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = rendered_labels(c, F.col("bonus") if f.name == "labels" and "bonus" in df.columns else None)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    for_csv(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def exported(df: DataFrame, model: str) -> DataFrame:
    """What an index gets: the model's name, the labels as text, and every missing value as null."""
    return nulled(df.withColumn("model", F.lit(model)).withColumn("raw", rendered_labels(F.col("labels"), F.col("bonus") if "bonus" in df.columns else None)))


def write_json(df: DataFrame, path: str, model: str) -> None:
    exported(df, model).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def post(url: str) -> Callable[[str], None]:
    """Sends a body of lines to a bulk interface."""

    def send(body: str) -> None:
        request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/x-ndjson"}, method="POST")
        with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310
            answer.read()

    return send


def write_bulk(df: DataFrame, model: str, send: Callable[[str], None], index: str = "anomalies", batch: int = 500) -> None:
    """Partitions send their rows in batches, as they come. A batch that fails is logged, and the next ones are sent all
    the same; the job, which has its results elsewhere, goes on. Repeated tasks may send rows twice."""

    def each(rows: Iterator) -> None:
        while own := list(itertools.islice(rows, batch)):
            try:
                send("".join(f"{json.dumps({'index': {'_index': index}})}\n{r[0]}\n" for r in own))
            except Exception:
                log.exception("%d rows weren't sent", len(own))

    exported(df, model).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).foreachPartition(each)


def upload_json(spark, path: str, model: str, send: Callable[[str], None], index: str = "anomalies") -> None:
    """Rows of a JSON file of scored rows to a bulk interface."""
    df = spark.read.json(path)
    write_bulk(df if "labels" in df.columns else df.withColumn("labels", F.array().cast("array<string>")), model, send, index)
