"""Where fitted tables live: in the session as lazy plans, or in a folder as Parquet with a manifest."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a model table that may be brought to the driver, for single-row scoring and broadcasts.
DRIVER_ROWS = 200_000


class TooLarge(ValueError):
    """A table that has no place on the driver."""


def bounded(df: DataFrame, most: int = DRIVER_ROWS) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooLarge(f"more than {most} rows")
    return rows


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file at any path that Spark reaches."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def save(spark: SparkSession, path: str, manifest: dict, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))


def load(spark: SparkSession, path: str) -> tuple[dict, callable]:
    """The manifest, and a function that gives a table by name."""
    return json.loads(read_text(spark, f"{path}/manifest.json")), lambda name: spark.read.parquet(f"{path}/{name}")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share, as spark.checkpoint.dir names it; where that is unset, in a
    temporary one of this machine, if Spark runs on this machine alone. Raises RuntimeError on a cluster without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tagsmith-scratch"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, computed once and read back from the shared folder."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
