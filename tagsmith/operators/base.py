"""What label generators and scorers are.

A generator's fit() gives a model. A model's attach() adds what it needs to a table (a join with its statistics, if it
has any) and returns the table with an expression: a struct of labels (array of strings) and bonus (array of doubles,
which add to the score). row() does the same for one record without Spark. merge() continues a fit with more data.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = "struct<labels:array<string>,bonus:array<double>>"


def result(labels: Iterable[Column] | Column, bonus: Column | None = None) -> Column:
    """labels: expressions of which those that are null fall out, or an array."""
    each = labels if isinstance(labels, Column) else F.array_compact(F.array(*labels))
    own = F.array().cast("array<double>") if bonus is None else F.when(bonus.isNotNull(), F.array(bonus)).otherwise(F.array().cast("array<double>"))
    return F.struct(each.cast("array<string>").alias("labels"), own.alias("bonus"))


def weight_of(weight: str | None) -> Column:
    return F.lit(1).cast("long") if weight is None else F.col(f"`{weight}`").cast("long")


def as_list(names: str | Iterable[str] | None) -> list[str]:
    return [] if names is None else [names] if isinstance(names, str) else list(names)


def join_stats(df: DataFrame, stats: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Left join with a table of statistics on equal keys, null included; its columns get the tag in front."""
    right = stats.select(*(F.col(f"`{c}`").alias(f"{tag}{c}") for c in stats.columns), F.lit(True).alias(f"{tag}seen"))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{tag}{k}`")) for k in keys]
    return df.join(right, on, "left")


class GeneratorModel(ABC):
    """params: what the manifest keeps. tables: the model's statistics."""

    kind: str
    params: dict
    tables: dict[str, DataFrame]

    @abstractmethod
    def attach(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]: ...

    @abstractmethod
    def row(self, record: dict) -> tuple[list[str], list[float]]: ...

    def merge(self, other: GeneratorModel) -> GeneratorModel:
        """Models without statistics have nothing to merge."""
        return other

    def _local(self, name: str, build: Callable) -> dict:
        """A table as a dictionary on the driver, once; only if it is small."""
        cache = self.__dict__.setdefault("_dicts", {})
        if name not in cache:
            cache[name] = build()
        return cache[name]


class Generator(ABC):
    @abstractmethod
    def fit(self, df: DataFrame, weight: str | None = None, base: GeneratorModel | None = None) -> GeneratorModel: ...


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType
