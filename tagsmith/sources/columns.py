"""A table's columns one at a time: statistics, values, assignment. Each is one lazy plan or one small job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tagsmith.sources.store import bounded


class ColumnView:
    def __init__(self, df: DataFrame, name: str):
        self.df, self.name, self.column = df, name, F.col(f"`{name}`")

    def _one(self, expression: Column):
        return self.df.agg(expression).first()[0]

    def mean(self) -> float:
        return self._one(F.avg(self.column))

    def std(self, population: bool = False) -> float:
        return self._one((F.stddev_pop if population else F.stddev_samp)(self.column))

    def min(self):
        return self._one(F.min(self.column))

    def max(self):
        return self._one(F.max(self.column))

    def unique(self) -> DataFrame:
        return self.df.select(self.column).distinct()

    def value_counts(self) -> DataFrame:
        return self.df.groupBy(self.column).count()

    def tolist(self) -> list:
        """All values, if they are few."""
        return [r[0] for r in bounded(self.df.select(self.column))]

    def apply(self, function: Callable, returns: str) -> DataFrame:
        """The table with the column's values replaced by the function's."""

        @F.pandas_udf(returns)
        def each(values: pd.Series) -> pd.Series:
            return values.map(function)

        return self.df.withColumn(self.name, each(self.column))

    def __len__(self) -> int:
        return self.df.count()

    def replaced(self, where: Column, value) -> DataFrame:
        return self.df.withColumn(self.name, F.when(where, F.lit(value)).otherwise(self.column))


class TableView:
    """Rows and columns of a table by position and name."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[Row]:
        """Rows by way of the driver, some partitions at a time: for small tables and looks at data."""
        return self.df.toLocalIterator()

    def __getitem__(self, key):
        """A column by name; the first rows by number or slice."""
        if isinstance(key, str):
            return ColumnView(self.df, key)
        if isinstance(key, slice):
            return [r.asDict() for r in self.df.limit(key.stop).collect()[key]]
        return self.df.limit(key + 1).collect()[key].asDict()

    def with_column(self, name: str, values: Column) -> TableView:
        return TableView(self.df.withColumn(name, values))

    def apply_columns(self, function: Callable[[ColumnView], Column]) -> DataFrame:
        """One row: an aggregate of each column."""
        return self.df.agg(*(function(ColumnView(self.df, c)).alias(c) for c in self.df.columns))

    def apply_rows(self, function: Callable[[dict], object], returns: str, name: str = "result") -> DataFrame:
        """A new column with the function's value of each row."""

        @F.pandas_udf(returns)
        def each(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([function(r) for r in rows.to_dict("records")], index=rows.index)

        return self.df.withColumn(name, each(F.struct(*(F.col(f"`{c}`") for c in self.df.columns))))
