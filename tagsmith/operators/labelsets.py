"""Rows seen as sets of labels. Labels come from a small alphabet, so distinct sets are few: what depends on the labels
alone is computed once for each distinct set, weighted by its rows, and joined back."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.sources.store import bounded

#: Labels up to which a matrix of labels by labels is held on the driver.
MOST_LABELS = 4096


def sorted_labels(labels: str = "labels") -> Column:
    return F.array_sort(F.coalesce(F.col(f"`{labels}`"), F.array().cast("array<string>")))


def label_sets(df: DataFrame, distinct: bool, labels: str = "labels") -> DataFrame:
    """key (sorted labels, with or without repeats) and n (rows)."""
    key = F.array_distinct(sorted_labels(labels)) if distinct else sorted_labels(labels)
    return df.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(sets: DataFrame) -> list[str]:
    return [r.label for r in bounded(sets.select(F.explode("key").alias("label")).distinct().orderBy("label"), MOST_LABELS)]


def gram_matrix(sets: DataFrame, labels: list[str]) -> np.ndarray:
    """The sum over rows of x xᵀ, x being a row's labels as 0 and 1: counts of pairs, so sums of two tables add."""
    own = sets.select("n", F.transform("key", lambda x: F.array_position(F.array(*map(F.lit, labels)), x).cast("int") - 1).alias("key"))
    pairs = own.select("n", F.explode("key").alias("a"), "key").select("n", "a", F.explode("key").alias("b")).filter("a <= b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    found, out = pairs.toArrow(), np.zeros((len(labels), len(labels)))  # 16 bytes for each of at most MOST_LABELS squared / 2
    a, b, n = (found.column(c).to_numpy() for c in ("a", "b", "n"))
    out[a, b] = out[b, a] = n
    return out


def top_directions(gram: np.ndarray, k: int = 4) -> np.ndarray:
    """The k leading right singular vectors of the uncentred matrix, columns; each with its largest entry positive."""
    values, vectors = np.linalg.eigh(gram)
    best = vectors[:, np.argsort(-values, kind="stable")[: min(k, len(values))]]
    for c in range(best.shape[1]):
        if best[np.argmax(np.abs(best[:, c])), c] < 0:
            best[:, c] *= -1
    return best


def n_hot(keys, labels: list[str]) -> np.ndarray:
    """Rows of 0 and 1; labels that aren't in the vocabulary count for nothing."""
    at, out = {x: i for i, x in enumerate(labels)}, np.zeros((len(keys), len(labels)))
    for i, key in enumerate(keys):
        for x in key if key is not None else ():
            if x in at:
                out[i, at[x]] = 1
    return out


class Scorer(ABC):
    @abstractmethod
    def fit(self, df: DataFrame, base: ScorerModel | None = None) -> ScorerModel: ...


class ScorerModel(ABC):
    """kind and params go to the manifest, tables to Parquet."""

    kind: str
    params: dict
    tables: dict[str, DataFrame] = {}

    @abstractmethod
    def score(self, df: DataFrame) -> DataFrame:
        """df with the column score; higher is more anomalous."""

    @abstractmethod
    def score_one(self, labels: list[str], bonus: list[float]): ...

    def score_stream(self, df: DataFrame) -> DataFrame:
        """The same without any aggregation, for unbounded tables."""
        return self.score(df)


class VectorModel(ScorerModel):
    """A model whose score is a function of the set of labels, computed for batches of them."""

    def values(self, keys: list[list[str]]) -> np.ndarray:
        raise NotImplementedError

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", self.score_column(F.col("labels")))

    def score_column(self, labels: Column) -> Column:
        shared = labels_broadcast(self)

        @F.pandas_udf("double")
        def values(keys: pd.Series) -> pd.Series:
            model, own = shared.value, [tuple(sorted(set(k))) if k is not None else () for k in keys]
            each = list(dict.fromkeys(own))
            score = dict(zip(each, model.values(each), strict=True)) if each else {}
            return pd.Series([float(score[k]) for k in own], index=keys.index)

        return values(labels)

    def score_one(self, labels: list[str], bonus: list[float]) -> float:
        return float(self.values([sorted(set(labels))])[0])


def labels_broadcast(model: VectorModel):
    """The model's own arrays: bounded by its parameters and MOST_LABELS."""
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)
