"""Scorers: StatisticalNGramAnomaly, SVDAnomaly, IFAnomaly, LOFAnomaly, SupervisedClassifierAnomaly."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions.text import combinations
from tagsmith.operators.labelsets import MOST_LABELS, Scorer, ScorerModel, VectorModel, gram_matrix, label_sets, n_hot, sorted_labels, top_directions, vocabulary
from tagsmith.sources.store import bounded, kept

UNSEEN = -math.log(1e-8)
ORDERS = (1, 2, 3)


def bonus_sum() -> Column:
    return F.coalesce(F.aggregate("bonus", F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


# --- n-grams of labels


def combination_counts(sets: DataFrame) -> DataFrame:
    """size, gram and n of all combinations of one, two and three of a row's sorted labels."""
    each = F.array(*(F.struct(F.lit(k).alias("size"), combinations(F.col("key"), k).alias("grams")) for k in ORDERS))
    out = sets.select("n", F.explode(each).alias("e")).select("n", "e.size", F.explode("e.grams").alias("gram"))
    return out.groupBy("size", "gram").agg(F.sum("n").alias("n"))


def negative_logs(counts: DataFrame) -> DataFrame:
    """cost = -ln(n / total of the size)."""
    total = counts.groupBy("size").agg(F.sum("n").alias("total"))  # three rows
    return counts.join(F.broadcast(total), "size").select("size", "gram", "n", (-F.ln(F.col("n") / F.col("total"))).alias("cost"))


class StatisticalNGramAnomaly(Scorer):
    def fit(self, df: DataFrame, base: ScorerModel | None = None) -> NGramModel:
        counts = combination_counts(label_sets(df, distinct=False))
        if base is not None:
            counts = counts.unionByName(base.tables["combinations"]).groupBy("size", "gram").agg(F.sum("n").alias("n"))
        return NGramModel({}, {"combinations": kept(counts, "combinations")})


class NGramModel(ScorerModel):
    kind = "StatisticalNGramAnomaly"

    def __init__(self, params: dict, tables: dict[str, DataFrame]):
        self.params, self.tables = params, tables

    def score(self, df: DataFrame) -> DataFrame:
        sets = df.select(sorted_labels().alias("key")).distinct()
        each = F.array(*(combinations(F.col("key"), k) for k in ORDERS))
        grams = sets.select("key", F.explode(F.flatten(each)).alias("gram"))
        cost = grams.join(negative_logs(self.tables["combinations"]).select("gram", "cost"), "gram", "left")
        scored = cost.groupBy("key").agg(F.sum(F.coalesce("cost", F.lit(UNSEEN))).alias("set_score")).withColumnRenamed("key", "set_key")
        out = df.join(scored, sorted_labels() == F.col("set_key"), "left")
        return out.withColumn("score", F.coalesce("set_score", F.lit(0.0)) + bonus_sum()).drop("set_key", "set_score")

    def _costs(self) -> dict:
        if not hasattr(self, "_dict"):
            self._dict = {tuple(r.gram): r.cost for r in bounded(negative_logs(self.tables["combinations"]))}
        return self._dict

    def score_stream(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self._costs())  # bounded by DRIVER_ROWS

        @F.pandas_udf("double")
        def cost(keys: pd.Series) -> pd.Series:
            known: dict = {}
            for k in {tuple(sorted(k)) if k is not None else () for k in keys}:
                known[k] = _cost(k, shared.value)
            return pd.Series([known[tuple(sorted(k)) if k is not None else ()] for k in keys], index=keys.index)

        return df.withColumn("score", cost(F.col("labels")) + bonus_sum())

    def score_one(self, labels: list[str], bonus: list[float]) -> float:
        return _cost(tuple(sorted(labels)), self._costs()) + sum(bonus)


def _cost(key: tuple[str, ...], costs: dict) -> float:
    return sum(costs.get(c, UNSEEN) for k in ORDERS for c in itertools.combinations(key, k))


# --- reconstruction error


class SVDAnomaly(Scorer):
    def __init__(self, components: int = 4):
        self.k = components

    def fit(self, df: DataFrame, base: ScorerModel | None = None) -> SVDModel:
        sets = kept(label_sets(df, distinct=True), "label-sets")
        labels = vocabulary(sets)
        gram = gram_matrix(sets, labels)
        if base is not None:
            both = sorted({*labels, *base.params["labels"]})
            gram = _placed(gram, labels, both) + _placed(np.array(base.params["gram"]), base.params["labels"], both)
            labels = both
        return SVDModel({"labels": labels, "gram": gram.tolist(), "k": self.k})


def _placed(gram: np.ndarray, own: list[str], all_: list[str]) -> np.ndarray:
    at = [all_.index(x) for x in own]
    out = np.zeros((len(all_), len(all_)))
    out[np.ix_(at, at)] = gram.reshape(len(own), len(own))
    return out


class SVDModel(VectorModel):
    kind = "SVDAnomaly"

    def __init__(self, params: dict, tables: dict | None = None):
        self.params = params
        self.directions = top_directions(np.array(params["gram"]).reshape(len(params["labels"]), -1), params["k"])

    def values(self, keys) -> np.ndarray:
        x = n_hot(keys, self.params["labels"])
        return np.sqrt(np.maximum(0, (x**2).sum(1) - ((x @ self.directions) ** 2).sum(1)))


def _projected(df: DataFrame, k: int = 4) -> tuple[list[str], np.ndarray, DataFrame]:
    sets = kept(label_sets(df, distinct=True), "label-sets")
    labels = vocabulary(sets)
    return labels, top_directions(gram_matrix(sets, labels), k), sets


# --- isolation forest


def average_path(n: float) -> float:
    """c(n): the mean depth of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> list:
    """A node is [feature, split, below, above], a leaf [what its rows add to the path]."""
    low, high = x.min(0), x.max(0)
    usable = np.flatnonzero(high > low)
    if depth == 0 or len(x) <= 1 or not len(usable):
        return [average_path(len(x))]
    f = int(rng.choice(usable))
    split = float(rng.uniform(low[f], high[f]))
    below = x[:, f] <= split
    return [f, split, grow_tree(x[below], depth - 1, rng), grow_tree(x[~below], depth - 1, rng)]


def path_lengths(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    out, below = np.ones(len(x)), x[:, tree[0]] <= tree[1]
    out[below] += path_lengths(tree[2], x[below])
    out[~below] += path_lengths(tree[3], x[~below])
    return out


def without_replacement(rng: np.random.Generator, n: np.ndarray, size: int) -> np.ndarray:
    """How many of each kind a draw of size among n.sum() rows has, at any number of rows."""
    ends, rows = np.cumsum(n), set()
    while len(rows) < size:
        rows.add(int(rng.integers(0, int(ends[-1]))))
    return np.bincount(np.searchsorted(ends, sorted(rows), "right"), minlength=len(n))


class IFAnomaly(Scorer):
    """trees, each on `sample` rows drawn without replacement; distinct sets of labels stand for their rows."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 0):
        self.trees, self.size, self.seed = trees, sample, seed

    def fit(self, df: DataFrame, base: ScorerModel | None = None) -> ForestModel:
        labels, directions, sets = _projected(df)
        counted = bounded(sets)
        x = n_hot([r.key for r in counted], labels) @ directions
        n = np.array([r.n for r in counted], np.int64)
        order = sorted(range(len(counted)), key=lambda i: counted[i].key)
        x, n = x[order], n[order]
        rng, psi, trees = np.random.default_rng(self.seed), int(min(self.size, n.sum())), []
        for _ in range(self.trees):  # psi rows without replacement, as counts of the distinct sets
            rows = np.repeat(x, without_replacement(rng, n, psi), axis=0)
            trees.append(grow_tree(rows, max(1, math.ceil(math.log2(max(2, psi)))), rng))
        return ForestModel({"labels": labels, "directions": directions.tolist(), "trees": trees, "psi": psi})


class ForestModel(VectorModel):
    kind = "IFAnomaly"

    def __init__(self, params: dict, tables: dict | None = None):
        self.params = params

    def values(self, keys) -> np.ndarray:
        x = n_hot(keys, self.params["labels"]) @ np.array(self.params["directions"]).reshape(len(self.params["labels"]), -1)
        mean = np.mean([path_lengths(t, x) for t in self.params["trees"]], axis=0)
        return 2 ** (-mean / max(1e-12, average_path(self.params["psi"])))


# --- local outlier factor


class LOFAnomaly(Scorer):
    """neighbours: k. Distinct sets of labels stand for their rows; there must be few enough to compare all with all."""

    def __init__(self, neighbours: int = 10):
        self.k = neighbours

    def fit(self, df: DataFrame, base: ScorerModel | None = None) -> LOFModel:
        labels, directions, sets = _projected(df)
        counted = sorted(bounded(sets, MOST_LABELS), key=lambda r: r.key)
        x, n = n_hot([r.key for r in counted], labels) @ directions, [int(r.n) for r in counted]
        return LOFModel({"labels": labels, "directions": directions.tolist(), "points": x.tolist(), "n": n, "k": self.k})


def neighbours(d: np.ndarray, n: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of distances to weighted points: the points among the k nearest and how many of each."""
    out = []
    for row in d:
        order = np.argsort(row, kind="stable")
        taken = np.minimum(np.cumsum(n[order]), k)
        take = np.diff(np.r_[0, taken])
        some = take > 0
        out.append((order[some], take[some]))
    return out


class LOFModel(VectorModel):
    kind = "LOFAnomaly"

    def __init__(self, params: dict, tables: dict | None = None):
        self.params = params
        self.x, self.n = np.array(params["points"]).reshape(len(params["n"]), -1), np.array(params["n"], np.int64)
        self.k = max(1, min(params["k"], int(self.n.sum()) - 1)) if len(self.n) else 1
        if not len(self.n):
            return
        d = _distances(self.x, self.x)
        # a training row isn't its own neighbour: each point is seen with one row less
        self.near = []
        for i, row in enumerate(d):
            n = self.n.copy()
            n[i] -= 1
            self.near.append(neighbours(row[None, :], n, self.k)[0])
        self.kdist = np.array([row[at].max() if len(at) else 0.0 for row, (at, _) in zip(d, self.near, strict=True)])
        self.density = np.array([self._density(row, at, take) for row, (at, take) in zip(d, self.near, strict=True)])

    def _density(self, row: np.ndarray, at: np.ndarray, take: np.ndarray) -> float:
        return 1 / ((np.maximum(row[at], self.kdist[at]) * take).sum() / max(1, take.sum()) + 1e-10)

    def values(self, keys) -> np.ndarray:
        if not len(self.n):
            return np.ones(len(keys))
        x = n_hot(keys, self.params["labels"]) @ np.array(self.params["directions"]).reshape(len(self.params["labels"]), -1)
        d = _distances(x, self.x)
        out = []
        for row, (at, take) in zip(d, neighbours(d, self.n, self.k), strict=True):
            out.append((self.density[at] * take).sum() / take.sum() / self._density(row, at, take))
        return np.array(out)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)))


# --- supervised

#: Names and arguments of classifiers, as configurations have them, and pyspark.ml's.
CLASSIFIERS = {
    "LogisticRegression": ("LogisticRegression", {"max_iter": "maxIter", "fit_intercept": "fitIntercept", "tol": "tol", "C": None}),
    "RandomForestClassifier": ("RandomForestClassifier", {"n_estimators": "numTrees", "max_depth": "maxDepth", "random_state": "seed"}),
    "ExtraTreesClassifier": ("RandomForestClassifier", {"n_estimators": "numTrees", "max_depth": "maxDepth", "random_state": "seed"}),
    "DecisionTreeClassifier": ("DecisionTreeClassifier", {"max_depth": "maxDepth", "random_state": "seed"}),
    "GradientBoostingClassifier": ("GBTClassifier", {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize", "random_state": "seed"}),
    "BernoulliNB": ("NaiveBayes", {"alpha": "smoothing"}),
    "MultinomialNB": ("NaiveBayes", {"alpha": "smoothing"}),
    "MLPClassifier": ("MultilayerPerceptronClassifier", {"max_iter": "maxIter", "random_state": "seed", "hidden_layer_sizes": None}),
}


def _repeated(df: DataFrame, n: str, piece: int = 100_000) -> DataFrame:
    """Each row n times. A row that counts for many goes out in pieces, which many tasks repeat."""
    parts = df.withColumn("__part", F.explode(F.sequence(F.lit(0), F.expr(f"({n} - 1) div {piece}"))))
    parts = parts.withColumn(n, F.least(F.lit(piece), F.col(n) - F.col("__part") * piece))
    return parts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("__part", F.explode(F.sequence(F.lit(1), F.col(n)))).drop("__part", n)


class SupervisedClassifierAnomaly(Scorer):
    """classifier: its name, with or without the module. Truth {clean, bad} or {0, 1} gives the probability of bad; any
    other truth gives the predicted value in the column predicted, and as the score its index in sorted order. The model
    keeps how many rows have each set of labels and truth; with a base, fit() learns from the base's rows and the new ones."""

    def __init__(self, ground_truth_column: str, classifier: str, **arguments):
        self.truth, self.name = ground_truth_column, classifier.rpartition(".")[2]
        if self.name not in CLASSIFIERS:
            raise ValueError(f"classifier {classifier!r}; there are {', '.join(CLASSIFIERS)}")
        unknown = set(arguments) - set(CLASSIFIERS[self.name][1])
        if unknown:
            raise ValueError(f"{self.name} has no argument {', '.join(sorted(unknown))}")
        self.arguments = arguments

    def fit(self, df: DataFrame, base: ScorerModel | None = None) -> SupervisedModel:
        from pyspark.ml import classification
        from pyspark.ml.feature import CountVectorizerModel

        examples = df.select(F.array_distinct(sorted_labels()).alias("key"), F.col(f"`{self.truth}`").cast("string").alias("truth"), F.lit(1).cast("long").alias("n"))
        if base is not None:
            examples = examples.unionByName(base.tables["examples"])
        examples = kept(examples.groupBy("key", "truth").agg(F.sum("n").alias("n")), "examples")
        labels = vocabulary(examples) or [""]
        values = [r.truth for r in bounded(examples.select("truth").filter("truth IS NOT NULL").distinct().orderBy("truth"), 1000)]
        binary = set(values) <= {"clean", "bad"} or set(values) <= {"0", "1"}
        classes = (["clean", "bad"] if set(values) <= {"clean", "bad"} else ["0", "1"]) if binary else values
        index = F.array_position(F.array(*map(F.lit, classes)), F.col("truth")) - 1
        vector = CountVectorizerModel.from_vocabulary(labels, inputCol="__key", outputCol="__x", minTF=1.0)
        vector.setBinary(True)
        own = examples.select(F.col("key").alias("__key"), index.cast("double").alias("__y"), F.col("n").alias("__n")).filter("__y >= 0")
        ml, names = CLASSIFIERS[self.name]
        arguments = {names[k]: v for k, v in self.arguments.items() if names[k]}
        if ml == "LogisticRegression":
            arguments |= {"standardization": False, "regParam": 1 / (float(self.arguments.get("C", 1.0)) * max(1, own.agg(F.sum("__n")).first()[0] or 0))}
        elif self.name == "BernoulliNB":
            arguments["modelType"] = "bernoulli"
        elif ml == "MultilayerPerceptronClassifier":
            hidden = self.arguments.get("hidden_layer_sizes", (100,))
            arguments["layers"] = [len(labels), *((hidden,) if isinstance(hidden, int) else hidden), max(2, len(classes))]
        if ml in ("RandomForestClassifier", "MultilayerPerceptronClassifier"):  # these draw rows, or know no weights
            own = _repeated(own, "__n")
        else:
            arguments["weightCol"] = "__n"
        model = getattr(classification, ml)(featuresCol="__x", labelCol="__y", predictionCol="__p", probabilityCol="__prob", rawPredictionCol="__raw", **arguments).fit(vector.transform(own))
        return SupervisedModel({"labels": labels, "classes": classes, "binary": binary, "ml": ml}, {"examples": examples}, model)


class SupervisedModel(ScorerModel):
    kind = "SupervisedClassifierAnomaly"

    def __init__(self, params: dict, tables: dict | None = None, model=None):
        self.params, self.tables, self.model = params, tables or {}, model

    def score(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import CountVectorizerModel
        from pyspark.ml.functions import vector_to_array

        vector = CountVectorizerModel.from_vocabulary(self.params["labels"], inputCol="__key", outputCol="__x", minTF=1.0)
        vector.setBinary(True)
        out = self.model.transform(vector.transform(df.withColumn("__key", sorted_labels())))
        if self.params["binary"]:
            out = out.withColumn("score", vector_to_array("__prob")[1])
        else:
            out = out.withColumn("score", F.col("__p")).withColumn("predicted", F.element_at(F.array(*map(F.lit, self.params["classes"])), F.col("__p").cast("int") + 1))
        return out.drop("__key", "__x", "__prob", "__raw", "__p")

    def score_one(self, labels: list[str], bonus: list[float]):
        from pyspark.ml.linalg import Vectors

        at = {x: i for i, x in enumerate(self.params["labels"])}
        x = Vectors.sparse(len(at), sorted((at[k], 1.0) for k in set(labels) if k in at))
        if self.params["binary"]:
            return float(self.model.predictProbability(x)[1])
        return self.params["classes"][int(self.model.predict(x))]


SCORERS = {c.__name__: c for c in (StatisticalNGramAnomaly, SVDAnomaly, IFAnomaly, LOFAnomaly, SupervisedClassifierAnomaly)}
MODELS = {c.kind: c for c in (NGramModel, SVDModel, ForestModel, LOFModel, SupervisedModel)}
