"""Scorers against brute force and by what must hold for them."""

import itertools
import math
import random

import numpy as np
import pytest

from tagsmith.operators import anomaly
from tagsmith.operators.labelsets import n_hot, top_directions


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    sets = [[x for x in "ABCDE" if rng.random() < 0.5] for _ in range(120)] + [["Z", "Y"], ["A", "A", "B"], []]
    return sets, spark.createDataFrame([(i, s, [0.5] if i % 2 else []) for i, s in enumerate(sets)], "i int, labels array<string>, bonus array<double>")


def test_ngram(rows):
    sets, df = rows
    counts, total = {}, {1: 0, 2: 0, 3: 0}
    for s in sets:
        for k in (1, 2, 3):
            for c in itertools.combinations(sorted(s), k):
                counts[c] = counts.get(c, 0) + 1
                total[k] += 1
    cost = lambda c: -math.log(counts[c] / total[len(c)]) if c in counts else -math.log(1e-8)
    model = anomaly.StatisticalNGramAnomaly().fit(df)
    want = [sum(cost(c) for k in (1, 2, 3) for c in itertools.combinations(sorted(s), k)) + 0.5 * (i % 2) for i, s in enumerate(sets)]
    for score in (model.score, model.score_stream):
        assert [r.score for r in score(df).orderBy("i").collect()] == pytest.approx(want)
    assert model.score_one(["Q"], [1.0]) == pytest.approx(-math.log(1e-8) + 1)


def test_svd(rows):
    sets, df = rows
    model = anomaly.SVDAnomaly().fit(df)
    x = n_hot(sets, model.params["labels"])
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    low = vt[:4]
    assert [r.score for r in model.score(df).orderBy("i").collect()] == pytest.approx(np.linalg.norm(x - x @ low.T @ low, axis=1), abs=1e-6)
    few = anomaly.SVDAnomaly().fit(df.filter("i < 100").selectExpr("i", "filter(labels, x -> x in ('A', 'B', 'C')) AS labels", "bonus"))
    assert max(few.values([["A"], ["A", "B", "C"], ["NEW"]])) < 1e-6
    parts = anomaly.SVDAnomaly().fit(df.filter("i >= 60"), base=anomaly.SVDAnomaly().fit(df.filter("i < 60")))
    assert np.allclose(parts.params["gram"], model.params["gram"])


def test_forest(spark):
    sets = [["A"]] * 100 + [["A", "B"]] * 100 + [["Q"]]
    df = spark.createDataFrame([(i, s, []) for i, s in enumerate(sets)], "i int, labels array<string>, bonus array<double>")
    scores = [r.score for r in anomaly.IFAnomaly().fit(df).score(df).orderBy("i").collect()]
    assert all(0 < s < 1 for s in scores) and scores[200] == max(scores) > 0.6 > scores[0]
    assert scores == [r.score for r in anomaly.IFAnomaly().fit(df).score(df).orderBy("i").collect()]


def test_lof_by_brute_force(rows):
    sets, df = rows
    model = anomaly.LOFAnomaly().fit(df)
    x = n_hot([sorted(set(s)) for s in sets], model.params["labels"]) @ np.array(model.params["directions"])
    k = 10
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def nearest(row):  # ties are broken by the sorted sets, as the model has them
        return sorted(range(len(x)), key=lambda j: (row[j], sorted(set(sets[j]))))

    near = [[j for j in nearest(d[i]) if j != i][:k] for i in range(len(x))]
    kdist = [d[i][near[i][-1]] for i in range(len(x))]
    density = [1 / (np.mean([max(kdist[j], d[i][j]) for j in near[i]]) + 1e-10) for i in range(len(x))]
    got = [r.score for r in model.score(df).orderBy("i").collect()]
    for i in range(len(x)):
        own = nearest(d[i])[:k]
        want = np.mean([density[j] for j in own]) * (np.mean([max(kdist[j], d[i][j]) for j in own]) + 1e-10)
        assert got[i] == pytest.approx(want, rel=1e-4) or d[i][own[-1]] == pytest.approx(d[i][nearest(d[i])[k]]), i


def test_directions_are_fixed():
    g = np.diag([3.0, 2.0, 1.0])
    assert np.allclose(top_directions(g, 2), [[1, 0], [0, 1], [0, 0]])


@pytest.mark.parametrize(("classifier", "arguments"), [("sklearn.linear_model.LogisticRegression", {"C": 10, "max_iter": 50}), ("RandomForestClassifier", {"n_estimators": 10, "random_state": 1}), ("BernoulliNB", {})])
def test_supervised(spark, tmp_path, classifier, arguments):
    data = [(i, ["A", "B"] if i % 3 else ["C"], [], "clean" if i % 3 else "bad") for i in range(60)]
    df = spark.createDataFrame(data, "i int, labels array<string>, bonus array<double>, status string")
    model = anomaly.SupervisedClassifierAnomaly("status", classifier, **arguments).fit(df)
    scores = {r.i: r.score for r in model.score(df).collect()}
    assert min(s for i, s in scores.items() if i % 3 == 0) > 0.5 > max(s for i, s in scores.items() if i % 3)
    assert model.score_one(["C"], []) == pytest.approx(scores[0])


def test_supervised_classes(spark):
    data = [(i, ["ABC"[i % 3]], [], ["x", "y", "z"][i % 3]) for i in range(30)]
    df = spark.createDataFrame(data, "i int, labels array<string>, bonus array<double>, status string")
    model = anomaly.SupervisedClassifierAnomaly("status", "DecisionTreeClassifier").fit(df)
    assert all(r.predicted == r.status for r in model.score(df).collect())
    for bad in ({"classifier": "Oracle"}, {"classifier": "BernoulliNB", "depth": 3}):
        with pytest.raises(ValueError):
            anomaly.SupervisedClassifierAnomaly("status", **bad)


@pytest.mark.parametrize("classifier", ["LogisticRegression", "BernoulliNB", "DecisionTreeClassifier"])
def test_supervised_fits_continue(spark, classifier):
    rng = random.Random(8)
    rows = [(i, [x for x in "ABCD" if rng.random() < 0.5], rng.choice(["clean", "bad"] if i % 9 else [None])) for i in range(300)]
    df = spark.createDataFrame([(i, s, [], "bad" if t and "A" in s and i % 5 else t) for i, s, t in rows], "i int, labels array<string>, bonus array<double>, truth string")
    scorer = anomaly.SupervisedClassifierAnomaly("truth", classifier)
    whole, parts = scorer.fit(df), scorer.fit(df.filter("i >= 120"), scorer.fit(df.filter("i < 120")))
    assert sum(r.n for r in parts.tables["examples"].collect()) == 300
    want = [r.score for r in whole.score(df).orderBy("i").collect()]
    assert [r.score for r in parts.score(df).orderBy("i").collect()] == pytest.approx(want, abs=1e-6)


def test_repeated_rows_in_pieces(spark):
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 3)], "k string, n long")
    assert {r.k: r[1] for r in anomaly._repeated(df, "n", piece=3).groupBy("k").count().collect()} == {"a": 7, "b": 1, "c": 3}
