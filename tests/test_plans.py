"""Configurations, rules, autoconfig, saved models, rows, sinks, streams, the command line."""

import json

import pytest

from conftest import DATA
from tagsmith.plans import cli
from tagsmith.plans.autoconfig import field_kinds, suggest
from tagsmith.plans.catalogue import EVENTS, events_model
from tagsmith.plans.config import PipelineConfig, value
from tagsmith.plans.pipeline import LabelPipeline, PipelineModel, full_process, generator, register_generator, scorer
from tagsmith.plans.rowapi import Config, PretrainedModel, RowScorer
from tagsmith.plans.rules import Rule, apply_rules, load_rules
from tagsmith.sources.columns import TableView
from tagsmith.sources.readers import read_csv, source
from tagsmith.sources.sinks import exported, write_bulk, write_csv
from tagsmith.streaming.score import train_stream


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet")


def test_values():
    assert value("none # one of 'none', 'ratio'") == "none"
    assert value("['a # b', \"c\"]  # list") == ["a # b", "c"]
    assert value("id") == "id" and value("3") == 3 and value("a#b") == "a#b"
    assert value("__import__('os').getcwd()") == "__import__('os').getcwd()"


def test_config():
    c = PipelineConfig.from_string(EVENTS)
    assert list(c.generators) == ["spread", "kind", "props", "pair", "own", "word", "pattern"] and c.scorer == "StatisticalNGramAnomaly"
    assert PipelineConfig.from_string(c.to_string()) == c
    assert list(c.select(["own", "kind"]).generators) == ["kind", "own"]
    with pytest.raises(ValueError):
        PipelineConfig.from_string("[DEFAULT]\ngenerator_type = NumericField\n")
    s = PipelineConfig.from_string("[AnomalyScoring]\nscoring_algorithm = SupervisedClassifierAnomaly\nground_truth_column = status\nclassifier = LogisticRegression\nC = 5\n")
    assert s.scorer_arguments == {"ground_truth_column": "status", "classifier": "LogisticRegression", "C": 5}
    with pytest.raises(LookupError):
        generator("NoSuch")
    with pytest.raises(LookupError):
        scorer("NoSuch")


def test_rows_equal_tables_and_survive_saving(spark, events, tmp_path):
    model, path = events_model(events), f"file://{tmp_path}/model"
    model.save(spark, path)
    pretrained, config = PretrainedModel.from_path(spark, path), Config.from_string(EVENTS)
    row = RowScorer.get_instance(spark, config, pretrained)
    assert row is RowScorer.get_instance(spark, config, PretrainedModel.from_path(spark, path))
    for r in model.transform(events).limit(60).collect():
        got = row({k: r[k] for k in events.columns})
        assert got["labels"] == r.labels and got["score"] == [pytest.approx(r.score)]


@pytest.mark.parametrize("name", ["SVDAnomaly", "IFAnomaly", "LOFAnomaly"])
def test_other_scorers_survive_saving(spark, events, tmp_path, name):
    model, path = events_model(events, scorer=name), f"file://{tmp_path}/{name}"
    model.save(spark, path)
    a, b = (m.transform(events).select("event_id", "score").orderBy("event_id").collect() for m in (model, PipelineModel.load(spark, path)))
    assert [r.score for r in a] == pytest.approx([r.score for r in b])


def test_partitions_and_order_dont_matter(events):
    config = PipelineConfig.from_string(EVENTS)
    a, b = (full_process(df, config)[1].select("event_id", "labels", "score").orderBy("event_id").collect() for df in (events, events.orderBy("value").repartition(7)))
    assert [(r.event_id, r.labels) for r in a] == [(r.event_id, r.labels) for r in b]
    assert [r.score for r in a] == pytest.approx([r.score for r in b])


def test_incremental_equals_whole(events):
    config = PipelineConfig.from_string(EVENTS.replace("[spread]", "[GENERAL]\n[spread]"))
    pipeline = LabelPipeline(config)
    both = pipeline.fit(events.filter("event_id >= 500"), base=pipeline.fit(events.filter("event_id < 500")))
    whole = pipeline.fit(events)
    a, b = (m.label(events).select("event_id", "labels").orderBy("event_id").collect() for m in (both, whole))
    assert a == b


def test_own_generator(events):
    from tagsmith.operators.knowledge import KeywordBased

    register_generator("Clicks", lambda: KeywordBased(["click"], "event_type"))
    model = LabelPipeline(PipelineConfig({"c": ("Clicks", {})})).fit(events)
    assert {tuple(r.labels) for r in model.label(events).select("labels").distinct().collect()} == {(), ("EVENT_TYPE_KEYWORD_CLICK",)}


def test_rules(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/a.yaml").write_text("rule name: a\nrule label: HIT\nrule score: 1.5\nconditions:\n  one:\n    labels: [X, 'Y.']\n    host: web\n  two:\n    host: ['.*3']\n")
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "note.txt").write_text("no rule")
    rules = load_rules(str(tmp_path))
    df = spark.createDataFrame([(0, ["X"], "web3", 1.0), (1, ["AX"], "web1", 1.0), (2, ["Y1"], "web1", 1.0), (3, [], "db3", 0.0), (4, None, None, 0.0)], "i int, labels array<string>, host string, score double")
    once = {r.i: (r.labels, r.score) for r in apply_rules(df, rules).collect()}
    assert once == {0: (["X", "HIT"], 2.5), 1: (["AX"], 1.0), 2: (["Y1", "HIT"], 2.5), 3: (["HIT"], 1.5), 4: ([], 0.0)}
    each = {r.i: (r.labels, r.score) for r in apply_rules(df, rules, per_condition=True).collect()}
    assert each[0] == (["X", "HIT", "HIT"], 4.0)
    with pytest.raises(ValueError, match="no column"):
        apply_rules(df, [Rule("r", "L", 1, {"c": {"nowhere": ("x",)}})])
    with pytest.raises(ValueError, match="rule score"):
        Rule.parse({"rule name": "x", "rule label": "y", "conditions": {}})


def test_kinds(spark):
    n = 40
    rows = [(i, float(i), i + 0.5, str(i), f"{i}.5", f"word {i}", "ab"[i % 2], None, float("nan") if i == 3 else 1.0 * i) for i in range(n)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d string, e string, f string, g string, h string, k double")
    # float values pass as ints, unless one is NaN
    assert {r.field: r.kind for r in field_kinds(df).collect()} == {"a": "int", "b": "int", "c": "int", "d": "int", "e": "float", "f": "text", "g": "multinomial", "h": "multinomial", "k": "float"}
    config = suggest(df.select("a", "f", "g", "h"))
    assert [k for k, _ in config.generators.values()] == ["MultinomialField", "MultinomialField", "MultinomialFieldCombiner", "NumericField", "TextField"]
    assert PipelineConfig.from_string(config.to_string("; made")).generators.keys() == config.generators.keys()


def test_csv_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, ["A", "it's"], [2.5], float("nan"), "NaN"), (2, [], [], 1.0, None)], "i int, labels array<string>, bonus array<double>, x double, s string")
    write_csv(df, f"file://{tmp_path}/out")
    back = {r.i: r.labels for r in read_csv(spark, f"file://{tmp_path}/out").collect()}
    assert back == {1: ["A", "it's"], 2: []}
    rows = {r.i: r for r in exported(df, "m").collect()}
    assert rows[1].x is None and rows[1].s is None and rows[1].raw == "['A', 'it\\'s', 2.5]" and rows[2].raw == "[]"
    sent = tmp_path / "sent"

    def send(body):
        with open(sent, "a") as f:
            f.write(body)

    write_bulk(df.coalesce(1), "m", send)
    lines = [json.loads(x) for x in sent.read_text().splitlines()]
    assert [x["i"] for x in lines[1::2]] == [1, 2] and lines[0] == {"index": {"_index": "anomalies"}}

    def fail(body):
        raise OSError

    write_bulk(df, "m", fail)  # logged only


def test_sources_and_views(spark, events):
    assert source(spark, "parquet", path=f"{DATA}/events.parquet").count() == len(TableView(events))
    with pytest.raises(LookupError):
        source(spark, "nowhere")
    t = TableView(events)
    assert t[0]["event_id"] == t[:3][0]["event_id"] and len(t[:3]) == 3
    v = t["value"]
    assert v.min() <= v.mean() <= v.max() and v.std() > v.std(population=True) and len(v.tolist()) == len(v)
    assert sum(1 for _ in t) == len(t)


def test_command_line(spark, tmp_path):
    rows = "\n".join(["user,size", *(f"{'ab'[i % 2]},{i}" for i in range(40))])
    (tmp_path / "in.csv").write_text(rows)
    at = lambda x: f"file://{tmp_path}/{x}"
    cli.main(["autoconfig", "--input-file", at("in.csv"), "--output-file", at("made.conf")], spark)
    cli.main(["train", "--input-file", at("in.csv"), "--conf-file", f"{tmp_path}/made.conf", "--model-file", at("m1")], spark)
    cli.main(["train", "--input-file", at("in.csv"), "--conf-file", f"{tmp_path}/made.conf", "--model-file", at("m2"), "--incremental", "--orig-model-file", at("m1")], spark)
    cli.main(["run", "--input-file", at("in.csv"), "--model-file", at("m2"), "--output-file", at("out")], spark)
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/a.yaml").write_text("rule name: a\nrule label: HIT\nrule score: 1\nconditions:\n  one:\n    user: a\n")
    cli.main(["rules", "--input-file", at("out"), "--rules-folder", f"{tmp_path}/rules", "--output-file", at("ruled")], spark)
    out = read_csv(spark, at("ruled"))
    assert out.count() == 40 and out.filter("array_contains(labels, 'HIT')").count() == 20
    for bad in (["run", "--input-file", "x", "--model-file", "y"], ["train", "--input-file", "x", "--conf-file", "y", "--model-file", "z", "--incremental"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


def test_training_from_a_stream(spark, events, tmp_path):
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    train_stream(stream, PipelineConfig({"n": ("NumericField", {"field_name": "value"})}), f"file://{tmp_path}/models", f"file://{tmp_path}/progress").awaitTermination()
    got = PipelineModel.load(spark, f"file://{tmp_path}/models/2").models["n"].tables["stats"].first().asDict()
    assert got == pytest.approx(LabelPipeline(PipelineConfig({"n": ("NumericField", {"field_name": "value"})})).fit(events).models["n"].tables["stats"].first().asDict())


def test_names_of_choice_leave_own_columns(spark):
    config = PipelineConfig.from_string(CHOICE)
    df = spark.createDataFrame([("a", "mine", 7)] * 30 + [("b", "mine", 7)], "kind string, labels string, score int")
    model = LabelPipeline(config).fit(df)
    out = model.transform(df, labels="tags", score="oddity")
    assert out.columns == ["kind", "bonus", "tags", "oddity", "labels", "score"] or sorted(out.columns) == sorted(["kind", "labels", "score", "bonus", "tags", "oddity"])
    plain = {r.kind: (r.labels, r.score) for r in model.transform(df).collect()}
    assert all((r.labels, r.score) == ("mine", 7) and (r.tags, r.oddity) == plain[r.kind] for r in out.collect())


def test_a_configuration_selects_the_fitted_generators(spark):
    df = spark.createDataFrame([("a", 1.0 * i) for i in range(30)], "kind string, x double")
    model = LabelPipeline(PipelineConfig.from_string(CHOICE.replace("[AnomalyScoring]", "[N]\ngenerator_type = NumericField\nfield_name = 'x'\n\n[AnomalyScoring]"))).fit(df)
    some = model.configured(PipelineConfig.from_string(CHOICE))
    assert list(model.models) == ["M", "N"] and list(some.models) == ["M"]
    with pytest.raises(LookupError):
        some.configured(model.config)
    with pytest.raises(LookupError):
        model.configured(PipelineConfig.from_string(CHOICE.replace("StatisticalNGramAnomaly", "SVDAnomaly")))


def test_a_batch_that_fails_stops_no_other(spark, tmp_path):
    from tagsmith.sources.sinks import write_bulk

    folder = str(tmp_path)

    def send(payload):
        if '"x":3' in payload:
            raise OSError("refused")
        with open(f"{folder}/{hash(payload)}", "w") as f:
            f.write(payload)

    df = spark.createDataFrame([(i, ["L"], 1.0) for i in range(10)], "x long, labels array<string>, score double").coalesce(1)
    write_bulk(df, "m", send, batch=2)
    assert len(list(tmp_path.iterdir())) == 4


CHOICE = """[M]
generator_type = MultinomialField
field_name = 'kind'
absolute_threshold = 2
relative_threshold = 0.1

[AnomalyScoring]
scoring_algorithm = StatisticalNGramAnomaly
"""
