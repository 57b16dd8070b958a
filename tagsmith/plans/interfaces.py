"""Queries that go through the library's interfaces: views, files, configurations, the command line, single records,
rules from files and training from streams. Importing this module adds them to the catalogue."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.operators.knowledge import KeywordBased, LOLField, register_classifier
from tagsmith.operators.numeric import NumericField
from tagsmith.plans import cli
from tagsmith.plans.autoconfig import field_kinds
from tagsmith.plans.catalogue import (
    ALL_KINDS, EVENT_LABELS, EVENTS, FIELDS, KINDS_SQL, NGRAMS, RULES_SQL, SPLIT, deviation_sql, events_model, joined, labelled_events, labels_of, multinomial_sql, query, rounded, stub_classifier, table,
)
from tagsmith.plans.config import PipelineConfig
from tagsmith.plans.pipeline import LabelPipeline, PipelineModel, register_generator
from tagsmith.plans.rowapi import Config, PretrainedModel, RowScorer
from tagsmith.plans.rules import apply_rules, load_rules
from tagsmith.sources.columns import TableView
from tagsmith.sources.readers import dict_to_text, register_source, source, text_to_dict
from tagsmith.sources.sinks import write_bulk, write_csv, write_json
from tagsmith.sources.store import read_text, scratch
from tagsmith.streaming.score import train_stream

# --- views


@query("SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'value', count(*) FROM events")
def row_counts(spark, sf):
    e = TableView(table(spark, sf, "events"))
    return spark.createDataFrame([("events", len(e)), ("orders", len(TableView(table(spark, sf, "orders")))), ("value", len(e["value"]))], "name string, n long")


@query("SELECT n_nationkey, n_name FROM nation")
def rows_in_turn(spark, sf):
    n = TableView(table(spark, sf, "nation"))
    return spark.createDataFrame([(r.n_nationkey, r.n_name) for r in n], "n_nationkey int, n_name string")


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) SELECT n_nationkey, n_name FROM o WHERE i = 3 OR i BETWEEN 5 AND 8")
def rows_by_position(spark, sf):
    n = TableView(table(spark, sf, "nation").orderBy("n_nationkey"))
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in [n[3], *n[5:9]]], "n_nationkey int, n_name string")


@query("SELECT n_name FROM nation")
def column_as_list(spark, sf):
    return spark.createDataFrame([(x,) for x in TableView(table(spark, sf, "nation"))["n_name"].tolist()], "n_name string")


@query("SELECT event_id, value, round(value * 3, 6) AS triple, CASE WHEN event_type = 'error' THEN 'fault' ELSE event_type END AS event_type FROM events")
def columns_set(spark, sf):
    e = TableView(table(spark, sf, "events")).with_column("triple", F.col("value") * 3)
    return rounded(e["event_type"].replaced(F.col("event_type") == "error", "fault").select("event_id", "value", "triple", "event_type"))


@query("SELECT max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_shipdate) AS l_shipdate FROM lineitem")
def column_aggregates(spark, sf):
    own = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return TableView(own).apply_columns(lambda c: F.max(c.column))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, props FROM events")
def json_texts(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("props"))
    e = TableView(e)["k"].apply(lambda t: text_to_dict(t)["k"], "long")
    return TableView(e)["props"].apply(lambda t: dict_to_text(text_to_dict(t)), "string").select("event_id", "k", "props")


# --- files and sinks


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1")
def named_source(spark, sf):
    register_source("events-without", lambda spark, path, kind: source(spark, "parquet", path=path).filter(F.col("event_type") != kind))
    return source(spark, "events-without", path=f"{sf}/events.parquet", kind="click").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENT_LABELS} SELECT event_id, event_type, value, props, array_to_string(labels, '|') AS labels FROM labels")
def csv_round_trip(spark, sf):
    e, where = labelled_events(spark, sf).drop("ts"), scratch(spark, "csv")
    write_csv(e, where)
    schema = "event_id long, user_id long, event_type string, value double, props string, labels string"
    back = source(spark, "csv", path=where, schema=schema, line_breaks=False)
    return back.select("event_id", "event_type", "value", "props", joined())


@query(f"WITH {EVENT_LABELS} SELECT event_id, 'StatisticalNGramAnomaly' AS model, '[' || array_to_string(list_transform(labels, lambda x: '''' || x || ''''), ', ') || ']' AS raw FROM labels")
def json_round_trip(spark, sf):
    where = scratch(spark, "json")
    write_json(labelled_events(spark, sf), where, "StatisticalNGramAnomaly")
    return source(spark, "json", path=where, schema="event_id long, model string, raw string").select("event_id", "model", "raw")


@query(f"WITH {EVENT_LABELS} SELECT count(*) AS n_sent, CAST(sum(len(labels)) AS BIGINT) AS n_labels FROM labels")
def bulk_upload(spark, sf):
    """What a bulk interface is sent: an action and a row a line."""
    sent, labels = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def send(body: str) -> None:
        lines = [x for x in body.split("\n") if x]
        sent.add(len(lines) // 2)
        labels.add(sum(len(text_to_dict(x)["labels"]) for x in lines[1::2]))

    write_bulk(labelled_events(spark, sf), "StatisticalNGramAnomaly", send)
    return spark.createDataFrame([(sent.value, labels.value)], "n_sent long, n_labels long")


# --- configurations


@query("""SELECT * FROM (VALUES ('spread', 'NumericField', 1), ('kind', 'MultinomialField', 2), ('props', 'MultinomialField', 3), ('pair', 'MultinomialFieldCombiner', 3),
  ('own', 'NumericField', 3), ('word', 'KeywordBased', 2), ('pattern', 'KnowledgeBased', 2), ('AnomalyScoring', 'LOFAnomaly', 1)) v(section, kind, arguments)""")
def config_sections(spark, sf):
    """Parsed, given another scorer, written and parsed again."""
    c = PipelineConfig.from_string(PipelineConfig.from_string(EVENTS).select(scorer="LOFAnomaly", neighbours=7).to_string())
    rows = [(s, kind, len(a)) for s, (kind, a) in c.generators.items()] + [("AnomalyScoring", c.scorer, len(c.scorer_arguments))]
    return spark.createDataFrame(rows, "section string, kind string, arguments int")


@query("SELECT md5('" + EVENTS.replace("'", "''") + "') AS key, md5('') AS empty")
def config_fingerprint(spark, sf):
    return spark.createDataFrame([(Config.from_string(EVENTS).md5(), Config.from_string("").md5())], "key string, empty string")


@query(f"""
WITH et AS (SELECT event_type AS k, count(*) AS etn, count(*) / sum(count(*)) OVER () AS etp FROM events GROUP BY 1),
labels AS (SELECT event_id, list_filter([CASE WHEN etn < 10 THEN 'LOW_OBS_COUNT_FOR_EVENT_TYPE' ELSE '' END, CASE WHEN etp < 0.2 THEN 'LOW_OBS_PROB_FOR_EVENT_TYPE' ELSE '' END,
  CASE WHEN event_type = 'click' THEN 'EVENT_TYPE_KEYWORD_CLICK' ELSE '' END, CASE WHEN event_type = 'error' THEN 'EVENT_TYPE_KEYWORD_ERROR' ELSE '' END], lambda x: x <> '') AS labels
  FROM events JOIN et ON event_type = et.k), {NGRAMS}
SELECT event_id, array_to_string(labels, '|') AS labels, round(coalesce(s, 0), 6) AS score FROM labels LEFT JOIN set_scores ON list_sort(labels) = key
""")
def selected_sections(spark, sf):
    e = table(spark, sf, "events")
    model = LabelPipeline(PipelineConfig.from_string(EVENTS).select(["word", "kind"])).fit(e)
    return rounded(model.transform(e).select("event_id", joined(), "score"))


@query(" UNION ALL ".join(KINDS_SQL.replace("count(*)", "sum(p_size)").format(f=f, kind=k, t="part") for f, k in FIELDS["part"].items()))
def autoconfig_count_column(spark, sf):
    return field_kinds(table(spark, sf, "part"), "p_size").select("field", "kind")


_ORDER = ", ".join(f"('{f}', {i})" for i, f in enumerate(FIELDS["part"]))


@query(f"""
WITH k AS ({ALL_KINDS["part"]}), p AS (SELECT field, kind, j FROM k JOIN (VALUES {_ORDER}) v(f, j) ON field = f),
made AS (SELECT CASE kind WHEN 'multinomial' THEN 'MultinomialField' WHEN 'text' THEN 'TextField' ELSE 'NumericField' END AS generator, field AS fields, j, 0 AS j2 FROM p
  UNION ALL SELECT 'MultinomialFieldCombiner', a.field || ',' || b.field, a.j, b.j FROM p a JOIN p b ON a.j < b.j AND a.kind = 'multinomial' AND b.kind = 'multinomial')
SELECT 'LG_' || row_number() OVER (ORDER BY generator, j, j2) AS section, generator, fields, CASE generator WHEN 'TextField' THEN 'char' WHEN 'NumericField' THEN '2' ELSE '10' END AS argument FROM made
""")
def autoconfig_file(spark, sf):
    """The file that the command writes, read as a configuration: sections, fields, and one of the default arguments."""
    where = scratch(spark, "suggested") + ".conf"
    cli.main(["autoconfig", "--input-file", f"{sf}/part.parquet", "--output-file", where], spark)
    rows = []
    for section, (kind, a) in PipelineConfig.from_string(read_text(spark, where)).generators.items():
        fields = a.get("field_name", a.get("field_names"))
        argument = a["lm_mode"] if kind == "TextField" else a["stdev_outlier_threshold"] if kind == "NumericField" else a["absolute_threshold"]
        rows.append((section, kind, fields if isinstance(fields, str) else ",".join(fields), str(argument)))
    return spark.createDataFrame(rows, "section string, generator string, fields string, argument string")


# --- generators


@query(f"""
WITH s AS (SELECT event_type AS a, user_id AS b, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_id, CASE WHEN n <= 5 THEN 'RARE_KEY_FOR_VALUE' ELSE {deviation_sql("value", "m", "s", "VALUE", 1, 2)} END AS labels FROM events JOIN s ON event_type = a AND user_id = b
""")
def numeric_labels_by_two_columns(spark, sf):
    e = table(spark, sf, "events")
    return labels_of(e, NumericField("value", group_by=["event_type", "user_id"]).fit(e), "event_id")


@query("""
SELECT 'value: the deviation is 0' AS warning FROM events HAVING stddev_pop(value) = 0 UNION ALL SELECT 'zero: the deviation is 0' FROM events HAVING stddev_pop(value * 0) = 0
UNION ALL SELECT 'zero: the mean is 0' FROM events HAVING avg(value * 0) = 0
""")
def numeric_warnings(spark, sf):
    e = table(spark, sf, "events").withColumn("zero", F.col("value") * 0)
    fields = [NumericField("value"), NumericField("zero"), NumericField("zero", stdev=False, spike="ratio")]
    return spark.createDataFrame([(w,) for f in fields for w in f.fit(e).warnings()], "warning string")


@query("SELECT doc_id, CASE WHEN (length(text) - length(replace(text, ' ', ''))) * 12 < length(text) THEN 'BAD' ELSE 'GOOD' END || '|WINDOWS_' || (length(text) % 3) AS labels FROM documents")
def platform_labels(spark, sf):
    """A platform as configurations write it; the classifier is a stub."""
    register_classifier("lol", stub_classifier)
    d = table(spark, sf, "documents")
    return labels_of(d, LOLField("text", platform="Platform.WINDOWS", return_labels=True).fit(d), "doc_id")


class _Early(LabelPipeline):
    def prepare(self, df: DataFrame) -> DataFrame:
        return df.filter(SPLIT)


_PROPS = multinomial_sql("events", f"(SELECT * FROM events WHERE {SPLIT})", "event_id", ["props"], "PROPS", 60, 0.0098)


@query(f"SELECT event_id, concat_ws('|', nullif(own.labels, ''), CASE WHEN event_type = 'click' THEN 'EVENT_TYPE_KEYWORD_CLICK' END) AS labels FROM ({_PROPS}) own JOIN events USING (event_id)")
def own_pipeline_and_generator(spark, sf):
    """A pipeline that fits on early events alone, and a generator under a name of one's own."""
    register_generator("Clicks", lambda: KeywordBased(["click"], "event_type"))
    e = table(spark, sf, "events")
    config = PipelineConfig({"p": ("MultinomialField", {"field_name": "props", "absolute_threshold": 60, "relative_threshold": 0.0098}), "c": ("Clicks", {})})
    return _Early(config).fit(e).label(e).select("event_id", joined())


# --- pipelines, single records, commands


@query(f"WITH {EVENT_LABELS}, {NGRAMS} SELECT event_id, event_type AS labels, array_to_string(labels, '|') AS tags, round(coalesce(s, 0), 6) AS points FROM labels LEFT JOIN set_scores ON list_sort(labels) = key")
def results_by_other_names(spark, sf):
    e = table(spark, sf, "events")
    out = events_model(e).transform(e.withColumn("labels", F.col("event_type")), labels="tags", score="points")
    return rounded(out.select("event_id", "labels", F.array_join("tags", "|").alias("tags"), "points"))


NATIONS = """
[region]
generator_type = MultinomialField
field_name = n_regionkey
absolute_threshold = 6
relative_threshold = 0.1
[word]
generator_type = KeywordBased
field_name = n_name
keyword_list = ['3', '7', '11']
[odd]
generator_type = KnowledgeBased
field_name = n_name
rules_and_labels_tuple_list = [('[13579]$', 'ODD')]
"""


@query(f"""
WITH r AS (SELECT n_regionkey AS k, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM nation GROUP BY 1),
labels AS (SELECT n_nationkey, list_filter([CASE WHEN n < 6 THEN 'LOW_OBS_COUNT_FOR_N_REGIONKEY' ELSE '' END, CASE WHEN p < 0.1 THEN 'LOW_OBS_PROB_FOR_N_REGIONKEY' ELSE '' END,
  CASE WHEN n_name LIKE '%\\_3' ESCAPE '\\' THEN 'N_NAME_KEYWORD_3' ELSE '' END, CASE WHEN n_name LIKE '%\\_7' ESCAPE '\\' THEN 'N_NAME_KEYWORD_7' ELSE '' END,
  CASE WHEN n_name LIKE '%\\_11' ESCAPE '\\' THEN 'N_NAME_KEYWORD_11' ELSE '' END, CASE WHEN regexp_matches(n_name, '[13579]$') THEN 'ODD' ELSE '' END], lambda x: x <> '') AS labels
  FROM nation JOIN r ON n_regionkey = k), {NGRAMS}
SELECT n_nationkey, array_to_string(labels, '|') AS labels, round(coalesce(s, 0), 6) AS score FROM labels LEFT JOIN set_scores ON list_sort(labels) = key
""")
def single_records(spark, sf):
    """Each row of a small table as a record, by the saved model and without Spark jobs."""
    n, where = table(spark, sf, "nation"), scratch(spark, "nations")
    LabelPipeline(PipelineConfig.from_string(NATIONS)).fit(n).save(spark, where)
    scorer = RowScorer.get_instance(spark, Config.from_string(NATIONS), PretrainedModel.from_path(spark, where))
    out = [(r["n_nationkey"], scorer(r)) for r in (row.asDict() for row in TableView(n))]
    return spark.createDataFrame([(k, "|".join(o["labels"]), round(o["score"][0], 6)) for k, o in out], "n_nationkey int, labels string, score double")


@query(f"WITH {EVENT_LABELS}, {NGRAMS} SELECT event_id, array_to_string(labels, '|') AS labels, round(coalesce(s, 0), 6) AS score FROM labels LEFT JOIN set_scores ON list_sort(labels) = key")
def command_line_scores(spark, sf):
    """train, then run, as commands."""
    model, out, events = scratch(spark, "trained"), scratch(spark, "run") + ".csv", f"{sf}/events.parquet"
    with tempfile.TemporaryDirectory() as d:  # the driver alone reads configurations
        with open(conf := os.path.join(d, "events.conf"), "w", encoding="utf-8") as f:
            f.write(EVENTS)
        cli.main(["train", "--input-file", events, "--conf-file", conf, "--model-file", model], spark)
        cli.main(["run", "--input-file", events, "--conf-file", conf, "--model-file", model, "--output-file", out], spark)
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string, labels string, score double"
    return rounded(source(spark, "csv", path=out, schema=schema, line_breaks=False).select("event_id", joined(), "score"))


RULE_FILES = {
    "a/values.yaml": "rule name: odd values\nrule label: LOOK_AT\nrule score: 2.5\nconditions:\n  a:\n    labels: VALUE_OUTLIER\n  b:\n    event_type: [err, sign]\n    props: ['\\{\"k\": 9']\n",
    "b/users.yaml": "rule name: users\nrule label: USER_RANGE\nrule score: 0.25\nconditions:\n  a:\n    user_id: ['1[0-4]$', '77']\n",
    "b/empty.yaml": "",
    "b/readme.txt": "no rule\n",
}


@query(f"WITH {EVENT_LABELS}, {RULES_SQL} SELECT event_id, array_to_string(list_concat(labels, list_filter([CASE WHEN r1 THEN 'LOOK_AT' ELSE '' END, CASE WHEN r2 THEN 'USER_RANGE' ELSE '' END], lambda x: x <> '')), '|') AS labels, CASE WHEN r1 THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN r2 THEN 0.25::DOUBLE ELSE 0 END AS score FROM fired")
def rule_files(spark, sf):
    with tempfile.TemporaryDirectory() as d:  # rules are read by the driver alone
        for name, text in RULE_FILES.items():
            os.makedirs(os.path.dirname(at := os.path.join(d, name)), exist_ok=True)
            with open(at, "w", encoding="utf-8") as f:
                f.write(text)
        rules = load_rules(d)
    return apply_rules(labelled_events(spark, sf).withColumn("score", F.lit(0.0)), rules).select("event_id", joined(), "score")


# --- training from a stream, supervised scoring


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events GROUP BY event_type")
def stream_training(spark, sf):
    """Statistics after the last of two batches, each of which continues the model before."""
    e, source_, models = table(spark, sf, "events"), scratch(spark, "batches"), scratch(spark, "versions")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e.repartition(n).write.parquet(source_)
    files = len(spark.read.parquet(source_).inputFiles())
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(source_)
    config = PipelineConfig({"spread": ("NumericField", {"field_name": "value", "group_by": "event_type"})})
    train_stream(stream, config, models, scratch(spark, "progress")).awaitTermination()
    last = PipelineModel.load(spark, f"{models}/{1 if files > 1 else 0}")
    return rounded(last.models["spread"].tables["stats"].select("event_type", "mean", "std", "n"))


JUDGED = """
[words]
generator_type = KnowledgeBased
field_name = text
rules_and_labels_tuple_list = [('!!', 'SHOUT'), ('[|]', 'BARS'), ('[*&%$#]{3}', 'SIGNS'), ('License', 'LICENSE')]
[AnomalyScoring]
scoring_algorithm = SupervisedClassifierAnomaly
ground_truth_column = quality
classifier = sklearn.naive_bayes.BernoulliNB
alpha = 1.0
"""
#: Bernoulli naive Bayes with one added to each count, over the labels that occur.
BAYES = """
WITH d AS (SELECT doc_id, quality, coalesce(text, 'None') AS text FROM documents JOIN labels USING (doc_id)),
f AS (SELECT * FROM (VALUES ('SHOUT', '!!'), ('BARS', '[|]'), ('SIGNS', '[*&%$#]{3}'), ('LICENSE', 'License')) v(label, p)),
x AS (SELECT doc_id, quality, label, CASE WHEN regexp_matches(text, p) THEN 1 ELSE 0 END AS has FROM d, f),
c AS (SELECT quality AS c, count(*) AS n, ln(count(*) + 1) - ln(sum(count(*)) OVER () + count(*) OVER ()) AS prior FROM d WHERE quality IS NOT NULL GROUP BY 1),
t AS (SELECT label, c, (sum(CASE WHEN quality = c THEN has ELSE 0 END) + 1) / (any_value(n) + 2) AS theta FROM x, c GROUP BY label, c),
seen AS (SELECT label FROM x GROUP BY label HAVING sum(has) > 0),
l AS (SELECT doc_id, c, any_value(prior) + sum(CASE WHEN has = 1 THEN ln(theta) ELSE ln(1 - theta) END) AS l FROM x JOIN seen USING (label) JOIN t USING (label) JOIN c USING (c) GROUP BY doc_id, c)
SELECT a.doc_id, round(1 / (1 + exp(a.l - b.l)), 6) AS score FROM l a JOIN l b USING (doc_id) WHERE a.c = 0 AND b.c = 1
"""


def _judged(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "quality")


@query(BAYES)
def supervised_bayes(spark, sf):
    d = _judged(spark, sf)
    return rounded(LabelPipeline(PipelineConfig.from_string(JUDGED)).fit(d).transform(d).select("doc_id", "score"))


@query(BAYES)
def supervised_incremental(spark, sf):
    """Fitted on even documents, continued on odd ones: as if fitted on all."""
    d, config = _judged(spark, sf), PipelineConfig.from_string(JUDGED)
    model = LabelPipeline(config).fit(d.filter("doc_id % 2 = 1"), LabelPipeline(config).fit(d.filter("doc_id % 2 = 0")))
    return rounded(model.transform(d).select("doc_id", "score"))
