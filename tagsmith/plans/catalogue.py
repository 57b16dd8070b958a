"""Queries over the driver's tables, one for each operator, and DuckDB SQL with the same results where SQL has them.

Floats are rounded to six decimals on both sides, labels are joined by |.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.functions import text as tx
from tagsmith.operators import anomaly
from tagsmith.operators.base import GeneratorModel
from tagsmith.operators.knowledge import KeywordBased, KnowledgeBased, LOLField, ObfuscationField, register_classifier
from tagsmith.operators.labelsets import label_sets, sorted_labels, vocabulary
from tagsmith.operators.multinomial import MultinomialField, MultinomialFieldCombiner, counts, with_shares
from tagsmith.operators.numeric import NumericField, merged_stats, stats
from tagsmith.operators.text_model import TextField, ngram_counts, texts_of
from tagsmith.operators.text_model import vocabulary as text_vocabulary
from tagsmith.plans.autoconfig import field_kinds, suggest
from tagsmith.plans.config import PipelineConfig
from tagsmith.plans.pipeline import LabelPipeline, PipelineModel, labelled, top_anomalies
from tagsmith.plans.rules import Rule, apply_rules
from tagsmith.sources.columns import TableView
from tagsmith.sources.readers import parsed_labels
from tagsmith.sources.sinks import exported, rendered_labels
from tagsmith.sources.store import scratch
from tagsmith.streaming.score import score_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def joined(labels: str = "labels"):
    return F.array_join(labels, "|").alias("labels")


def labels_of(df: DataFrame, model: GeneratorModel, *keys: str) -> DataFrame:
    return labelled(df, {"g": model}).select(*keys, joined())


# --- numbers

SPLIT = "ts < TIMESTAMP '2024-01-20 00:00:00'"
OLD_ORDERS = "o_orderdate < TIMESTAMP '1999-01-01 00:00:00'"


def deviation_sql(v: str, m: str, s: str, name: str, low: float, high: float, ratio: str | None = None, both: float | None = None, normal: bool = True) -> str:
    """A CASE for the label: by deviations, or by a ratio; both is the deviation below which a value is normal anyway."""
    near = f"abs({v} - {m}) / (CASE WHEN {s} = 0 THEN 0.01 ELSE {s} END)"
    r, n = ratio or near, f"'{name}_NORMAL'" if normal else "''"
    first = f"WHEN {near} < {both} THEN {n} " if both is not None else ""
    within = f"WHEN {r} < {low} THEN {n} " if normal else ""
    return f"CASE {first}{within}WHEN {r} > {low} AND {r} < {high} THEN '{name}_BORDERLINE' WHEN {r} >= {high} THEN '{name}_OUTLIER' ELSE '' END"


@query("SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events")
def numeric_stats_global(spark, sf):
    return rounded(stats(table(spark, sf, "events"), "value", [], None))


@query("SELECT event_type, user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events GROUP BY ALL")
def numeric_stats_grouped(spark, sf):
    return rounded(stats(table(spark, sf, "events"), "value", ["event_type", "user_id"], None))


WEIGHTED = """
WITH m AS (SELECT l_returnflag, l_linestatus, sum(l_extendedprice * CAST(l_quantity AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)) AS mean FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(mean, 4) AS mean, round(sqrt(sum(CAST(l_quantity AS BIGINT) * (l_extendedprice - mean) * (l_extendedprice - mean)) / sum(CAST(l_quantity AS BIGINT))), 4) AS std,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n
FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY l_returnflag, l_linestatus, mean
"""


@query(WEIGHTED)
def numeric_stats_weighted(spark, sf):
    s = stats(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"], "l_quantity")
    return s.select("l_returnflag", "l_linestatus", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events GROUP BY event_type")
def numeric_incremental_merge(spark, sf):
    e = table(spark, sf, "events")
    return rounded(merged_stats(stats(e.filter(SPLIT), "value", ["event_type"], None), stats(e.filter(f"NOT ({SPLIT})"), "value", ["event_type"], None), ["event_type"]))


def _value_labels(spark, sf, **options) -> DataFrame:
    e = table(spark, sf, "events")
    return labels_of(e, NumericField("value", **options).fit(e), "event_id")


def _value_sql(**options) -> str:
    return f"WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, {deviation_sql('value', 'm', 's', 'VALUE', **options)} AS labels FROM events, s"


@query(_value_sql(low=1, high=2))
def numeric_labels_stdev(spark, sf):
    return _value_labels(spark, sf)


@query(_value_sql(low=2, high=4, ratio="value / m"))
def numeric_labels_spike_ratio(spark, sf):
    return _value_labels(spark, sf, stdev=False, spike="ratio", spike_borderline_threshold=2, spike_outlier_threshold=4)


@query(_value_sql(low=10, high=40, ratio="(value - m)"))
def numeric_labels_spike_fixed(spark, sf):
    return _value_labels(spark, sf, stdev=False, spike="fixed", spike_borderline_threshold=10, spike_outlier_threshold=40)


@query(_value_sql(low=10, high=20, ratio="(m / (CASE WHEN value = 0 THEN 0.01 ELSE value END))"))
def numeric_labels_spike_ratio_inverse(spark, sf):
    return _value_labels(spark, sf, stdev=False, spike="ratio", spike_inverse=True)


@query(_value_sql(low=5, high=9.5, ratio="(m - value)"))
def numeric_labels_spike_fixed_inverse(spark, sf):
    return _value_labels(spark, sf, stdev=False, spike="fixed", spike_inverse=True, spike_borderline_threshold=5, spike_outlier_threshold=9.5)


@query(_value_sql(low=2, high=3, ratio="(value / (m + s))", both=2))
def numeric_labels_stdev_and_spike(spark, sf):
    return _value_labels(spark, sf, spike="ratio", spike_borderline_threshold=2, spike_outlier_threshold=3)


@query(f"WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {deviation_sql('l_quantity', 'm', 's', 'L_QUANTITY', 1, 2, normal=False)} AS labels FROM lineitem, s")
def numeric_labels_no_normal(spark, sf):
    li = table(spark, sf, "lineitem")
    return labels_of(li, NumericField("l_quantity", label_for_normal=False).fit(li), "l_orderkey", "l_linenumber", "l_partkey")


@query(f"""
WITH s AS (SELECT o_custkey AS k, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, count(*) AS n FROM orders WHERE {OLD_ORDERS} GROUP BY o_custkey)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'UNSEEN_KEY_FOR_O_TOTALPRICE' WHEN n <= 5 THEN 'RARE_KEY_FOR_O_TOTALPRICE' ELSE {deviation_sql("o_totalprice", "m", "s", "O_TOTALPRICE", 1, 2)} END AS labels
FROM orders LEFT JOIN s ON o_custkey = k WHERE NOT ({OLD_ORDERS})
""")
def numeric_labels_grouped_rare_unseen(spark, sf):
    o = table(spark, sf, "orders")
    return labels_of(o.filter(f"NOT ({OLD_ORDERS})"), NumericField("o_totalprice", group_by="o_custkey").fit(o.filter(OLD_ORDERS)), "o_orderkey")


MIXED = "CASE WHEN event_id % 7 = 0 THEN event_type WHEN event_id % 7 = 1 THEN props ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END"


@query(f"""
WITH s AS (SELECT avg(value) * 100 AS m, stddev_pop(value) * 100 AS s FROM events), x AS (SELECT event_id, {MIXED} AS v FROM events)
SELECT event_id, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN 'V_BAD_VALUE' ELSE {deviation_sql("TRY_CAST(v AS DOUBLE)", "m", "s", "V", 1, 2)} END AS labels FROM x, s
""")
def numeric_bad_value(spark, sf):
    e = table(spark, sf, "events")
    model = NumericField("v").fit(e.select((F.col("value") * 100).alias("v")))
    return labels_of(e.select("event_id", F.expr(MIXED.replace("VARCHAR", "STRING")).alias("v")), model, "event_id")


# --- values and tuples of values


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS prob FROM orders GROUP BY o_orderpriority, o_orderstatus")
def multinomial_counts(spark, sf):
    return rounded(with_shares(counts(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderstatus"], None), ["o_orderstatus"]))


def multinomial_sql(source: str, train: str, key: str, fields: list[str], name: str, absolute: float, relative: float, group: list[str] = ()) -> str:  # noqa: B006
    keys = [*group, *fields]
    based = f"_BASED_ON_{'_'.join(group).upper()}" if group else ""
    over = f"PARTITION BY {', '.join(group)}" if group else ""
    on = " AND ".join(f"t.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
    seen = " AND ".join(f"t.{k} IS NOT DISTINCT FROM g.{k}" for k in group) or "TRUE"
    groups = f"SELECT DISTINCT {', '.join(group)}, 1 AS there FROM c" if group else "SELECT 1 AS there"
    return f"""
WITH c AS (SELECT {", ".join(keys)}, count(*) AS n, count(*) / sum(count(*)) OVER ({over}) AS p FROM {train} GROUP BY {", ".join(keys)}), g AS ({groups})
SELECT {key}, CASE WHEN g.there IS NULL THEN '' WHEN c.n IS NULL THEN 'UNSEEN_{name}{based}'
  ELSE concat_ws('|', CASE WHEN n < {absolute} THEN 'LOW_OBS_COUNT_FOR_{name}{based}' END, CASE WHEN p < {relative} THEN 'LOW_OBS_PROB_FOR_{name}{based}' END) END AS labels
FROM {source} t LEFT JOIN c ON {on} LEFT JOIN g ON {seen}
"""


@query(multinomial_sql("part", "part", "p_partkey", ["p_brand"], "P_BRAND", 80, 0.04))
def multinomial_labels(spark, sf):
    p = table(spark, sf, "part")
    return labels_of(p, MultinomialField("p_brand", absolute_threshold=80, relative_threshold=0.04).fit(p), "p_partkey")


@query(multinomial_sql("part", "part", "p_partkey", ["p_brand", "p_type"], "P_BRAND_P_TYPE_PAIR", 13, 0.0066))
def multinomial_combiner_labels(spark, sf):
    p = table(spark, sf, "part")
    return labels_of(p, MultinomialFieldCombiner(["p_brand", "p_type"], absolute_threshold=13, relative_threshold=0.0066).fit(p), "p_partkey")


@query(multinomial_sql("events", "events", "event_id", ["event_type"], "EVENT_TYPE", 11, 0.15, ["user_id"]))
def multinomial_grouped_labels(spark, sf):
    e = table(spark, sf, "events")
    return labels_of(e, MultinomialField("event_type", absolute_threshold=11, relative_threshold=0.15, group_by="user_id").fit(e), "event_id")


@query(multinomial_sql(f"(SELECT * FROM orders WHERE NOT ({OLD_ORDERS}))", f"(SELECT * FROM orders WHERE {OLD_ORDERS})", "o_orderkey", ["o_orderpriority"], "O_ORDERPRIORITY", 2, 0.1, ["o_custkey"]))
def multinomial_unseen_groups(spark, sf):
    o = table(spark, sf, "orders")
    model = MultinomialField("o_orderpriority", absolute_threshold=2, relative_threshold=0.1, group_by=["o_custkey"]).fit(o.filter(OLD_ORDERS))
    return labels_of(o.filter(f"NOT ({OLD_ORDERS})"), model, "o_orderkey")


@query(multinomial_sql(f"(SELECT * FROM events WHERE NOT ({SPLIT}))", f"(SELECT * FROM events WHERE {SPLIT})", "event_id", ["user_id", "props"], "USER_ID_PROPS_PAIR", 2, 0.0001))
def multinomial_unseen(spark, sf):
    e = table(spark, sf, "events")
    model = MultinomialFieldCombiner(["user_id", "props"], absolute_threshold=2, relative_threshold=0.0001).fit(e.filter(SPLIT))
    return labels_of(e.filter(f"NOT ({SPLIT})"), model, "event_id")


@query(multinomial_sql("events", "events", "event_id", ["props"], "PROPS", 95, 0.0098))
def multinomial_incremental(spark, sf):
    e, field = table(spark, sf, "events"), MultinomialField("props", absolute_threshold=95, relative_threshold=0.0098)
    return labels_of(e, field.fit(e.filter(f"NOT ({SPLIT})"), base=field.fit(e.filter(SPLIT))), "event_id")


# --- texts

TOKEN = r"[\p{L}\p{N}]+|[^ \p{L}\p{N}]"


@query("SELECT doc_id, length(text) AS n_tokens, sha256(array_to_string(regexp_extract_all(text, '(?s).'), chr(1))) AS tokens FROM documents")
def tokenizer_chars(spark, sf):
    t = table(spark, sf, "documents").withColumn("x", tx.characters(F.col("text")))
    return t.select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.sha2(F.array_join("x", "\x01"), 256).alias("tokens"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS n_tokens, sha256(array_to_string(regexp_extract_all(text, '{TOKEN}'), chr(1))) AS tokens FROM documents")
def tokenizer_tokens(spark, sf):
    t = table(spark, sf, "documents").withColumn("x", tx.tokens(F.col("text")))
    return t.select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.sha2(F.array_join("x", "\x01"), 256).alias("tokens"))


@query("""
WITH w AS (SELECT doc_id, string_split(regexp_replace(text, '[^0-9a-zA-Z]+', ' ', 'g'), ' ') AS w FROM documents)
SELECT doc_id, concat_ws('|', CASE WHEN list_contains(w, 'License') THEN 'TEXT_KEYWORD_LICENSE' END, CASE WHEN list_contains(w, 'the') THEN 'TEXT_KEYWORD_THE' END, CASE WHEN list_contains(w, 'der') THEN 'TEXT_KEYWORD_DER' END) AS labels FROM w
""")
def keyword_labels(spark, sf):
    d = table(spark, sf, "documents")
    return labels_of(d, KeywordBased(["License", "the", "der"], "text").fit(d), "doc_id")


REGEXES = [("%%%", "PERCENT"), ("<script>", "SCRIPT"), (r"class=.(main|content)", "MAIN"), (r"(?i)LICENSE", "LICENSE")]


@query("SELECT page_id, concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{label}' END" for p, label in REGEXES) + ") AS labels FROM pages")
def regex_labels(spark, sf):
    p = table(spark, sf, "pages")
    return labels_of(p, KnowledgeBased(REGEXES, "html").fit(p), "page_id")


def text_sql(source: str, field: str, mode: str, low: int = 3, high: int = 5) -> str:
    """CTEs texts, vocab, grams (a row for each n-gram of each distinct text) and model (their counts)."""
    pattern = "(?s)." if mode == "char" else TOKEN
    ahead = ", ".join(f"lead(c, {k}) OVER (PARTITION BY id ORDER BY i) AS c{k}" for k in range(1, high + 1))
    # an n-gram counts if yet another token follows it: the last of each order is left out
    grams = " UNION ALL ".join(f"SELECT id, w, concat_ws(chr(1), c, {', '.join(f'c{k}' for k in range(1, n))}) AS g FROM runs WHERE c{n} IS NOT NULL" for n in range(low, high + 1))
    marks = ", ".join(f"({k})" for k in range(1, low))
    return f"""
texts AS (SELECT row_number() OVER () AS id, t, w FROM (SELECT {field} AS t, count(*) AS w FROM {source} GROUP BY 1)),
lists AS (SELECT id, w, regexp_extract_all(t, '{pattern}') AS x FROM texts),
toks AS (SELECT id, w, unnest(x) AS tok, generate_subscripts(x, 1) AS i FROM lists),
vocab AS (SELECT tok FROM toks GROUP BY tok HAVING sum(w) > 2),
runs AS (SELECT id, w, c, {ahead} FROM (
  SELECT id, w, i, CASE WHEN v.tok IS NULL THEN '<UNK>' ELSE v.tok END AS c FROM toks LEFT JOIN vocab v USING (tok)
  UNION ALL SELECT id, w, k - {low}, '<s>' FROM lists, (VALUES {marks}) m(k)
  UNION ALL SELECT id, w, len(x) + k, '</s>' FROM lists, (VALUES {marks}) m(k))),
grams AS ({grams}),
model AS (SELECT g, CAST(sum(w) AS BIGINT) AS n FROM grams GROUP BY g)"""


def perplexity_sql(source: str, field: str, mode: str) -> str:
    return text_sql(source, field, mode) + f""",
perplexity AS (SELECT any_value(t) AS t, any_value(grams.w) AS w, avg(CASE WHEN n IS NULL THEN -ln(1e-8) ELSE 1 / (ln(n) + 1) END) AS p FROM grams LEFT JOIN model USING (g) JOIN texts USING (id) GROUP BY id),
spread AS (SELECT sum(w * p) / sum(w) AS m, sqrt(sum(w * (p - m) * (p - m)) / sum(w)) AS s FROM (SELECT *, (SELECT sum(w * p) / sum(w) FROM perplexity) AS m FROM perplexity))"""


def text_labels_sql(source: str, field: str, mode: str, key: str) -> str:
    name = field.upper()
    return f"""WITH {perplexity_sql(source, field, mode)}
SELECT {key}, CASE WHEN p - m < 2 * s THEN '' WHEN p - m < 4 * s THEN '{name}_HIGH_PERPLEXITY' WHEN p - m IS NOT NULL THEN '{name}_EXTREEME_PERPLEXITY' ELSE '' END AS labels, round(p * 10, 6) AS bonus
FROM {source} LEFT JOIN perplexity ON {field} = t, spread"""


def _text_labels(spark, sf, name: str, field: str, mode: str, key: str) -> DataFrame:
    d = table(spark, sf, name)
    return labelled(d, {"g": TextField(field, mode).fit(d)}).select(key, joined(), F.round(F.try_element_at("bonus", F.lit(1)), 6).alias("bonus"))


@query(f"WITH {text_sql('documents', 'text', 'char')} SELECT tok FROM vocab")
def text_vocab(spark, sf):
    return text_vocabulary(texts_of(table(spark, sf, "documents"), "text", None), "char").select(F.col("token").alias("tok"))


@query(f"WITH {text_sql('documents', 'text', 'char')} SELECT g AS gram, n FROM model")
def text_ngram_counts(spark, sf):
    texts = texts_of(table(spark, sf, "documents"), "text", None)
    return ngram_counts(texts, text_vocabulary(texts, "char"), "char", 3, 5).select("gram", "n")


@query(f"WITH {perplexity_sql('part', 'p_name', 'char')} SELECT p_partkey, round(p, 6) AS perplexity, round(m, 6) AS mean, round(s, 6) AS std FROM part JOIN perplexity ON p_name = t, spread")
def text_perplexity(spark, sf):
    p = table(spark, sf, "part")
    model = TextField("p_name").fit(p)
    own = labelled(p, {"g": model}).withColumn("perplexity", F.element_at("bonus", 1) / 10)
    return rounded(own.crossJoin(F.broadcast(model.tables["spread"])).select("p_partkey", "perplexity", "mean", "std"))


@query(text_labels_sql("documents", "text", "char", "doc_id"))
def text_labels(spark, sf):
    return _text_labels(spark, sf, "documents", "text", "char", "doc_id")


@query(text_labels_sql("part", "p_name", "token", "p_partkey"))
def text_labels_tokens(spark, sf):
    return _text_labels(spark, sf, "part", "p_name", "token", "p_partkey")


# --- pipelines and scorers on events

EVENTS = """
[spread]
generator_type = NumericField
field_name = value
[kind]
generator_type = MultinomialField
field_name = event_type
relative_threshold = 0.2   # about every other kind
[props]
generator_type = MultinomialField
field_name = props
absolute_threshold = 95
relative_threshold = 0.0095
[pair]
generator_type = MultinomialFieldCombiner
field_names = ['user_id', 'event_type']
absolute_threshold = 10
relative_threshold = 0.0009
[own]
generator_type = NumericField
field_name = value
group_by = user_id
label_for_normal = False
[word]
generator_type = KeywordBased
field_name = event_type
keyword_list = ['click', 'error']
[pattern]
generator_type = KnowledgeBased
field_name = props
rules_and_labels_tuple_list = [(': 1[0-9]}', 'K_TEENS'), (': 9', 'K_HIGH')]
[AnomalyScoring]
scoring_algorithm = StatisticalNGramAnomaly
"""

EVENT_LABELS = f"""
v AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events),
u AS (SELECT user_id AS k, avg(value) AS um, stddev_pop(value) AS us, count(*) AS un FROM events GROUP BY 1),
et AS (SELECT event_type AS k, count(*) AS etn, count(*) / sum(count(*)) OVER () AS etp FROM events GROUP BY 1),
pr AS (SELECT props AS k, count(*) AS prn, count(*) / sum(count(*)) OVER () AS prp FROM events GROUP BY 1),
ue AS (SELECT user_id AS k, event_type AS k2, count(*) AS uen, count(*) / sum(count(*)) OVER () AS uep FROM events GROUP BY 1, 2),
labels AS (SELECT event_id, user_id, event_type, value, props, ts, list_filter([
  {deviation_sql("value", "m", "s", "VALUE", 1, 2)},
  CASE WHEN etn < 10 THEN 'LOW_OBS_COUNT_FOR_EVENT_TYPE' ELSE '' END, CASE WHEN etp < 0.2 THEN 'LOW_OBS_PROB_FOR_EVENT_TYPE' ELSE '' END,
  CASE WHEN prn < 95 THEN 'LOW_OBS_COUNT_FOR_PROPS' ELSE '' END, CASE WHEN prp < 0.0095 THEN 'LOW_OBS_PROB_FOR_PROPS' ELSE '' END,
  CASE WHEN uen < 10 THEN 'LOW_OBS_COUNT_FOR_USER_ID_EVENT_TYPE_PAIR' ELSE '' END, CASE WHEN uep < 0.0009 THEN 'LOW_OBS_PROB_FOR_USER_ID_EVENT_TYPE_PAIR' ELSE '' END,
  CASE WHEN un <= 5 THEN 'RARE_KEY_FOR_VALUE' ELSE {deviation_sql("value", "um", "us", "VALUE", 1, 2, normal=False)} END,
  CASE WHEN event_type = 'click' THEN 'EVENT_TYPE_KEYWORD_CLICK' ELSE '' END, CASE WHEN event_type = 'error' THEN 'EVENT_TYPE_KEYWORD_ERROR' ELSE '' END,
  CASE WHEN regexp_matches(props, ': 1[0-9]}}') THEN 'K_TEENS' ELSE '' END, CASE WHEN regexp_matches(props, ': 9') THEN 'K_HIGH' ELSE '' END], lambda x: x <> '') AS labels
  FROM events JOIN et ON event_type = et.k JOIN pr ON props = pr.k JOIN u ON user_id = u.k JOIN ue ON user_id = ue.k AND event_type = ue.k2, v)"""

#: After a CTE `labels` with the column labels: sets, their combinations, and their costs.
NGRAMS = """
sets AS (SELECT list_sort(labels) AS key, count(*) AS n FROM labels GROUP BY 1),
pos AS (SELECT key, n, unnest(key) AS x, generate_subscripts(key, 1) AS i FROM sets),
each AS (
  SELECT key, n, 1 AS size, [x] AS gram FROM pos
  UNION ALL SELECT a.key, a.n, 2, [a.x, b.x] FROM pos a JOIN pos b ON a.key = b.key AND a.i < b.i
  UNION ALL SELECT a.key, a.n, 3, [a.x, b.x, c.x] FROM pos a JOIN pos b ON a.key = b.key AND a.i < b.i JOIN pos c ON b.key = c.key AND b.i < c.i),
combos AS (SELECT size, gram, CAST(sum(n) AS BIGINT) AS n FROM each GROUP BY ALL),
costs AS (SELECT size, gram, n, -ln(n / sum(n) OVER (PARTITION BY size)) AS cost FROM combos),
set_scores AS (SELECT key, sum(coalesce(cost, -ln(1e-8))) AS s FROM each LEFT JOIN costs USING (gram) GROUP BY key)"""


def events_model(df: DataFrame, **scorer) -> PipelineModel:
    config = PipelineConfig.from_string(EVENTS)
    return LabelPipeline(config.select(**scorer) if scorer else config).fit(df)


def labelled_events(spark, sf) -> DataFrame:
    e, config = table(spark, sf, "events"), PipelineConfig.from_string(EVENTS)
    from tagsmith.plans.pipeline import generator

    return labelled(e, {s: generator(k, **a).fit(e) for s, (k, a) in config.generators.items()})


@query(f"WITH {EVENT_LABELS} SELECT event_id, array_to_string(labels, '|') AS labels FROM labels")
def label_concat_pipeline(spark, sf):
    return labelled_events(spark, sf).select("event_id", joined())


@query(f"WITH {EVENT_LABELS}, {NGRAMS} SELECT CAST(size AS INTEGER) AS size, array_to_string(gram, '|') AS gram, n, round(cost, 6) AS cost FROM costs")
def ngram_anomaly_counts(spark, sf):
    model = anomaly.StatisticalNGramAnomaly().fit(labelled_events(spark, sf))
    return rounded(anomaly.negative_logs(model.tables["combinations"]).select("size", F.array_join("gram", "|").alias("gram"), "n", "cost"))


@query(f"WITH {EVENT_LABELS}, {NGRAMS} SELECT event_id, array_to_string(labels, '|') AS labels, round(coalesce(s, 0), 6) AS score FROM labels LEFT JOIN set_scores ON list_sort(labels) = key")
def ngram_anomaly_scores(spark, sf):
    e = table(spark, sf, "events")
    return rounded(events_model(e).transform(e).select("event_id", joined(), "score"))


@query(f"WITH {EVENT_LABELS}, {NGRAMS} SELECT CAST(size AS INTEGER) AS size, array_to_string(gram, '|') AS gram, n FROM costs")
def ngram_incremental(spark, sf):
    e, scorer = labelled_events(spark, sf), anomaly.StatisticalNGramAnomaly()
    model = scorer.fit(e.filter(f"NOT ({SPLIT})"), base=scorer.fit(e.filter(SPLIT)))
    return model.tables["combinations"].select("size", F.array_join("gram", "|").alias("gram"), "n")


@query(f"""WITH {perplexity_sql("part", "p_name", "char")},
c AS (SELECT p_brand AS k, count(*) AS cn, count(*) / sum(count(*)) OVER () AS cp FROM part GROUP BY 1),
labels AS (SELECT p_partkey, p * 10 AS bonus, list_filter([CASE WHEN p - m < 2 * s THEN '' WHEN p - m < 4 * s THEN 'P_NAME_HIGH_PERPLEXITY' ELSE 'P_NAME_EXTREEME_PERPLEXITY' END,
  CASE WHEN cn < 80 THEN 'LOW_OBS_COUNT_FOR_P_BRAND' ELSE '' END, CASE WHEN cp < 0.04 THEN 'LOW_OBS_PROB_FOR_P_BRAND' ELSE '' END], lambda x: x <> '') AS labels
  FROM part JOIN perplexity ON p_name = t JOIN c ON p_brand = k, spread), {NGRAMS}
SELECT p_partkey, round(coalesce(set_scores.s, 0) + bonus, 6) AS score FROM labels LEFT JOIN set_scores ON list_sort(labels) = key""")
def ngram_with_bonus(spark, sf):
    p = table(spark, sf, "part")
    config = PipelineConfig({"a": ("TextField", {"field_name": "p_name"}), "b": ("MultinomialField", {"field_name": "p_brand", "absolute_threshold": 80, "relative_threshold": 0.04})})
    return rounded(LabelPipeline(config).fit(p).transform(p).select("p_partkey", "score"))


@query(f"WITH {EVENT_LABELS}, {NGRAMS} SELECT event_id, round(coalesce(s, 0), 6) AS score FROM labels LEFT JOIN set_scores ON list_sort(labels) = key ORDER BY round(coalesce(s, 0), 6) DESC, event_id LIMIT 100")
def anomaly_top_k(spark, sf):
    e = table(spark, sf, "events")
    return top_anomalies(rounded(events_model(e).transform(e).select("event_id", "score")), 100, "event_id")


@query(f"WITH {EVENT_LABELS}, {NGRAMS}, scored AS (SELECT event_id, coalesce(s, 0) AS score FROM labels LEFT JOIN set_scores ON list_sort(labels) = key) SELECT event_id, round(score, 6) AS score FROM scored")
def saved_model_scores(spark, sf):
    """Fit, save, load and score."""
    e = table(spark, sf, "events")
    where = scratch(spark, "model")
    events_model(e).save(spark, where)
    return rounded(PipelineModel.load(spark, where).transform(e).select("event_id", "score"))


@query(f"WITH {EVENT_LABELS}, {NGRAMS} SELECT event_id, array_to_string(labels, '|') AS labels, round(coalesce(s, 0), 6) AS score FROM labels LEFT JOIN set_scores ON list_sort(labels) = key")
def streaming_score(spark, sf):
    """The table as a stream, scored row by row into a sink."""
    e = table(spark, sf, "events")
    model, out = events_model(e), scratch(spark, "stream")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_source(e, sf))
    scored = score_stream(model, stream).select("event_id", joined(), "score")
    q = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(spark.read.parquet(out))


def _stream_source(e: DataFrame, sf: str) -> str:
    """Streams read folders; a table that is a single file is copied into one."""
    if len(e.inputFiles()) > 1 or not e.inputFiles()[0].endswith("/events.parquet"):
        return f"{sf}/events.parquet"
    where = scratch(e.sparkSession, "events")
    e.write.parquet(where)
    return where


# --- other scorers


@query(f"WITH {EVENT_LABELS}, l AS (SELECT DISTINCT unnest(labels) AS label FROM labels) SELECT event_id, array_to_string(list_sort(list_distinct(labels)), '|') AS key, CAST(len(list_distinct(labels)) AS INTEGER) AS n, (SELECT count(*) FROM l) AS classes FROM labels")
def label_nhot(spark, sf):
    e = labelled_events(spark, sf)
    classes = len(vocabulary(label_sets(e, distinct=True)))
    key = F.array_distinct(sorted_labels())
    return e.select("event_id", F.array_join(key, "|").alias("key"), F.size(key).alias("n"), F.lit(classes).cast("long").alias("classes"))


def _scored_events(spark, sf, **scorer) -> DataFrame:
    e = table(spark, sf, "events")
    return rounded(events_model(e, **scorer).transform(e).select("event_id", joined(), "score"))


def directions_sql(k: int) -> str:
    """After EVENT_LABELS (WITH RECURSIVE): hot (key, n, x: labels as 0 and 1) and v1 to vk, the leading directions: squares
    of the Gram matrix tend to the first one's projection, and what is left without it gives the next."""
    scaled = "list_transform(m, lambda r: list_transform(r, lambda c: c / list_sum(list_transform(m, lambda q, i: q[i]))))"
    square = "list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c)))"
    parts = []
    for j in range(1, k + 1):
        parts.append(f"""
p{j} AS (SELECT 0 AS t, {scaled} AS m FROM (SELECT g AS m FROM g{j}) UNION ALL SELECT t + 1, {scaled} FROM (SELECT t, {square} AS m FROM p{j} WHERE t < 40)),
v{j} AS (SELECT list_transform(r, lambda c: c / sqrt(list_dot_product(r, r))) AS v FROM (SELECT m[list_position(d, list_max(d))] AS r FROM (SELECT m, list_transform(m, lambda q, i: q[i]) AS d FROM p{j} WHERE t = 40))),
g{j + 1} AS (SELECT list_transform(g, lambda r, a: list_transform(r, lambda c, b: c - v[a] * v[b] * e)) AS g FROM (SELECT g, v, list_dot_product(v, list_transform(g, lambda r: list_dot_product(r, v))) AS e FROM g{j}, v{j}))""")
    return f"""
voc AS (SELECT label, row_number() OVER (ORDER BY label) AS i FROM (SELECT DISTINCT unnest(labels) AS label FROM labels)),
hot AS (SELECT key, n, list_transform(every, lambda l: CASE WHEN list_contains(key, l) THEN 1.0::DOUBLE ELSE 0 END) AS x
  FROM (SELECT list_sort(list_distinct(labels)) AS key, count(*) AS n FROM labels GROUP BY 1), (SELECT list(label ORDER BY i) AS every FROM voc)),
g1 AS (SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(s ORDER BY j) AS r FROM (SELECT a.i AS i, b.i AS j, sum(n * x[a.i] * x[b.i]) AS s FROM hot, voc a, voc b GROUP BY ALL) GROUP BY i)),{",".join(parts)}"""


@query(f"""WITH RECURSIVE {EVENT_LABELS}, {directions_sql(4)}
SELECT event_id, array_to_string(labels, '|') AS labels, round(sqrt(greatest(0, list_dot_product(x, x) - {" - ".join(f"list_dot_product(x, v{j}.v) ** 2" for j in range(1, 5))})), 6) AS score
FROM labels JOIN hot ON list_sort(list_distinct(labels)) = key, v1, v2, v3, v4""")
def svd_reconstruction(spark, sf):
    return _scored_events(spark, sf, scorer="SVDAnomaly")


@query()
def iforest_scores(spark, sf):
    return _scored_events(spark, sf, scorer="IFAnomaly")


@query()
def lof_scores(spark, sf):
    return _scored_events(spark, sf, scorer="LOFAnomaly")


@query()
def supervised_scores(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "lang", "n_chars", "quality")
    config = PipelineConfig.from_string("""
[words]
generator_type = KnowledgeBased
field_name = text
rules_and_labels_tuple_list = [('!!', 'SHOUT'), ('[|]', 'BARS'), ('[*&%$#]{3}', 'SIGNS'), ('License', 'LICENSE')]
[size]
generator_type = NumericField
field_name = n_chars
[lang]
generator_type = MultinomialField
field_name = lang
[AnomalyScoring]
scoring_algorithm = SupervisedClassifierAnomaly
ground_truth_column = quality
classifier = sklearn.linear_model.LogisticRegression
C = 10
""")
    return rounded(LabelPipeline(config).fit(d).transform(d).select("doc_id", "quality", joined(), "score"))


def stub_classifier(commands: list[str], platform: str) -> list[tuple[str, list[str]]]:
    """Stands in for the pretrained models, which aren't bundled: texts of few spaces count as bad."""
    return [("BAD" if c.count(" ") * 12 < len(c) else "GOOD", [f"{platform}_{len(c) % 3}"]) for c in commands]


@query("SELECT doc_id, CASE WHEN (length(text) - length(replace(text, ' ', ''))) * 12 < length(text) THEN 'BAD' ELSE 'GOOD' END || '|LINUX_' || (length(text) % 3) AS labels FROM documents")
def lol_labels(spark, sf):
    register_classifier("lol", stub_classifier)
    d = table(spark, sf, "documents")
    return labels_of(d, LOLField("text", return_labels=True).fit(d), "doc_id")


@query("SELECT doc_id, CASE WHEN (length(text) - length(replace(text, ' ', ''))) * 12 < length(text) THEN 'OBFUSCATED' ELSE 'NOT OBFUSCATED' END AS labels FROM documents")
def obfuscation_labels(spark, sf):
    register_classifier("obfuscation", lambda commands, platform: [(s == "BAD", own) for s, own in stub_classifier(commands, platform)])
    d = table(spark, sf, "documents")
    return labels_of(d, ObfuscationField("text").fit(d), "doc_id")


# --- rules

RULES = [
    Rule("odd values", "LOOK_AT", 2.5, {"a": {"labels": ("VALUE_OUTLIER",)}, "b": {"event_type": ("err", "sign"), "props": (r'\{"k": 9',)}}),
    Rule("users", "USER_RANGE", 0.25, {"a": {"user_id": ("1[0-4]$", "77")}}),
]
RULES_SQL = """
fired AS (SELECT *, list_contains(list_transform(labels, lambda x: regexp_matches(x, '^VALUE_OUTLIER')), true) OR (regexp_matches(event_type, '^(err|sign)') AND regexp_matches(props, '^[{]"k": 9')) AS r1,
  regexp_matches(CAST(user_id AS VARCHAR), '^(1[0-4]$|77)') AS r2 FROM labels)"""


@query(f"WITH {EVENT_LABELS}, {NGRAMS}, {RULES_SQL} SELECT event_id, round(coalesce(s, 0) + CASE WHEN r1 THEN 2.5 ELSE 0 END + CASE WHEN r2 THEN 0.25 ELSE 0 END, 6) AS score FROM fired LEFT JOIN set_scores ON list_sort(labels) = key")
def rules_score(spark, sf):
    e = table(spark, sf, "events")
    return rounded(apply_rules(events_model(e).transform(e), RULES).select("event_id", "score"))


@query(f"WITH {EVENT_LABELS}, {RULES_SQL} SELECT event_id, array_to_string(list_concat(labels, list_filter([CASE WHEN r1 THEN 'LOOK_AT' ELSE '' END, CASE WHEN r2 THEN 'USER_RANGE' ELSE '' END], lambda x: x <> '')), '|') AS labels FROM fired")
def rules_labels(spark, sf):
    return apply_rules(labelled_events(spark, sf).withColumn("score", F.lit(0.0)), RULES).select("event_id", joined())


# --- autoconfig

KINDS_SQL = "SELECT '{f}' AS field, CASE WHEN (count(DISTINCT {f}) + max(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END)) / count(*) < 0.1 THEN 'multinomial' ELSE '{kind}' END AS kind FROM {t}"
FIELDS = {"orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "int", "o_orderdate": "text", "o_orderpriority": "text"}, "part": {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "int"}}
ALL_KINDS = {t: " UNION ALL ".join(KINDS_SQL.format(f=f, kind=k, t=t) for f, k in fields.items()) for t, fields in FIELDS.items()}


@query(f"{ALL_KINDS['orders']} UNION ALL {ALL_KINDS['part']}")
def autoconfig_field_types(spark, sf):
    return field_kinds(table(spark, sf, "orders")).unionByName(field_kinds(table(spark, sf, "part"))).select("field", "kind")


@query(f"""WITH k AS ({ALL_KINDS["part"]}), o AS (SELECT field, kind, row_number() OVER () AS i FROM (VALUES {", ".join(f"('{f}', {i})" for i, f in enumerate(FIELDS["part"]))}) v(f, j) JOIN k ON field = f ORDER BY j),
p AS (SELECT field, kind, j FROM k JOIN (VALUES {", ".join(f"('{f}', {i})" for i, f in enumerate(FIELDS["part"]))}) v(f, j) ON field = f)
SELECT CASE kind WHEN 'multinomial' THEN 'MultinomialField' WHEN 'text' THEN 'TextField' ELSE 'NumericField' END AS generator, field AS fields FROM p
UNION ALL SELECT 'MultinomialFieldCombiner', a.field || ',' || b.field FROM p a JOIN p b ON a.j < b.j AND a.kind = 'multinomial' AND b.kind = 'multinomial'""")
def autoconfig_generators(spark, sf):
    made = suggest(table(spark, sf, "part")).generators.values()
    rows = [(kind, ",".join(a["field_names"]) if isinstance(a.get("field_names"), list) else a.get("field_name", a.get("field_names"))) for kind, a in made]
    return spark.createDataFrame(rows, "generator string, fields string")


# --- tables, columns, exports


@query("SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high, count(*) AS n FROM events")
def column_statistics(spark, sf):
    view = TableView(table(spark, sf, "events"))
    v = view["value"]
    return rounded(spark.createDataFrame([(v.mean(), v.std(), v.min(), v.max(), len(view))], "mean double, std double, low double, high double, n long"))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def column_value_counts(spark, sf):
    return TableView(table(spark, sf, "events"))["event_type"].value_counts()


@query("SELECT DISTINCT p_brand FROM part")
def column_unique(spark, sf):
    return TableView(table(spark, sf, "part"))["p_brand"].unique()


@query("SELECT event_id, round(value * 2, 6) AS value FROM events")
def column_apply(spark, sf):
    return rounded(TableView(table(spark, sf, "events"))["value"].apply(lambda v: v * 2, "double").select("event_id", "value"))


@query("SELECT o_orderkey, o_orderstatus || ':' || o_orderpriority AS result FROM orders")
def row_apply(spark, sf):
    return TableView(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")).apply_rows(lambda r: f"{r['o_orderstatus']}:{r['o_orderpriority']}", "string").select("o_orderkey", "result")


@query(f"WITH {EVENT_LABELS} SELECT event_id, '[' || array_to_string(list_transform(labels, lambda x: '''' || x || ''''), ', ') || ']' AS raw, array_to_string(labels, '|') AS labels FROM labels")
def rendered_and_parsed_labels(spark, sf):
    e = labelled_events(spark, sf).select("event_id", rendered_labels(F.col("labels")).alias("raw"))
    return e.select("event_id", "raw", F.array_join(parsed_labels(F.col("raw")), "|").alias("labels"))


@query(f"WITH {EVENT_LABELS} SELECT event_id, 'StatisticalNGramAnomaly' AS model, '[' || array_to_string(list_transform(labels, lambda x: '''' || x || ''''), ', ') || ']' AS raw, value FROM labels")
def exported_rows(spark, sf):
    return exported(labelled_events(spark, sf).drop("bonus"), "StatisticalNGramAnomaly").select("event_id", "model", "raw", "value")
