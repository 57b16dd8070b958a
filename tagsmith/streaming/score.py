"""Labels and scores of unbounded tables, and training from them.

Scoring keeps no state: statistics are joined as static tables, texts and label sets are looked up in bounded tables that
tasks get by broadcast. Training goes batch by batch, each continuing the model of the one before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagsmith.operators.base import RESULT
from tagsmith.operators.text_model import TextModel
from tagsmith.plans.config import PipelineConfig
from tagsmith.plans.pipeline import LabelPipeline, PipelineModel


def _attach(model, df: DataFrame, tag: str):
    if not isinstance(model, TextModel):
        return model.attach(df, tag)
    model.of_text("")  # brings its tables to the driver; they must be bounded
    tables = {k: model._local(k, dict) for k in ("ngrams", "vocabulary", "spread")}
    shared = df.sparkSession.sparkContext.broadcast((model.params, tables))

    @F.pandas_udf(RESULT)
    def labels(texts: pd.Series) -> pd.DataFrame:
        params, known = shared.value
        own = TextModel(params, {})
        own._dicts = known
        done = {t: own.of_text(t) for t in texts.unique()}
        return pd.DataFrame([{"labels": done[t][0], "bonus": done[t][1]} for t in texts], index=texts.index)

    return df, labels(F.col(f"`{model.field}`").cast("string"))


def score_stream(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df, streaming or not, with labels, bonus and score, row by row."""
    own, parts = df.columns, []
    for i, m in enumerate(model.models.values()):
        df, column = _attach(m, df, f"__g{i}_")
        df = df.withColumn(f"__g{i}", column.cast(RESULT))
        parts.append(f"__g{i}")
    collect = lambda what: F.flatten(F.array(*(F.col(p)[what] for p in parts)))
    out = df.select(*(F.col(f"`{c}`") for c in own), collect("labels").alias("labels"), collect("bonus").alias("bonus"))
    return out if model.scoring is None else model.scoring.score_stream(out)


def train_stream(df: DataFrame, config: PipelineConfig, model_path: str, checkpoint: str) -> StreamingQuery:
    """Fit on each batch of a streaming table, continuing the model saved before; versions are model_path/0, /1, ..."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = PipelineModel.load(spark, f"{model_path}/{number - 1}") if number else None
        LabelPipeline(config).fit(batch, base).save(spark, f"{model_path}/{number}")

    return df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
