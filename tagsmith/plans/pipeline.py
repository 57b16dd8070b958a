"""Pipelines: label generators in order, then a scorer."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.operators import anomaly, knowledge
from tagsmith.operators.base import RESULT, Generator, GeneratorModel
from tagsmith.operators.labelsets import Scorer, ScorerModel
from tagsmith.operators.multinomial import MultinomialField, MultinomialFieldCombiner, MultinomialModel, NumericalFieldCombiner
from tagsmith.operators.numeric import NumericField, NumericModel
from tagsmith.operators.text_model import TextField, TextModel
from tagsmith.plans.config import PipelineConfig
from tagsmith.sources import store

log = logging.getLogger(__name__)

GENERATORS: dict[str, Callable[..., Generator]] = {c.__name__: c for c in (NumericField, MultinomialField, MultinomialFieldCombiner, TextField, NumericalFieldCombiner, knowledge.KeywordBased, knowledge.KnowledgeBased, knowledge.LOLField, knowledge.ObfuscationField)}
#: How a model is made again from its manifest and tables.
MODELS: dict[str, Callable[[dict, dict], GeneratorModel]] = {c.kind: c for c in (NumericModel, MultinomialModel, TextModel)}
MODELS |= {c.kind: (lambda params, tables, c=c: c(**params)) for c in (knowledge.KeywordBased, knowledge.KnowledgeBased, knowledge.LOLField, knowledge.ObfuscationField)}


def register_generator(name: str, generator: Callable[..., Generator], kind: str | None = None, restore: Callable[[dict, dict], GeneratorModel] | None = None) -> None:
    """A generator of one's own for configurations; restore makes its saved model of this kind again."""
    GENERATORS[name] = generator
    if restore is not None:
        MODELS[kind or name] = restore


def register_scorer(name: str, scorer: Callable[..., Scorer], kind: str | None = None, restore: Callable[[dict, dict], ScorerModel] | None = None) -> None:
    anomaly.SCORERS[name] = scorer
    if restore is not None:
        anomaly.MODELS[kind or name] = restore


def generator(kind: str, **arguments) -> Generator:
    if kind not in GENERATORS:
        raise LookupError(f"no generator {kind!r}; there are {', '.join(sorted(GENERATORS))}")
    return GENERATORS[kind](**arguments)


def scorer(kind: str, **arguments) -> Scorer:
    if kind not in anomaly.SCORERS:
        raise LookupError(f"no scorer {kind!r}; there are {', '.join(sorted(anomaly.SCORERS))}")
    return anomaly.SCORERS[kind](**arguments)


def labelled(df: DataFrame, models: dict[str, GeneratorModel]) -> DataFrame:
    """df with labels and bonus of all models in order; columns of those names are replaced."""
    own, parts = [c for c in df.columns if c not in ("labels", "bonus")], []
    for i, model in enumerate(models.values()):
        df, column = model.attach(df, f"__g{i}_")
        df = df.withColumn(f"__g{i}", column.cast(RESULT))
        parts.append(f"__g{i}")
    collect = lambda what, kind: F.flatten(F.array(*(F.col(p)[what] for p in parts))) if parts else F.array().cast(kind)
    return df.select(*(F.col(f"`{c}`") for c in own), collect("labels", "array<string>").alias("labels"), collect("bonus", "array<double>").alias("bonus"))


@dataclass
class PipelineModel:
    config: PipelineConfig
    models: dict[str, GeneratorModel]
    scoring: ScorerModel | None = None
    _extra: dict = field(default_factory=dict)

    def label(self, df: DataFrame) -> DataFrame:
        return labelled(df, self.models)

    def transform(self, df: DataFrame, labels: str = "labels", score: str = "score") -> DataFrame:
        """df with labels, bonus and score, the first and last under names of choice: then columns of df that are called
        labels and score stay. Columns of the names chosen are replaced."""
        stay = [c for c, dest in (("labels", labels), ("score", score)) if dest != c and c in df.columns]
        out = self.label(df.withColumns({f"__own_{c}": F.col(c) for c in stay}) if stay else df)
        out = out if self.scoring is None else self.scoring.score(out)
        for made, dest in (("labels", labels), ("score", score)):
            if made in out.columns and dest != made:
                out = out.drop(dest).withColumnRenamed(made, dest)
        return out.withColumnsRenamed({f"__own_{c}": c for c in stay if c not in (labels, score)})

    def configured(self, config: PipelineConfig) -> PipelineModel:
        """The fitted generators that the configuration has, in its order, and its scorer, which must be the fitted one."""
        missing = [s for s in config.generators if s not in self.models]
        if missing:
            raise LookupError(f"the model has no {', '.join(missing)}")
        if self.scoring is None or config.scorer != self.scoring.kind:
            raise LookupError(f"the model has no scorer {config.scorer}")
        return PipelineModel(config, {s: self.models[s] for s in config.generators}, self.scoring)

    def row(self, record: dict) -> dict:
        """One record without Spark."""
        labels, bonus = [], []
        for m in self.models.values():
            own, add = m.row(record)
            labels += own
            bonus += add
        return {"labels": labels, "score": None if self.scoring is None else self.scoring.score_one(labels, bonus)}

    def save(self, spark: SparkSession, path: str) -> None:
        manifest = {"config": self.config.to_string(), "model": {}, "scoring": None}
        tables = {}
        for i, (section, m) in enumerate(self.models.items()):
            manifest["model"][section] = {"kind": m.kind, "params": m.params, "tables": {t: f"g{i}_{t}" for t in m.tables}}
            tables |= {f"g{i}_{t}": df for t, df in m.tables.items()}
        if self.scoring is not None:
            s = self.scoring
            manifest["scoring"] = {"kind": s.kind, "params": s.params, "tables": {t: f"s_{t}" for t in s.tables}}
            tables |= {f"s_{t}": df for t, df in s.tables.items()}
            if getattr(s, "model", None) is not None:
                s.model.write().overwrite().save(f"{path}/classifier")
                manifest["scoring"]["classifier"] = type(s.model).__name__
        manifest["order"] = list(self.models)
        store.save(spark, path, manifest, tables)

    @staticmethod
    def load(spark: SparkSession, path: str) -> PipelineModel:
        manifest, table = store.load(spark, path)
        config = PipelineConfig.from_string(manifest["config"])
        models = {s: MODELS[m["kind"]](m["params"], {t: table(f) for t, f in m["tables"].items()}) for s, m in ((s, manifest["model"][s]) for s in manifest["order"])}
        scoring, s = None, manifest["scoring"]
        if s is not None:
            scoring = anomaly.MODELS[s["kind"]](s["params"], {t: table(f) for t, f in s["tables"].items()})
            if "classifier" in s:
                from pyspark.ml import classification

                scoring.model = getattr(classification, s["classifier"]).load(f"{path}/classifier")
        return PipelineModel(config, models, scoring)

    def fingerprint(self) -> str:
        parts = {s: (m.kind, m.params) for s, m in self.models.items()}
        return json.dumps([self.config.md5(), parts, None if self.scoring is None else self.scoring.kind], sort_keys=True, default=str)


class LabelPipeline:
    """Fits a configuration. Subclasses may override prepare(), which sees every table first."""

    def __init__(self, config: PipelineConfig):
        self.config = config

    def prepare(self, df: DataFrame) -> DataFrame:
        return df

    def fit(self, df: DataFrame, base: PipelineModel | None = None) -> PipelineModel:
        """base: a fitted model that goes on with df's rows: statistics and the scorer's counts continue."""
        df, models, weight = self.prepare(df), {}, self.config.count_column
        for section, (kind, arguments) in self.config.generators.items():
            model = generator(kind, **arguments).fit(df, weight, base.models.get(section) if base else None)
            for w in getattr(model, "warnings", lambda: [])() if base is None else ():
                log.warning("%s", w)
            # each table is used by the scorer's fit and every transform: computed once
            model.tables = {k: store.kept(t, "model-table") if not isinstance(model, TextModel) else t for k, t in model.tables.items()} if getattr(model, "tables", None) else {}
            models[section] = model
        scoring = scorer(self.config.scorer, **self.config.scorer_arguments).fit(labelled(df, models), base.scoring if base and base.scoring and base.scoring.kind == self.config.scorer else None)
        return PipelineModel(self.config, models, scoring)


def full_process(df: DataFrame, config: PipelineConfig) -> tuple[PipelineModel, DataFrame]:
    """Fit and score one table."""
    model = LabelPipeline(config).fit(df)
    return model, model.transform(df)


def top_anomalies(scored: DataFrame, k: int, *tie: str) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), *tie).limit(k)
