"""Single records without a Spark job: models by fingerprint, once per process."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tagsmith.plans.config import PipelineConfig
from tagsmith.plans.pipeline import PipelineModel
from tagsmith.sources.store import read_text


@dataclass(frozen=True)
class Config:
    text: str

    @staticmethod
    def from_file(path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return Config(f.read())

    @staticmethod
    def from_string(text: str) -> Config:
        return Config(text)

    @property
    def config(self) -> PipelineConfig:
        return PipelineConfig.from_string(self.text)

    def md5(self) -> str:
        return hashlib.md5(self.text.encode(), usedforsecurity=False).hexdigest()


@dataclass(frozen=True)
class PretrainedModel:
    """A saved pipeline model: its folder and the text of its manifest."""

    path: str
    manifest: str

    @staticmethod
    def from_path(spark: SparkSession, path: str) -> PretrainedModel:
        return PretrainedModel(path, read_text(spark, f"{path}/manifest.json"))

    def md5(self) -> str:
        return hashlib.md5(f"{self.path}\n{self.manifest}".encode(), usedforsecurity=False).hexdigest()


_INSTANCES: dict[str, RowScorer] = {}


class RowScorer:
    """Call it with a record for its labels and score. The model's tables come to the driver with the first call, which
    fails for models that are too large for that."""

    def __init__(self, model: PipelineModel):
        self.model = model

    @staticmethod
    def get_instance(spark: SparkSession, config: Config, pretrained: PretrainedModel) -> RowScorer:
        key = f"{config.md5()}_{pretrained.md5()}"
        if key not in _INSTANCES:
            _INSTANCES[key] = RowScorer(PipelineModel.load(spark, pretrained.path).configured(config.config))
        return _INSTANCES[key]

    def __call__(self, record: dict) -> dict:
        out = self.model.row(record)
        return {"labels": out["labels"], "score": [out["score"]]}
