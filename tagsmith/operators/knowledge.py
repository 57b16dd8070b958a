"""Labels from what is known: keywords, regular expressions, and classifiers of commands that are plugged in."""

from __future__ import annotations

import re
from enum import StrEnum
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions.pyregex import search
from tagsmith.functions.text import words
from tagsmith.operators.base import Generator, GeneratorModel, result


class _Fixed(Generator, GeneratorModel):
    """A generator that learns nothing is its own model."""

    tables: dict[str, DataFrame] = {}

    def fit(self, df: DataFrame, weight: str | None = None, base: GeneratorModel | None = None) -> GeneratorModel:
        return self


class KeywordBased(_Fixed):
    kind = "KeywordBased"

    def __init__(self, keyword_list, field_name: str):
        if isinstance(keyword_list, str):
            keyword_list = [w for w in re.split("[^0-9a-zA-Z]+", keyword_list) if w]
        self.params = {"keyword_list": list(keyword_list), "field_name": field_name}
        self.field, self.keywords = field_name, list(keyword_list)

    def _label(self, keyword: str) -> str:
        return f"{self.field.upper()}_KEYWORD_{keyword.upper()}"

    def attach(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        df = df.withColumn(f"{tag}words", words(F.coalesce(F.col(f"`{self.field}`").cast("string"), F.lit("None"))))
        return df, result([F.when(F.array_contains(f"{tag}words", k), self._label(k)) for k in self.keywords])

    def row(self, record: dict) -> tuple[list[str], list[float]]:
        own = set(re.sub("[^0-9a-zA-Z]+", " ", str(record.get(self.field))).split(" "))
        return [self._label(k) for k in self.keywords if k in own], []


class KnowledgeBased(_Fixed):
    kind = "KnowledgeBased"

    def __init__(self, rules_and_labels_tuple_list, field_name: str):
        self.rules = [(str(p), str(label)) for p, label in rules_and_labels_tuple_list]
        for p, _ in self.rules:
            re.compile(p)
        self.field = field_name
        self.params = {"rules_and_labels_tuple_list": [list(r) for r in self.rules], "field_name": field_name}

    def attach(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        text = F.coalesce(F.col(f"`{self.field}`").cast("string"), F.lit("None"))
        return df, result([F.when(search(text, p), label) for p, label in self.rules])

    def row(self, record: dict) -> tuple[list[str], list[float]]:
        return [label for p, label in self.rules if re.search(p, str(record.get(self.field)))], []


class Platform(StrEnum):
    LINUX = "LINUX"
    WINDOWS = "WINDOWS"
    ALL = "ALL"


class CommandClassifier(Protocol):
    """What is plugged in: for each command its status, and labels of its own."""

    def __call__(self, commands: list[str], platform: str) -> list[tuple[str, list[str]]]: ...


_CLASSIFIERS: dict[str, CommandClassifier] = {}


def register_classifier(name: str, classifier: CommandClassifier) -> None:
    """name: lol (statuses BAD, GOOD, NEUTRAL) or obfuscation (a true status means obfuscated)."""
    _CLASSIFIERS[name] = classifier


class _Command(_Fixed):
    """Runs a classifier on batches of commands; none is bundled."""

    plug: str

    def _classifier(self) -> CommandClassifier:
        if self.plug not in _CLASSIFIERS:
            raise LookupError(f"{self.kind} needs a classifier: register_classifier({self.plug!r}, ...)")
        return _CLASSIFIERS[self.plug]

    def _labels(self, status, own: list[str]) -> list[str]:
        raise NotImplementedError

    def attach(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        classifier, platform, labels = self._classifier(), str(self.platform), self._labels

        @F.pandas_udf("array<string>")
        def classify(commands: pd.Series) -> pd.Series:
            texts = commands.fillna("None").astype(str).tolist()
            return pd.Series([labels(s, own) for s, own in classifier(texts, platform)], index=commands.index)

        return df, result(classify(F.col(f"`{self.field}`").cast("string")))

    def row(self, record: dict) -> tuple[list[str], list[float]]:
        [(status, own)] = self._classifier()([str(record.get(self.field))], str(self.platform))
        return self._labels(status, own), []


class LOLField(_Command):
    kind, plug = "LOLField", "lol"

    def __init__(self, field_name: str, platform=Platform.LINUX, return_labels=False):
        self.field, self.platform, self.return_labels = field_name, Platform(str(platform).rpartition(".")[2]), return_labels
        self.params = {"field_name": field_name, "platform": str(self.platform), "return_labels": return_labels}

    def _labels(self, status, own: list[str]) -> list[str]:
        return [str(status), *(own if self.return_labels else ())]


class ObfuscationField(_Command):
    kind, plug = "ObfuscationField", "obfuscation"

    def __init__(self, field_name: str, platform=Platform.ALL, gpu=False):
        self.field, self.platform = field_name, Platform(str(platform).rpartition(".")[2])
        self.params = {"field_name": field_name, "platform": str(self.platform), "gpu": gpu}

    def _labels(self, status, own: list[str]) -> list[str]:
        return ["OBFUSCATED" if status else "NOT OBFUSCATED"]
