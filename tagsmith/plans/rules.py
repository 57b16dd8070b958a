"""Rules: YAML files whose conditions add a label and an amount to the score."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagsmith.functions.pyregex import match, to_java


@dataclass(frozen=True)
class Rule:
    """conditions: case to attribute to patterns. A case holds if each attribute matches one of its patterns from the
    start; the rule, if a case holds."""

    name: str
    label: str
    score: float
    conditions: dict[str, dict[str, tuple[str, ...]]]

    @staticmethod
    def parse(data: dict, where: str = "") -> Rule:
        missing = [k for k in ("rule name", "rule label", "rule score", "conditions") if k not in data]
        if missing or not isinstance(data["conditions"], dict):
            raise ValueError(f"rule {where}: {', '.join(missing) or 'conditions'} missing")
        cases = {str(c): {str(a): tuple(map(str, p if isinstance(p, list) else [p])) for a, p in (attributes or {}).items()} for c, attributes in data["conditions"].items()}
        return Rule(str(data["rule name"]), str(data["rule label"]), float(data["rule score"]), cases)


def load_rules(folder: str) -> list[Rule]:
    """All *.yaml below the folder, by path; empty files are left out."""
    import yaml

    paths = sorted(os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f.endswith(".yaml"))
    out = []
    for p in paths:
        with open(p, encoding="utf-8") as f:
            data = yaml.safe_load(f)
        if data:
            out.append(Rule.parse(data, p))
    return out


def _matcher(pattern: str):
    return lambda x: match(x, pattern)


def _holds(df: DataFrame, attribute: str, patterns: tuple[str, ...]) -> Column:
    if attribute not in df.columns:
        raise ValueError(f"no column {attribute!r}; there are {', '.join(df.columns)}")
    c, kind = F.col(f"`{attribute}`"), df.schema[attribute].dataType
    if isinstance(kind, T.ArrayType):  # any of its labels
        if all(to_java(p) is not None for p in patterns):
            return F.coalesce(reduce(lambda a, b: a | b, (F.exists(c, _matcher(p)) for p in patterns)), F.lit(False))
        raise ValueError(f"a pattern for {attribute!r} has no Java form")
    return reduce(lambda a, b: a | b, (match(c.cast("string"), p) for p in patterns))


def apply_rules(df: DataFrame, rules: list[Rule], per_condition: bool = False) -> DataFrame:
    """df with label and score of the rules that hold added. All rules see the labels as they are in df. A rule counts
    once, or, with per_condition, once for each of its cases that holds."""
    hits: list[tuple[Rule, Column]] = []
    for rule in rules:
        cases = [reduce(lambda a, b: a & b, (_holds(df, a, p) for a, p in attributes.items()), F.lit(True)) for attributes in rule.conditions.values()]
        if not cases:
            continue
        hits += [(rule, c) for c in cases] if per_condition else [(rule, reduce(lambda a, b: a | b, cases))]
    if not hits:
        return df
    labels = F.concat(F.coalesce(F.col("labels"), F.array().cast("array<string>")), F.array_compact(F.array(*(F.when(c, F.lit(r.label)) for r, c in hits))))
    score = reduce(lambda a, b: a + b, (F.when(c, F.lit(r.score)).otherwise(0.0) for r, c in hits), F.col("score"))
    return df.withColumns({"labels": labels, "score": score})
