"""A configuration from a look at a table: kinds of its columns, and generators that suit them."""

from __future__ import annotations

import inspect
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.functions.coerce import value_kind
from tagsmith.operators.base import weight_of
from tagsmith.plans.config import PipelineConfig
from tagsmith.plans.pipeline import GENERATORS

#: Distinct values by rows below which a column counts as one of categories.
CATEGORICAL = 0.1
HEADER = "; Generated from a table. Sections may be copied, edited and removed."


def field_kinds(df: DataFrame, count_column: str | None = None) -> DataFrame:
    """field and kind (int, float, multinomial or text) of each column, in order: one pass. An empty table has no kinds."""
    parts = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        kind = value_kind(c, f.dataType)
        parts += [
            F.max(F.when(kind == "str", 2).when(kind == "float", 1).otherwise(0)).alias(f"k{i}"),
            (F.count_distinct(c.cast("string")) + F.max(c.isNull().cast("int"))).alias(f"d{i}"),
        ]
    row = df.agg(F.sum(weight_of(count_column)).alias("n"), *parts)
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("field"), F.col(f"k{i}").alias("k"), F.col(f"d{i}").alias("d")) for i, f in enumerate(df.schema.fields)))
    long = row.filter("n > 0").select("n", F.explode(each).alias("e")).select("e.*", "n")
    kind = F.when(F.col("d") / F.col("n") < CATEGORICAL, "multinomial").when(F.col("k") == 2, "text").when(F.col("k") == 1, "float").otherwise("int")
    return long.select("i", "field", kind.alias("kind"))


def suggestions(kinds: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Generator and fields for each column and each pair of categories, by the generator's name."""
    single = {"int": "NumericField", "float": "NumericField", "multinomial": "MultinomialField", "text": "TextField"}
    out = [(single[k], [f]) for f, k in kinds if k in single]
    out += [("MultinomialFieldCombiner", list(p)) for p in itertools.combinations([f for f, k in kinds if k == "multinomial"], 2)]
    return sorted(out, key=lambda x: x[0])


def suggest(df: DataFrame, count_column: str | None = None) -> PipelineConfig:
    kinds = [(r.field, r.kind) for r in field_kinds(df, count_column).orderBy("i").collect()]
    sections = {}
    for i, (name, fields) in enumerate(suggestions(kinds), 1):
        arguments = {}
        for p in inspect.signature(GENERATORS[name].__init__).parameters.values():
            if p.name in ("field_name", "field_names"):
                arguments[p.name] = fields[0] if len(fields) == 1 else fields
            elif p.name != "self":
                arguments[p.name] = p.default
        sections[f"LG_{i}"] = (name, arguments)
    return PipelineConfig(sections, count_column=count_column)
