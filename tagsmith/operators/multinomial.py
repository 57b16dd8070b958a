"""MultinomialField and MultinomialFieldCombiner: values, or tuples of them, that are rare or new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsmith.operators.base import Generator, GeneratorModel, as_list, join_stats, result, weight_of
from tagsmith.sources.store import bounded


def counts(df: DataFrame, fields: list[str], group_by: list[str], weight: str | None) -> DataFrame:
    """The group's and the fields' columns, and n."""
    keys = [F.col(f"`{c}`") for c in (*group_by, *(f for f in fields if f not in group_by))]
    return df.groupBy(*keys).agg(F.sum(weight_of(weight)).alias("n"))


def with_shares(table: DataFrame, group_by: list[str]) -> DataFrame:
    """total of the group, and prob."""
    if group_by:
        table = table.withColumn("total", F.sum("n").over(Window.partitionBy(*(F.col(f"`{g}`") for g in group_by))))
    else:
        table = table.crossJoin(F.broadcast(table.agg(F.sum("n").alias("total"))))  # one row
    return table.withColumn("prob", F.try_divide(F.col("n"), F.col("total")))


class MultinomialFieldCombiner(Generator):
    suffix = "_PAIR"

    def __init__(self, field_names=(), absolute_threshold=10, relative_threshold=0.1, group_by=None):
        self.params = {"fields": as_list(field_names), "group_by": as_list(group_by), "absolute": absolute_threshold, "relative": relative_threshold, "suffix": self.suffix}
        if not self.params["fields"]:
            raise ValueError("no field")

    def fit(self, df: DataFrame, weight: str | None = None, base: GeneratorModel | None = None) -> MultinomialModel:
        new = MultinomialModel(self.params, {"counts": counts(df, self.params["fields"], self.params["group_by"], weight)})
        return new if base is None else base.merge(new)


class MultinomialField(MultinomialFieldCombiner):
    suffix = ""

    def __init__(self, field_name: str, absolute_threshold=10, relative_threshold=0.1, group_by=None):
        super().__init__([field_name], absolute_threshold, relative_threshold, group_by)


class MultinomialModel(GeneratorModel):
    kind = "Multinomial"

    def __init__(self, params: dict, tables: dict[str, DataFrame]):
        self.params, self.tables = params, tables
        self.fields, self.group_by = params["fields"], params["group_by"]
        self.keys = [*self.group_by, *(f for f in self.fields if f not in self.group_by)]
        based = f"_BASED_ON_{'_'.join(self.group_by).upper()}" if self.group_by else ""
        self.name = "_".join(self.fields).upper() + params["suffix"] + based

    def merge(self, other: MultinomialModel) -> MultinomialModel:
        both = self.tables["counts"].unionByName(other.tables["counts"])
        return MultinomialModel(other.params, {"counts": both.groupBy(*(F.col(f"`{k}`") for k in self.keys)).agg(F.sum("n").alias("n"))})

    def attach(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        table = with_shares(self.tables["counts"], self.group_by)
        df = join_stats(df, table, self.keys, tag)
        new = F.col(f"{tag}seen").isNull()
        if self.group_by:
            groups = self.tables["counts"].select(*(F.col(f"`{g}`") for g in self.group_by)).distinct()
            df = join_stats(df, groups, self.group_by, f"{tag}g_")
            new = new & F.col(f"{tag}g_seen").isNotNull()
        few = F.when(F.col(f"{tag}n") < self.params["absolute"], f"LOW_OBS_COUNT_FOR_{self.name}")
        rare = F.when(F.col(f"{tag}prob") < self.params["relative"], f"LOW_OBS_PROB_FOR_{self.name}")
        return df, result([F.when(new, f"UNSEEN_{self.name}"), few, rare])

    def row(self, record: dict) -> tuple[list[str], list[float]]:
        def build() -> dict:
            out: dict = {}
            for r in bounded(with_shares(self.tables["counts"], self.group_by)):
                out.setdefault(tuple(r[g] for g in self.group_by), {})[tuple(r[f] for f in self.fields)] = (r.n, r.prob)
            return out

        known = self._local("counts", build)
        group = tuple(record.get(g) for g in self.group_by)
        if group not in known:
            return ([] if self.group_by else [f"UNSEEN_{self.name}"]), []
        n, prob = known[group].get(tuple(record.get(f) for f in self.fields), (None, None))
        if n is None:
            return [f"UNSEEN_{self.name}"], []
        return [f"LOW_OBS_COUNT_FOR_{self.name}"] * (n < self.params["absolute"]) + [f"LOW_OBS_PROB_FOR_{self.name}"] * (prob < self.params["relative"]), []


class NumericalFieldCombiner(Generator):
    """Named in configurations, but without a meaning so far."""

    def __init__(self, field_names=(), normalize=True):
        raise NotImplementedError("NumericalFieldCombiner has no defined labels")

    def fit(self, df, weight=None, base=None):
        raise NotImplementedError
