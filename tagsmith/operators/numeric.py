"""NumericField: how far a number is from the mean, in deviations, as a ratio or as a difference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsmith.functions.coerce import as_float
from tagsmith.operators.base import Generator, GeneratorModel, as_list, field_type, join_stats, result, weight_of
from tagsmith.sources.store import bounded

#: Put in the place of a deviation, mean or value of 0; a group with more rows than RARE is labelled.
TINY, RARE = 0.01, 5
OPTIONS = {"stdev": True, "stdev_borderline_threshold": 1, "stdev_outlier_threshold": 2, "spike": "none", "spike_inverse": False, "spike_borderline_threshold": 10, "spike_outlier_threshold": 20, "label_for_normal": True}


def stats(df: DataFrame, field: str, group_by: list[str], weight: str | None) -> DataFrame:
    """The group's columns, mean, std (of the population) and n, weighted."""
    x = F.col(f"`{field}`").cast("double")
    groups = [F.col(f"`{g}`") for g in group_by]
    if weight is None:
        return df.groupBy(*groups).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(F.lit(1)).alias("n"))
    # equal values first, then deviations from the mean: stable, and the second pass is over few rows
    values = df.select(*groups, x.alias("x_"), weight_of(weight).alias("w_")).groupBy(*groups, "x_").agg(F.sum("w_").alias("w_"))
    if group_by:
        over = Window.partitionBy(*groups)
        values = values.withColumn("mean", F.try_divide(F.sum(F.col("x_") * F.col("w_")).over(over), F.sum("w_").over(over)))
    else:
        mean = values.agg(F.try_divide(F.sum(F.col("x_") * F.col("w_")), F.sum("w_")).alias("mean"))
        values = values.crossJoin(F.broadcast(mean))  # one row
    square = F.sum(F.col("w_") * (F.col("x_") - F.col("mean")) * (F.col("x_") - F.col("mean")))
    return values.groupBy(*groups).agg(F.first("mean").alias("mean"), F.sqrt(F.try_divide(square, F.sum("w_"))).alias("std"), F.sum("w_").alias("n"))


def merged_stats(a: DataFrame, b: DataFrame, group_by: list[str]) -> DataFrame:
    """Mean and deviation of two batches as if they had been one."""
    part = a.select(*(f"`{g}`" for g in group_by), "mean", "std", "n").unionByName(b.select(*(f"`{g}`" for g in group_by), "mean", "std", "n"))
    whole = part.groupBy(*(F.col(f"`{g}`") for g in group_by)).agg(F.collect_list(F.struct("n", "mean", "std")).alias("p"), F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"))
    square = F.aggregate("p", F.lit(0.0), lambda s, x: s + x["n"] * (x["std"] * x["std"] + (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean"))))
    return whole.select(*(f"`{g}`" for g in group_by), "mean", F.sqrt(F.try_divide(square, F.col("n"))).alias("std"), "n")


def deviation_label(field: str, v: Column, mean: Column, std: Column, o: dict) -> Column:
    """NORMAL, BORDERLINE, OUTLIER or null."""
    name = field.upper()
    normal = F.lit(f"{name}_NORMAL") if o["label_for_normal"] else F.lit(None).cast("string")
    std = F.when(std == 0, TINY).otherwise(std)
    near = F.try_divide(F.abs(v - mean), std)
    both = o["stdev"] and o["spike"] != "none"
    if both:
        mean = mean - std if o["spike_inverse"] else mean + std
    nonzero = lambda c: F.when(c == 0, TINY).otherwise(c)
    if o["spike"] == "ratio":
        ratio = F.try_divide(mean, nonzero(v)) if o["spike_inverse"] else F.try_divide(v, nonzero(mean))
    elif o["spike"] == "fixed":
        ratio = mean - v if o["spike_inverse"] else v - mean
    else:
        ratio = near
    kind = "stdev" if o["spike"] == "none" else "spike"
    low, high = o[f"{kind}_borderline_threshold"], o[f"{kind}_outlier_threshold"]
    comparable = ratio.isNotNull() & ~F.isnan(ratio)
    label = F.when(comparable & (ratio > low) & (ratio < high), F.lit(f"{name}_BORDERLINE")).when(comparable & (ratio >= high), F.lit(f"{name}_OUTLIER"))
    if o["label_for_normal"]:
        label = F.when(comparable & (ratio < low), normal).otherwise(label)
    if both:
        label = F.when(~F.isnan(near) & (near < o["stdev_outlier_threshold"]), normal).otherwise(label)
    return label


def deviation_label_row(field: str, v: float, mean: float, std: float, o: dict) -> list[str]:
    """The same for one value."""
    name = field.upper()
    normal = [f"{name}_NORMAL"] if o["label_for_normal"] else []
    std = TINY if std == 0 else std
    near = abs(v - mean) / std
    both = o["stdev"] and o["spike"] != "none"
    if both:
        mean = mean - std if o["spike_inverse"] else mean + std
    if o["spike"] == "ratio":
        ratio = mean / (v or TINY) if o["spike_inverse"] else v / (mean or TINY)
    elif o["spike"] == "fixed":
        ratio = mean - v if o["spike_inverse"] else v - mean
    else:
        ratio = near
    if both and near < o["stdev_outlier_threshold"]:
        return normal
    kind = "stdev" if o["spike"] == "none" else "spike"
    low, high = o[f"{kind}_borderline_threshold"], o[f"{kind}_outlier_threshold"]
    if o["label_for_normal"] and ratio < low:
        return normal
    if low < ratio < high:
        return [f"{name}_BORDERLINE"]
    return [f"{name}_OUTLIER"] if ratio >= high else []


class NumericField(Generator):
    def __init__(self, field_name: str, group_by=None, stdev=True, stdev_borderline_threshold=1, stdev_outlier_threshold=2, spike="none", spike_inverse=False, spike_borderline_threshold=10, spike_outlier_threshold=20, label_for_normal=True):
        if spike not in ("none", "ratio", "fixed"):
            raise ValueError(f"spike: {spike!r}")
        if not stdev and spike == "none":
            raise ValueError("neither stdev nor spike: there is nothing to compare")
        self.field, self.group_by = field_name, as_list(group_by)
        values = (stdev, stdev_borderline_threshold, stdev_outlier_threshold, spike, spike_inverse, spike_borderline_threshold, spike_outlier_threshold, label_for_normal)
        self.options = dict(zip(OPTIONS, values, strict=True))

    def fit(self, df: DataFrame, weight: str | None = None, base: GeneratorModel | None = None) -> NumericModel:
        new = NumericModel({"field": self.field, "group_by": self.group_by, "options": self.options}, {"stats": stats(df, self.field, self.group_by, weight)})
        return new if base is None else base.merge(new)


class NumericModel(GeneratorModel):
    kind = "NumericField"

    def __init__(self, params: dict, tables: dict[str, DataFrame]):
        self.params, self.tables = params, tables
        self.field, self.group_by, self.options = params["field"], params["group_by"], OPTIONS | params["options"]

    def merge(self, other: NumericModel) -> NumericModel:
        return NumericModel(other.params, {"stats": merged_stats(self.tables["stats"], other.tables["stats"], self.group_by)})

    def attach(self, df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        name, v = self.field.upper(), as_float(F.col(f"`{self.field}`"), field_type(df, self.field))
        if self.group_by:
            df = join_stats(df, self.tables["stats"], self.group_by, tag)
        else:  # one row
            df = df.crossJoin(F.broadcast(self.tables["stats"].select(*(F.col(c).alias(f"{tag}{c}") for c in ("mean", "std", "n")))))
        label = deviation_label(self.field, v, F.col(f"{tag}mean"), F.col(f"{tag}std"), self.options)
        if self.group_by:
            label = F.when(F.col(f"{tag}seen").isNull(), f"UNSEEN_KEY_FOR_{name}").when(F.col(f"{tag}n") <= RARE, f"RARE_KEY_FOR_{name}").otherwise(label)
        return df, result([F.when(v.isNull(), f"{name}_BAD_VALUE").otherwise(label)])

    def warnings(self) -> list[str]:
        """What makes labels of little use: a mean of 0 with ratios, a deviation of 0 with deviations."""
        s = self.tables["stats"]
        if self.options["stdev"]:
            return [f"{self.field}: the deviation is 0"] * (not s.filter("std = 0").isEmpty())
        return [f"{self.field}: the mean is 0"] * (not s.filter("mean = 0").isEmpty())

    def row(self, record: dict) -> tuple[list[str], list[float]]:
        name = self.field.upper()
        try:
            v = float(record[self.field])
        except (KeyError, TypeError, ValueError):
            return [f"{name}_BAD_VALUE"], []
        known = self._local("stats", lambda: {tuple(r[g] for g in self.group_by): (r.mean, r.std, r.n) for r in bounded(self.tables["stats"])})
        key = tuple(record.get(g) for g in self.group_by)
        if key not in known:
            return [f"UNSEEN_KEY_FOR_{name}"], []
        mean, std, n = known[key]
        if self.group_by and n <= RARE:
            return [f"RARE_KEY_FOR_{name}"], []
        if mean is None or std is None or math.isnan(mean):
            return [], []
        return deviation_label_row(self.field, v, mean, std, self.options), []
