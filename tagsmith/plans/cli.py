"""python -m tagsmith.plans.cli autoconfig|train|run|rules ..., or --version."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tagsmith import __version__
from tagsmith.plans import autoconfig
from tagsmith.plans.config import PipelineConfig
from tagsmith.plans.pipeline import LabelPipeline, PipelineModel
from tagsmith.plans.rules import apply_rules, load_rules
from tagsmith.sources.readers import read_csv, source
from tagsmith.sources.sinks import post, write_bulk, write_csv, write_json
from tagsmith.sources.store import write_text


def _read(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rstrip("/").rpartition(".")[2]
    return source(spark, kind, path=path) if kind in ("parquet", "json", "orc") else read_csv(spark, path)


def _write(df: DataFrame, a: argparse.Namespace, model: str) -> None:
    if a.output_file:
        (write_json(df, a.output_file, model) if a.output_file.endswith(".json") else write_csv(df, a.output_file))
    if a.bulk_url:
        write_bulk(df, model, post(a.bulk_url))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tagsmith")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    own = {name: sub.add_parser(name) for name in ("autoconfig", "train", "run", "rules")}
    for s in own.values():
        s.add_argument("--input-file", required=True)
    own["autoconfig"].add_argument("--output-file", required=True)
    own["autoconfig"].add_argument("--count-column")
    for name in ("train", "run"):
        own[name].add_argument("--conf-file", required=name == "train")
        own[name].add_argument("--model-file", required=True)
    own["train"].add_argument("--incremental", action="store_true")
    own["train"].add_argument("--orig-model-file")
    own["rules"].add_argument("--rules-folder", required=True)
    for name in ("run", "rules"):
        own[name].add_argument("--output-file")
        own[name].add_argument("--bulk-url")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = parser()
    a = p.parse_args(arguments)
    if a.command == "train" and a.incremental != bool(a.orig_model_file):
        p.error("--incremental and --orig-model-file go together")
    if a.command in ("run", "rules") and not (a.output_file or a.bulk_url):
        p.error("there is no output: give --output-file or --bulk-url")
    spark = spark or SparkSession.builder.appName("tagsmith").getOrCreate()
    df = _read(spark, a.input_file)
    if a.command == "autoconfig":
        write_text(spark, a.output_file, autoconfig.suggest(df, a.count_column).to_string(autoconfig.HEADER))
    elif a.command == "train":
        base = PipelineModel.load(spark, a.orig_model_file) if a.incremental else None
        LabelPipeline(PipelineConfig.from_file(a.conf_file)).fit(df, base).save(spark, a.model_file)
    elif a.command == "run":
        model = PipelineModel.load(spark, a.model_file)
        if a.conf_file:
            model = model.configured(PipelineConfig.from_file(a.conf_file))
        _write(model.transform(df), a, model.scoring.kind)
    else:
        _write(apply_rules(df, load_rules(a.rules_folder)), a, "rules")


if __name__ == "__main__":
    main()
