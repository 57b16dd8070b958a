"""documents to training sequences: STAGES names the stages, run() applies them.

quality    documents that the classifier rejects go; it is fitted on the stage's own input
lines      lines that an earlier document has go
near       of near-duplicates, one document stays: the smallest doc_id
pii        personal data is replaced
packing    pieces of sequences of 1024 tokens: the last result

A stage that alters texts sets n_chars anew, if there is such a column. A document may become empty, and then stays as
such; a null text goes in the first stage. Only doc_id and text must be there; all other columns go through up to the last
stage, but one named n_lines, n_dropped or n_entities is replaced on its way. Rows that
share a doc_id are one document, and stay or go together; rows without one stay in all stages that drop by it. Of ties
the smallest doc_id stays. An empty table gives an
empty result. Personal data gets surrogates by the key that the setting spark.tagsmith.pii.key names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm import jaccard, line_dedup, packing, pii, quality
from tagsmith.llm.common import fresh_dir
from tagsmith.llm.queries import pii_key, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars of the new texts, if there is one."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(docs, line_dedup.dedup_lines(docs))


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_duplicates(docs)


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(docs, pii.replace_pii(docs, pii_key(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [("quality classifier", good), ("line dedup", fresh_lines), ("n-gram Jaccard join", distinct_enough), ("PII", anonymous), ("packing", packed)]
#: Fitted models and keyed surrogates have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each result is written as Parquet and read again."""
    docs, where = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(at := f"{where}/{k}-{name.replace(' ', '_')}")
        docs = spark.read.parquet(at)
    return docs
