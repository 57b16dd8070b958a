"""The queries of this subpackage by name: each applies its operator to the whole table. ORACLES has DuckDB SQL for those
that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm import bpe, exact_dedup, fingerprint, idfile, jaccard, language, line_dedup, packing, pii, quality


def vocabulary() -> str:
    """The tokenizer file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ids = bpe.encode(docs, vocabulary()).select("doc_id", "n_tokens", "ids")
    both = bpe.decode(ids, vocabulary())
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs)).drop("text")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op4_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = idfile.write_ids(documents(spark, sf_dir), vocabulary())
    return idfile.read_ids(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


#: Of the queries; a real run sets its own, from where secrets are kept, as KEY_SETTING.
PII_KEY, KEY_SETTING = "queries", "spark.tagsmith.pii.key"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING) or PII_KEY


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(documents(spark, sf_dir).select("doc_id", "text"), pii_key(spark))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents),
keyed AS (
  SELECT doc_id, k, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT doc_id, k, line, first_doc IS NOT NULL AND first_doc <> doc_id AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")
    return groups.withColumn("text_sha256", F.lower(F.hex("text_sha256")))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_quality, op3_language, op4_id_files, op5_packing, op6_fingerprints, op7_pii, op8_line_dedup, op9_jaccard_join, op10_exact_dedup)}
ORACLES: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op10_exact_dedup": OP10_SQL}
