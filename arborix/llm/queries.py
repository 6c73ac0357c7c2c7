"""Queries of the training-data problems and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import Stages, read
from . import handwritten, mixing, syntax, tokens, topn, truncation


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(read(spark, d, "source_files")).select("file_id")


def p1_origins(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify(read(spark, d, "source_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(read(spark, d, "source_files")).select("file_id")


def p4_faults(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(read(spark, d, "source_files"))


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    return syntax.errors(read(spark, d, "source_files"))


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    return syntax.languages(read(spark, d, "source_files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(read(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_context(read(spark, d, "context_entries"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(tokens.encode(read(spark, d, "documents")))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "mix_targets")
    drawn = Stages(spark, "p8").put(mixing.mix(read(spark, d, "documents"), targets))
    return mixing.shares(drawn, targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(read(spark, d, "documents")).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(read(spark, d, "documents"))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.length_limits(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_origins, p4_found, p4_faults, p4_errors, p4_rates, p4_languages, p5_found, p7_ids, p7_decoded, p8_mix, p8_shares, p9_found, p9_rates, p9_limits)}

SQL = {
    "p5_found": """WITH one AS (
  SELECT seed, section, is_test, file, line, function, coalesce(heat, 0) AS heat, entry_id FROM context_entries
  QUALIFY row_number() OVER (PARTITION BY seed, section, is_test, file, line, function ORDER BY coalesce(heat, 0) DESC, entry_id) = 1)
SELECT seed, section, entry_id, row_number() OVER (PARTITION BY seed, section, is_test
  ORDER BY heat DESC, file NULLS FIRST, line NULLS FIRST, function NULLS FIRST, entry_id) AS rnk FROM one QUALIFY rnk <= 5""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict:
    return dict(SQL)
