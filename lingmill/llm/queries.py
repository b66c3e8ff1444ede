"""One query for each operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, licenses, mixing, neighbours, pii, quality, secrets, sharding, tokens


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and spans. The ledger is a fresh one for each call; pass a path to scan_documents to keep it. Null texts have none."""
    return secrets.scan_documents(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, words and longest-match tokens of every document; a null text has none."""
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and decision for every document, by a model of the labelled ones; a null text counts as an empty one."""
    return quality.grade_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, and what its source should get; a null text has size 0, a null source is the last one."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles, component and number of links of every document; without words a document links with nothing."""
    return jaccard.join(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that every document is, and the notices in it; a null text has none."""
    return licenses.scan_documents(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, spans and the best score; a null text has none."""
    return pii.scan_documents(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law `rows`; a null text has one byte."""
    return sharding.shard(read(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every hundredth one, and the recall that the search was calibrated to; null, zero and non-finite vectors take no part."""
    return neighbours.search(read(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the benchmark that leaked into a document, with its score; null texts and items have no leak."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_counts, op3_quality, op4_source_mix, op5_jaccard_join, op6_license_scan, op7_pii, op8_sharding, op9_neighbours, op10_decontamination)}
ORACLES = {
    "op1_secret_scan": secrets.oracle(),
    "op2_token_counts": tokens.oracle(),
    "op4_source_mix": mixing.oracle(),
    "op5_jaccard_join": jaccard.oracle(),
    "op6_license_scan": licenses.oracle(),
    "op7_pii": pii.oracle(),
    "op8_sharding": sharding.oracle(),
}
