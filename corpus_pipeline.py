"""From documents to a sharded training mix: quality, near duplicates, benchmark leaks, source weights, shards.

Each stage gets the Spark session, the documents that the stage before it left, and the folder of the other tables; its result is
written as Parquet in the folder that all machines share and read again by the next. All but the last return the columns of
documents; the last also has the size, CRC, shard and slot of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingmill.llm import decontaminate, jaccard, mixing, quality, sharding
from lingmill.llm.common import table
from lingmill.llm.queries import read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go. A null text is judged like an empty one; repeated rows are judged alike and stay
    or go together; at p = 1/2 a document stays; without a usable label all stay; an empty table gives an empty one."""
    return quality.grade_documents(docs, read(spark, sf_dir, "labels"), carry=True)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id, null last, and of rows with that id the one of
    the smallest hash of its text and then of all its columns. Texts that are null or without words have no duplicates, but of
    wholly equal rows one stays; an empty table gives an empty one."""
    return jaccard.distinct_rows(docs)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, exactly or edited, go, each repeated row with them; null texts and items hold none; without
    items all documents stay; an empty table gives an empty one."""
    return decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, once or twice. A null source is one of its own; texts that are null
    or without words are taken once; rows equal in source, id and text are taken as often as each other; an empty table gives an empty one."""
    return mixing.mixed_rows(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there; null ids are numbered first, repeated rows get a slot each, a null text has one byte;
    a column that documents have already is not added; an empty table gives an empty one."""
    rows = sharding.shard(docs, carry=True)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    new = [c for c in ("size", "text_crc32", "law", "shard", "slot") if c not in docs.columns]
    return rows.select(*own, *new)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", duplicates_stage),
    ("benchmark decontamination", leaks_stage),
    ("mixing sources to target weights", mix_stage),
    ("sharding", shard_stage),
]

#: SQL can express neither the fitted classifier nor the rounding of the mix; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"stage{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
