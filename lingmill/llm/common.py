"""What the operators share: written intermediate tables, global row numbers, joins with small tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new one of our own in local mode,
    in which there is one machine; on a cluster a folder of one machine would lose rows in silence, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lingmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lingmill-{uuid.uuid4().hex}/{name}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: a lost executor costs no recomputation of what led to it."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What is run inside passes rows to Python in batches of this many: a worker holds less at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `bound` rows; else as it is, for a shuffled join that AQE may split."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= bound else df


def numbered(df: DataFrame, order: list, name: str = "row_no") -> tuple[DataFrame, int]:
    """df with a global row number from 0 in the given order, and the number of rows.

    Rows are dealt by range, sorted and numbered in each partition; the number of rows of each partition (one row a
    partition) gives the offsets. No partition has to hold more than its range, and rows that are equal in `order` are
    told apart by a hash of the whole row and then by where they were read.
    """
    spark = df.sparkSession
    held = df.withColumns({"_tie": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.lit(0), "_at": F.monotonically_increasing_id()})
    keys = [*order, F.col("_tie"), F.col("_at")]
    dealt = held.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", "_at")
    dealt = dealt.withColumns({"_pid": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = table(dealt, "numbered")
    counts = dealt.groupBy("_pid").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_pid", before.alias("_start"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return dealt.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_start") + F.col("_i")).drop("_pid", "_i", "_start"), total


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table() that nothing needs any more, and let Spark drop the shuffle files of what is done."""
    jvm = df.sparkSession.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent().getParent()
        if folder.getName().startswith("lingmill-"):
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    jvm.System.gc()
