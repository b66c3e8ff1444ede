"""Evaluation of detections: accuracy, confusions, paragraphs, samples of misses, throughput."""

from __future__ import annotations

import pickle
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import model as M
from .detect import UNKNOWN, Params

#: Pairs of languages so close that taking one for the other is expected.
KNOWN_CROSS = {"ms": "id", "af": "nl", "nn": "no"}
SHORTEST_PARAGRAPH = 20


def right():
    """expected and detected agree, all Chinese counting as one."""
    chinese = ["zh", "zh-hans", "zh-hant"]
    return (F.col("expected") == F.col("detected")) | (F.col("expected").isin(chinese) & F.col("detected").isin(chinese))


def accuracy(found: DataFrame) -> DataFrame:
    """expected (null: all), correct, total, skipped, pct. Unknown results are skipped and not in the total."""
    known = F.col("detected") != UNKNOWN
    out = found.rollup("expected").agg(F.count(F.when(known & right(), 1)).alias("correct"), F.count(F.when(known, 1)).alias("total"), F.count(F.when(~known, 1)).alias("skipped"))
    return out.withColumn("pct", F.round(F.when(F.col("total") > 0, 100.0 * F.col("correct") / F.col("total")).otherwise(0.0), 4))


def confusion(found: DataFrame) -> DataFrame:
    """expected, detected, n of all wrong results, unknown ones left out; known_cross if the languages are known to be close."""
    close = F.lit(False)
    for a, b in KNOWN_CROSS.items():
        close = close | ((F.col("expected") == a) & (F.col("detected") == b))
    return found.filter((F.col("detected") != UNKNOWN) & ~right()).groupBy("expected", "detected").agg(F.count("*").alias("n")).withColumn("known_cross", close)


def paragraphs(texts: DataFrame, keys: list[str], text_col: str = "text", shortest: int = SHORTEST_PARAGRAPH) -> DataFrame:
    """keys, par_no (from 0) and text of each paragraph that isn't too short; line breaks in a row part paragraphs."""
    out = texts.select(*[c for c in texts.columns if c != text_col], F.posexplode(F.split(F.col(text_col), "\n{2,}", -1)).alias("par_no", text_col))
    return out.filter(F.length(text_col) >= shortest)


def chunk_stats(found: DataFrame) -> DataFrame:
    """Per expected language: chunks, correct, misses, short misses (two words at most), skipped, average characters and words."""
    known = F.col("detected") != UNKNOWN
    miss = known & ~right()
    n = F.count(F.when(known, 1))
    return found.groupBy("expected").agg(
        F.count("*").alias("chunks"),
        F.count(F.when(known & right(), 1)).alias("correct"),
        F.count(F.when(miss, 1)).alias("misses"),
        F.count(F.when(miss & (F.col("num_words") <= 2), 1)).alias("short_misses"),
        F.count(F.when(~known, 1)).alias("skipped"),
        F.when(n > 0, F.floor(F.sum(F.when(known, F.col("num_chars"))) / n)).otherwise(0).alias("avg_chars"),
        F.floor(F.sum("num_words") / F.count("*")).alias("avg_words"),
    )


def sampled_misses(found: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """A repeatable sample of n misses: those of the smallest digest of their keys."""
    return found.filter((F.col("detected") != UNKNOWN) & ~right()).orderBy(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


def snippets(found: DataFrame, keys: list[str], text_col: str = "text", size: int = 80) -> DataFrame:
    return found.filter((F.col("detected") != UNKNOWN) & ~right()).select(*keys, "expected", "detected", T.snippet(F.col(text_col), size).alias("snippet"))


def throughput(found: DataFrame) -> dict:
    """Runs the detections and returns words, texts, seconds, words a second, nanoseconds a word."""
    began = time.perf_counter()
    texts, words = found.agg(F.count("*"), F.sum("num_words")).first()
    s = time.perf_counter() - began
    return {"texts": texts, "words": words or 0, "seconds": s, "words_per_s": (words or 0) / s, "ns_per_word": 1e9 * s / max(1, words or 0)}


def load_benchmark(spark: SparkSession, path: str, languages: str = "all", variant: str = "lite") -> dict:
    """Loads a stored model anew, to the tables in memory, and returns seconds, entries by table, and bytes as pickled for a worker."""
    M.clear_cache()
    began = time.perf_counter()
    model = M.load(spark, path, languages, variant)
    grams = dict(map(tuple, model.ngrams.groupBy("n").count().orderBy("n").collect()))
    tops = 0 if model.topwords is None else model.topwords.count()
    size = len(pickle.dumps(model.sent(Params()).value)) if model.fits else None
    return {"seconds": time.perf_counter() - began, "ngrams": grams, "topwords": tops, "entries": model.entries, "bytes": size, "readable": None if size is None else human(size)}


def human(n: int) -> str:
    """1536 -> 1.5K."""
    for power, unit in ((4, "T"), (3, "G"), (2, "M"), (1, "K")):
        if n >= 1024**power:
            return f"{n / 1024**power:.1f}{unit}"
    return f"{n}B"
