"""Chinese and Japanese: share of kana first, then single characters and pairs of them.

A text with more than about one percent of kana among its Han and kana characters is Japanese; else the language whose single
characters and adjacent pairs have the best mean logarithm wins, with a floor for what it doesn't know. A text of which
nothing is known stays undecided. This design is our own. detect() does the same for the texts in which these scripts
weigh most, if the model has a table of them; classify() is for texts by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as T
from .scoring import CJ_FLOOR_U as FLOOR_U
from .scoring import KANA_SHARE
from .train import log_u


def grams(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, n, gram for n 1 and 2 over runs of one of the scripts, which are cut after each 256 characters."""
    scripts = "|".join(f"[{T.letters(a)}]{{1,{T.LONGEST_CJ}}}" for a in catalog.CJ_ALPHABETS)
    run = texts.select(*keys, F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(scripts), F.lit(0))).alias("run"))
    each = run.select(*keys, "run", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).filter(F.length("run") >= F.col("n"))
    return each.select(*keys, "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("n") + 1), lambda i: F.col("run").substr(i, F.col("n")))).alias("gram"))


def train(texts: DataFrame) -> DataFrame:
    """lang, n, gram, logprob_u of texts(text, lang)."""
    counts = grams(texts, ["lang"]).groupBy("lang", "n", "gram").agg(F.count("*").alias("cnt"))
    totals = counts.groupBy("lang", "n").agg(F.sum("cnt").alias("total"))
    return counts.join(F.broadcast(totals), ["lang", "n"]).select("lang", "n", "gram", log_u(F.col("cnt"), F.col("total")).alias("logprob_u"))


def classify(texts: DataFrame, model: DataFrame, languages: list[str], keys: list[str], kana_share: float = KANA_SHARE) -> DataFrame:
    """keys, detected, kana, cj_chars of texts that have Han or kana characters; ties go to the first of languages. model: lang, n, gram, logprob_u."""
    by_gram = F.map_from_entries(F.collect_list(F.struct("lang", F.greatest("logprob_u", F.lit(FLOOR_U)))))  # an entry a language
    table = model.filter(F.col("lang").isin(languages)).groupBy("n", "gram").agg(by_gram.alias("us"))
    found = grams(texts, keys).groupBy(*keys, "n", "gram").agg(F.count("*").alias("cnt")).join(table, ["n", "gram"], "left")
    kana = (F.col("n") == 1) & F.col("gram").rlike(f"[{T.letters('JA_KANA')}]")
    score = lambda x: F.sum(F.coalesce(F.try_element_at("us", F.lit(x)), F.lit(FLOOR_U)) * F.col("cnt")).alias(f"u_{x}")
    sums = found.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(kana, F.col("cnt"))), F.lit(0)).alias("kana"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("cnt"))), F.lit(0)).alias("cj_chars"),
        F.count("us").alias("_known"),
        *map(score, languages),
    )
    best = F.array_max(F.array(*[F.struct(F.col(f"u_{x}").alias("u"), F.lit(-i).alias("o"), F.lit(x).alias("lang")) for i, x in enumerate(languages)]))
    japanese = (F.col("kana") > kana_share * F.col("cj_chars")) & F.lit("ja" in languages)
    detected = F.when(japanese, "ja").when(F.col("_known") == 0, catalog.UNKNOWN).otherwise(best["lang"])
    return sums.select(*keys, detected.alias("detected"), "kana", "cj_chars")
