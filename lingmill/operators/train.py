"""Training: labelled texts -> n-gram counts, topword counts, and the model tables made of them."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as T
from . import scoring

MAX_NGRAM = 5
#: Distinct pieces that a worker counts before it hands on what it has.
MOST_PIECES = 100_000


def training_words(texts: DataFrame, alphabets: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", skipwords: DataFrame | None = None) -> DataFrame:
    """lang, word, cnt of texts, in the script of each language. Words with a digit or with more than one inner apostrophe and those of
    skipwords(word) are left out; no word is cut.

    alphabets: only these scripts, default all but Chinese and Japanese ones, which cj.train is for. A language that is not
    in the catalogue is taken for a Latin one. Texts are split and counted where they are read (Tally); only words and counts are shuffled.
    """
    wanted = tuple(a for a in catalog.ALPHABETS if (a in alphabets if alphabets else a not in catalog.CJ_ALPHABETS))

    def run(batches):
        tally = Tally(wanted)
        for b in scoring.sliced(batches):
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tally.add(lang, text)
            if tally.full:
                yield tally.taken()
        yield tally.taken()

    rows = texts.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = rows.mapInArrow(run, "lang string, word string, cnt long").groupBy("lang", "word").agg(F.sum("cnt").alias("cnt"))
    return words if skipwords is None else words.join(F.broadcast(skipwords.select("word").distinct()), "word", "left_anti").select("lang", "word", "cnt")


class Tally:
    """Counts the pieces of texts by language; a piece is made a word once each time that the counts are taken."""

    def __init__(self, alphabets: tuple[str, ...]):
        self.alphabets, self.counts, self.found = alphabets, {}, {}
        self.odd, self.digit = re.compile(rf"[\d{T.APOSTROPHES}]"), re.compile(r"\d")

    def alphabet(self, lang: str) -> str | None:
        own = [a for a in self.alphabets if a != "LATIN" and lang in catalog.for_alphabet(a)]
        if own:
            return own[-1]
        return "LATIN" if "LATIN" in self.alphabets and (lang not in catalog.BY_ISO or lang in catalog.for_alphabet("LATIN")) else None

    def finders(self, lang: str) -> tuple | None:
        """What finds the pieces of a text without digits and apostrophes, and of any."""
        a = self.alphabet(lang)
        return a and (re.compile(f"[{scoring.letters(a)}]+").findall, re.compile(scoring.piece_pattern([a], r"\d")).findall)

    def add(self, lang: str, text: str) -> None:
        if lang not in self.found:
            self.found[lang], self.counts[lang] = self.finders(lang), Counter()
        if self.found[lang]:
            plain, any_ = self.found[lang]
            self.counts[lang].update(any_(text) if self.odd.search(text) else plain(text))

    @property
    def full(self) -> bool:
        return sum(map(len, self.counts.values())) > MOST_PIECES

    def taken(self) -> pa.RecordBatch:
        """lang, word, cnt of what was counted; counting starts anew."""
        langs, words, counts = [], [], []
        for lang, pieces in self.counts.items():
            total: dict[str, int] = {}
            for piece, n in pieces.items():
                word = piece.replace("İ", "i").lower()
                if not piece.isalpha():
                    if self.digit.search(piece):
                        continue
                    for c in T.APOSTROPHES:
                        word = word.replace(c, "'")
                    word = word.removesuffix("'")
                    if word.count("'") > 1:
                        continue
                total[word] = total.get(word, 0) + n
            langs += [lang] * len(total)
            words += total
            counts += total.values()
            pieces.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "cnt"])


def log_u(cnt, total):
    """Natural logarithm of a share in whole millionths: sums of these don't depend on their order."""
    return F.round(F.log(cnt / total) * 1e6).cast("long")


def ngram_counts(words: DataFrame, max_ngram: int = MAX_NGRAM) -> DataFrame:
    """lang, n, gram, cnt over words shorter than 64: a row for each length and position, which codegen cuts out of the word."""
    size = F.length("word")
    each = words.filter(size < T.LONGEST).select("lang", "cnt", "word", size.alias("l"), F.explode(F.sequence(F.lit(0), size * max_ngram - 1)).alias("k"))
    at = each.select("lang", "cnt", "word", "l", F.expr("cast(k div l + 1 as int)").alias("n"), F.expr("k % l + 1").alias("i")).filter("i + n - 1 <= l")
    return at.groupBy("lang", "n", F.expr("substring(word, i, n)").alias("gram")).agg(F.sum("cnt").alias("cnt"))


def with_totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("cnt").alias("total"))
    return counts.join(F.broadcast(totals), keys)  # a row for each language and n


def least_count(floor: float):
    """The least count of an n-gram of which there are `total` in all, for its share to be at or above a floor."""
    return F.greatest(F.lit(1), F.ceil(F.col("total") * F.exp(F.lit(float(floor)))))


def ngram_model(counts: DataFrame, floor: float | None = None) -> DataFrame:
    """lang, n, gram, cnt, total, logprob_u of the n-grams at or above the floor; totals are those of all."""
    out = with_totals(counts, ["lang", "n"]).withColumn("logprob_u", log_u(F.col("cnt"), F.col("total")))
    return out if floor is None else out.filter(F.col("cnt") >= least_count(floor))


def reduced(model: DataFrame, floor: float, max_ngram: int = MAX_NGRAM) -> DataFrame:
    """The model without rare n-grams, single ASCII characters, and n-grams longer than max_ngram."""
    plain = (F.col("n") == 1) & (F.ascii("gram") < 128)
    return model.filter((F.col("cnt") >= least_count(floor)) & ~plain & (F.col("n") <= max_ngram))


def reduced_topwords(topwords: DataFrame, floor: float) -> DataFrame:
    """The topwords at or above a floor."""
    return topwords.filter(F.col("logprob_u") >= round(floor * 1e6))


def topword_model(words: DataFrame, floor: float | None = None) -> DataFrame:
    """lang, word, cnt, total, logprob_u. A word with an inner apostrophe counts as its two parts; the total counts whole words."""
    at = F.locate("'", F.col("word"))
    parts = F.when(at > 0, F.array(F.substring("word", F.lit(1), at), F.expr("substring(word, locate(\"'\", word) + 1)"))).otherwise(F.array("word"))
    totals = words.groupBy("lang").agg(F.sum("cnt").alias("total"))
    counts = words.select("lang", "cnt", F.explode(parts).alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.sum("cnt").alias("cnt"))
    out = counts.join(F.broadcast(totals), "lang").withColumn("logprob_u", log_u(F.col("cnt"), F.col("total"))).filter(eligible(F.col("word")))
    return out if floor is None else reduced_topwords(out, floor)


def eligible(word):
    """Topwords are longer than one character, or not ASCII."""
    return (F.length(word) > 1) | (F.ascii(word) >= 128)


def table_stats(model: DataFrame) -> DataFrame:
    return model.groupBy("lang", "n").agg(F.count("*").alias("distinct_grams"), F.first("total").alias("total"), F.min("logprob_u").alias("min_logprob_u"))


def topword_overlap(topwords: DataFrame) -> DataFrame:
    """Words that several languages have: word, languages by falling log-probability, number of languages, best log-probability."""
    entry = F.struct((-F.col("logprob_u")).alias("o"), F.col("lang").alias("l"))
    return topwords.groupBy("word").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.count("*").alias("n_langs"), F.max("logprob_u").alias("best_u")).filter("n_langs > 1").select("word", F.array_join(F.transform("e", lambda x: x["l"]), ",").alias("langs"), "n_langs", "best_u")


def skipwords_of(topwords: DataFrame, first: int) -> DataFrame:
    """The `first` most frequent topwords of each language, as words to skip."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cnt"), "word"))
    return topwords.withColumn("r", rank).filter(F.col("r") <= first).select("word").distinct()
