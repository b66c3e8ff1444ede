"""Detection: words of texts are scored against a model's tables, and what they say is added up and decided.

Two ways lead to the same arrays of evidence (scoring.Layout). A model that fits is sent to every worker, and texts are scored where they
are read: no exchange, whatever the number of texts (scoring). A larger one is joined: each distinct word of the table is scored
once and has one row, with a sparse array of all that it says; words of texts are joined to these, and one exchange by text adds up.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as T
from . import scoring, train
from .model import Model
from .scoring import Layout

UNKNOWN = catalog.UNKNOWN


@dataclass(frozen=True)
class Params:
    """min_ngram <= stop (no shorter n-grams once all of this length or longer are found) <= max_ngram; topwords on or off."""

    min_ngram: int = 1
    stop: int = 3
    max_ngram: int = 5
    topwords: bool = True

    def valid(self, model_max: int) -> bool:
        return 1 <= self.min_ngram <= self.stop <= self.max_ngram <= model_max

    def changed(self, model_max: int, **how) -> tuple[Params, bool]:
        """With these values, and true; as they are, and false, if the values don't fit a model of n-grams up to model_max."""
        new = replace(self, **how)
        return (new, True) if new.valid(model_max) else (self, False)


#: A lookup table with at most so many entries is broadcast to the joins; others are shuffled.
BROADCAST_ENTRIES = 1_000_000
#: Probes of a word other than its n-grams: the word, its two parts at an apostrophe, and one that finds nothing, so that each word has a row.
WHOLE, PREFIX, SUFFIX, MARK = 0, -1, -2, -9


def words_of(texts: DataFrame, model: Model, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, script, word, cnt."""
    piece = texts.select(*keys, F.explode(T.chunks(F.col(text_col), model.alphabets)).alias("c")).groupBy(*keys, "c").agg(F.count("*").alias("cnt"))
    piece = piece.withColumn("script", T.script_of(F.col("c"), model.alphabets))
    if set(model.alphabets) & set(catalog.CJ_ALPHABETS):
        words = piece.select(*keys, "script", F.explode(T.detection_words(F.col("c"), F.col("script"))).alias("word"), "cnt")
    else:
        words = piece.filter((F.col("script") != "LATIN") | ~F.col("c").rlike("[0-9]")).select(*keys, "script", T.plain_word(F.col("c")).alias("word"), "cnt")
    return words.groupBy(*keys, "script", "word").agg(F.sum("cnt").alias("cnt"))


def _probes(model: Model, params: Params, tops: DataFrame | None, single) -> tuple:
    """What is looked up for a word, as array<struct<n, gram>>, and whether the word itself and both parts of it are."""
    word, size = F.col("word"), F.length("word")
    probe = lambda n, gram: F.struct(F.lit(n).cast("int").alias("n"), gram.alias("gram"))
    none = F.array().cast("array<struct<n:int,gram:string>>")
    lengths = F.sequence(F.lit(params.min_ngram), F.least(F.lit(params.max_ngram), size))
    tiles = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.struct(n.cast("int").alias("n"), word.substr(i, n).alias("gram")))))
    all_ = [F.array(probe(MARK, F.lit(""))), F.when(~single & (size >= params.min_ngram), tiles).otherwise(none)]
    if tops is None:
        return F.concat(*all_), F.lit(False), F.lit(False)
    at, suffix = T.mid_apostrophe(word), F.expr("substring(word, locate(\"'\", word, 2) + 1)")
    tried = train.eligible(word) & ~single
    parted = tried & (size > 2) & (at > 0)
    both = parted & (F.length(suffix) > 1)
    all_.append(F.when(tried, F.array(probe(WHOLE, word))).otherwise(none))
    all_.append(F.when(parted, F.array(probe(PREFIX, F.substring("word", F.lit(1), at)))).otherwise(none))
    all_.append(F.when(both, F.array(probe(SUFFIX, suffix))).otherwise(none))
    return F.concat(*all_), tried, both


def _table(model: Model, table: DataFrame) -> DataFrame:
    return F.broadcast(table) if model.entries <= BROADCAST_ENTRIES else table


def _scored(words: DataFrame, model: Model, params: Params) -> DataFrame:
    """script, word, lang, ng_u, ng_hits, tw_u, tw_hits, lookups for the distinct words: a row for each language that has evidence,
    and one without a language for every word that counts. Skipwords don't, unless their script has one language only.

    All that is looked up for a word goes through one join. If the tables are small enough to be broadcast, the words keep
    the partitions that making them distinct gave them, and nothing is shuffled again.
    """
    tops = model.topwords if params.topwords else None
    alone = [a for a, one in zip(model.alphabets, model.facts.single, strict=True) if one >= 0 or (model.has_cj and a in catalog.CJ_ALPHABETS)]
    single = F.col("script").isin(alone or [""])
    counted = words.select("script", "word").distinct()
    if tops is not None:
        skips = F.broadcast(model.skipwords.withColumn("_skip", F.lit(True)))
        counted = counted.join(skips, "word", "left").filter(single | F.col("_skip").isNull())
    asked, tried, both = _probes(model, params, tops, single)
    table = model.ngrams.select(F.col("n").cast("int").alias("_k"), "gram", "langs")
    if tops is not None:
        table = table.union(tops.select(F.lit(WHOLE).alias("_k"), "word", "langs"))
    each = counted.select("script", "word", F.explode(asked).alias("p")).select("script", "word", "p.n", "p.gram", F.greatest("p.n", F.lit(WHOLE)).alias("_k"))
    hits = each.join(_table(model, table), ["_k", "gram"], "left").select("script", "word", "n", F.explode_outer("langs").alias("l"))
    kinds = [WHOLE, PREFIX, SUFFIX, *range(params.min_ngram, params.max_ngram + 1)]
    u, h = (lambda k: F.col(f"u{k}"), lambda k: F.col(f"h{k}"))
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(F.when(F.col("n") == k, F.col("l.u"))), zero).alias(f"u{k}") for k in kinds] + [F.count(F.when(F.col("n") == k, 1)).alias(f"h{k}") for k in kinds]
    rows = hits.groupBy("script", "word", "l.lang").agg(*sums)
    # a word's languages are few: they are gathered in its row, and what holds for the word is told to all of them there
    lacks = [F.coalesce(F.max(F.when(F.col("lang").isNull(), h(k))), zero).alias(f"m{k}") for k in kinds if WHOLE <= k <= params.stop]
    rows = rows.groupBy("script", "word").agg(F.collect_list(F.struct("lang", *[f"u{k}" for k in kinds], *[f"h{k}" for k in kinds])).alias("_l"), *lacks)
    covered = [F.when((F.col(f"m{k}") == 0) & (F.length("word") >= k), k) for k in range(params.min_ngram, params.stop + 1)]
    hit = tried & (F.col(f"m{WHOLE}") == 0)
    rows = rows.withColumns({"_from": F.coalesce(*reversed(covered), F.lit(params.min_ngram)), "_hit": hit}).select("script", "word", "_from", "_hit", F.explode("_l").alias("l")).select("script", "word", "_from", "_hit", "l.*")
    over = lambda col: sum((F.when(F.col("_from") <= k, col(k)).otherwise(zero) for k in kinds if k > WHOLE), zero)
    top = lambda col: F.when(F.col("_hit"), col(WHOLE)).otherwise(col(PREFIX) + col(SUFFIX))
    lookups = (tried.cast("long") + (both & ~F.col("_hit")).cast("long")).alias("lookups")
    out = rows.select("script", "word", "lang", over(u).alias("ng_u"), over(h).alias("ng_hits"), top(u).alias("tw_u"), top(h).alias("tw_hits"), lookups)
    return out.filter(F.col("lang").isNull() | (F.col("ng_hits") > 0) | (F.col("tw_hits") > 0))


def score_words(words: DataFrame, model: Model, params: Params | None = None) -> tuple[DataFrame, DataFrame]:
    """For the distinct words (script, word): a row for each language that has evidence (ng_u, ng_hits, tw_u, tw_hits), and
    a row a word that counts (script, word, lookups)."""
    rows = _scored(words, model, params or Params())
    return rows.filter("lang IS NOT NULL").drop("lookups"), rows.filter("lang IS NULL").select("script", "word", "lookups")


def _place(values: list[str], column: str):
    """The number of a value in a fixed list."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) - 1


def _said(words: DataFrame, model: Model, params: Params) -> DataFrame:
    """script, word, ev: for each distinct word that counts, what it says as (place in the array of evidence, value) pairs."""
    at, script = Layout(model.facts), _place(model.alphabets, "script")
    item = lambda place, value: F.struct(place.cast("int").alias("at"), value.cast("long").alias("v"))
    lang = _place(model.languages, "lang")
    by_lang = [item(lang + getattr(at, c).start, F.col(c)) for c in ("ng_u", "ng_hits", "tw_u", "tw_hits")]
    by_script = [item(script + at.chars.start, F.length("word")), item(script + at.words.start, F.lit(1)), item(script + at.lookups.start, F.col("lookups"))]
    rows = _scored(words, model, params).select("script", "word", F.when(F.col("lang").isNull(), F.array(*by_script)).otherwise(F.array(*by_lang)).alias("e"))
    if model.has_cj:
        own = words.filter(F.col("script").isin(*catalog.CJ_ALPHABETS)).select("script", "word").distinct()
        size = F.length("word")
        runs = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda n: size >= n), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.struct(n.alias("n"), F.col("word").substr(i, n).alias("gram"))))
        tiles = F.flatten(runs)
        cj = own.select("script", "word", F.explode(tiles).alias("p")).select("script", "word", "p.*").join(_table(model, model.cj), ["n", "gram"]).select("script", "word", "n", F.explode("langs").alias("l"))
        c, one = _place([model.languages[i] for i in model.facts.cj], "lang"), F.col("n") == 1
        cj = cj.groupBy("script", "word", "n", F.col("l.lang").alias("lang")).agg(F.sum("l.u").alias("u"), F.count("*").alias("h"))
        cj = cj.select("script", "word", F.array(item(c + F.when(one, at.uni_u.start).otherwise(at.bi_u.start), F.col("u")), item(c + F.when(one, at.uni_hits.start).otherwise(at.bi_hits.start), F.col("h"))).alias("e"))
        rows = rows.union(cj).union(own.select("script", "word", F.array(item(F.lit(at.grams.start), size), item(F.lit(at.grams.start + 1), size - 1))))
    return rows.groupBy("script", "word").agg(F.flatten(F.collect_list("e")).alias("e"))  # at most a few entries for each language


def joined(texts: DataFrame, model: Model, keys: list[str], params: Params, text_col: str = "text") -> DataFrame:
    """keys, ev of the texts that have words, for a model of any size."""
    words = words_of(texts, model, keys, text_col)
    every = words.join(_said(words, model, params), ["script", "word"]).select(*keys, "cnt", F.explode("e").alias("e"))
    return _arrays(every.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum(F.col("e.v") * F.col("cnt")).alias("v")), keys, Layout(model.facts).width)


def _arrays(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, ev from rows(keys, at, v), which are at most `width` a key."""
    held = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("ev"))


def _fields(df: DataFrame, columns: list[str], more: str) -> str:
    return ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns] + [more])


def evidence(texts: DataFrame, model: Model, keys: list[str], params: Params | None = None, text_col: str = "text") -> DataFrame:
    """keys, ev of each text that has words; texts with the same keys have a row each if the model fits, else one for all."""
    params = params or Params()
    if not model.fits:
        return joined(texts, model, keys, params, text_col)
    shared, at = model.sent(params), Layout(model.facts)

    def run(batches):
        pieces = scoring.pieces_of(shared)
        for b in scoring.sliced(batches):
            ev = pieces.sums(b.column(b.num_columns - 1).to_pylist())
            some = pa.array(ev[:, at.words].sum(axis=1) > 0)
            out = pa.RecordBatch.from_arrays([*b.columns[:-1], scoring.lists(ev)], names=[*keys, "ev"])
            yield out.filter(some)

    rows = texts.select(*keys, F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, _fields(rows, keys, "ev array<long>"))


def added(ev: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """The evidence of parts, added up to that of their keys."""
    width = Layout(model.facts).width
    if width <= 64:
        return ev.groupBy(*keys).agg(F.array(*[F.sum(F.col("ev")[i]) for i in range(width)]).alias("ev"))
    rows = ev.select(*keys, F.posexplode("ev").alias("at", "v")).filter("v <> 0").groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    return _arrays(rows, keys, width)


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("gap", F.round("gap", 6))


def decide(ev: DataFrame, model: Model, keys: list[str], boosts: dict[str, float] | None = None) -> DataFrame:
    """keys, detected, gap, num_words, num_chars, num_lookups, pred of rows(keys, ev)."""
    facts, width = model.facts, Layout(model.facts).width

    def run(batches):
        for b in batches:
            found = scoring.decided(scoring.unlisted(b.column(b.num_columns - 1), width), facts, boosts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *scoring.arrays(found)], names=[*keys, *found])

    return _rounded(ev.select(*keys, "ev").mapInArrow(run, _fields(ev, keys, scoring.RESULT)))


def complete(texts: DataFrame, found: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """found for all texts: those without words are unknown with gap 1."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("num_words", "num_chars", "num_lookups")}
    fill = zero | {"detected": F.coalesce("detected", F.lit(UNKNOWN)), "gap": F.coalesce("gap", F.lit(1.0)), "pred": F.coalesce("pred", F.lit("UNKNOWN"))}
    return texts.select(*keys, *(keep or [])).join(found, keys, "left").withColumns(fill)


def _check(params: Params, model: Model) -> None:
    if not params.valid(model.max_ngram):
        raise ValueError(f"{params} doesn't fit a model of n-grams up to {model.max_ngram}")


def detect(texts: DataFrame, model: Model, keys: list[str], params: Params | None = None, boosts: dict[str, float] | None = None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """A row for each text: keys, kept columns, detected, gap, num_words, num_chars, num_lookups, pred. A model that doesn't fit
    needs keys that tell texts apart."""
    params = params or Params()
    _check(params, model)
    if not model.fits:
        return complete(texts, decide(joined(texts, model, keys, params, text_col), model, keys, boosts), keys, keep)
    shared, facts, columns = model.sent(params), model.facts, [*keys, *(keep or [])]

    def run(batches):
        pieces = scoring.pieces_of(shared)
        for b in scoring.sliced(batches):
            found = scoring.decided(pieces.sums(b.column(b.num_columns - 1).to_pylist()), facts, boosts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *scoring.arrays(found)], names=[*columns, *found])

    rows = texts.select(*columns, F.col(text_col).cast("string").alias("_text"))
    return _rounded(rows.mapInArrow(run, _fields(rows, columns, scoring.RESULT)))


def detect_scores(texts: DataFrame, model: Model, keys: list[str], params: Params | None = None, boosts: dict[str, float] | None = None, text_col: str = "text") -> DataFrame:
    """A row for each text with words and language: total, and the n-gram and topword evidence."""
    params = params or Params()
    _check(params, model)
    facts, at = model.facts, Layout(model.facts)
    ev = evidence(texts, model, keys, params, text_col)

    def run(batches):
        for b in batches:
            total = scoring.totals(scoring.unlisted(b.column(b.num_columns - 1), at.width), facts, boosts)
            yield pa.RecordBatch.from_arrays([*b.columns, scoring.lists(total)], names=[*keys, "ev", "total"])

    rows = ev.select(*keys, "ev").mapInArrow(run, _fields(ev, keys, "ev array<long>, total array<double>"))
    lookups = sum((F.col("ev")[i] for i in range(at.lookups.start, at.lookups.stop)), F.lit(0))
    own = lambda i, c: F.col("ev")[getattr(at, c).start + i].alias(c)
    each = F.array(*[F.struct(F.lit(x).alias("lang"), F.round(F.col("total")[i], 6).alias("total"), *[own(i, c) for c in ("ng_u", "ng_hits", "tw_u", "tw_hits")]) for i, x in enumerate(facts.languages)])
    return rows.select(*keys, F.explode(each).alias("s"), lookups.alias("num_lookups")).select(*keys, "s.*", "num_lookups")


def score_string(scores: DataFrame, keys: list[str]) -> DataFrame:
    """All scores of a text in one string, best first; and the best one's share of each other, short."""
    e = F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("t"), "lang")))
    text = F.array_join(F.transform("e", lambda x: F.concat(x["lang"], F.lit("="), F.format_string("%.3f", -x["t"]))), " ")
    share = F.array_join(F.transform("e", lambda x: F.concat(x["lang"], F.lit("="), F.format_string("%.3f", F.when(x["t"] == 0, 0.0).otherwise(F.col("e")[0]["t"] / x["t"])))), " ")
    return scores.groupBy(*keys).agg(e.alias("e")).select(*keys, text.alias("scores"), share.alias("ratios"))  # a row for each language
