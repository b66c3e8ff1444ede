"""Commands: python -m lingmill COMMAND --option value ... Every one is a thin call of the functions beside it; help lists the options.

Texts come from wiki dumps, as `path:language,path:language`; models are folders, or prefixes of files (see sources.files).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import catalog
from .functions import text as T
from .operators import evaluate, train
from .operators import model as M
from .operators.detect import Params, detect, detect_scores, score_string
from .sources import files


def _session() -> SparkSession:
    return SparkSession.builder.appName("lingmill").getOrCreate()


def _params(a) -> Params:
    return Params(a.min_ngram, a.stop_if_covered, a.max_ngram, not a.no_topwords)


def _model(spark: SparkSession, a) -> M.Model:
    return M.load(spark, a.model, a.languages, a.variant, a.min_log_prob, a.tw_min_log_prob)


def _boosts(a) -> dict[str, float]:
    return {catalog.parse_language(k): float(v) for k, _, v in (x.partition("=") for x in filter(None, a.boosts.split(",")))}


def _cleaned(a, texts: DataFrame) -> DataFrame:
    return texts.withColumn("text", T.remove_accents(F.col("text"))) if a.remove_accents else texts


def showwiki(a) -> None:
    files.write_wiki(_session(), a.infile, a.outfile, a.no_markup)


def ngrams(a) -> None:
    spark = _session()
    texts = files.read_labelled(spark, a.infiles, limit=a.limit)
    skips = files.read_skipword_lists(spark, a.skipwords) if a.skipwords else None
    words = train.training_words(texts, [catalog.parse_alphabet(a.alphabet)] if a.alphabet else None, skipwords=skips)
    files.write_ngrams(train.ngram_model(train.ngram_counts(words), a.min_log_prob), a.out, a.min_log_prob, a.gzip)
    if not a.no_topwords:
        files.write_topwords(train.topword_model(words, a.tw_min_log_prob), a.out, a.tw_min_log_prob, a.tw_as_log_prob, a.gzip)


def reducengrams(a) -> None:
    counts = files.read_ngram_counts(_session(), a.model)
    files.write_ngrams(train.reduced(counts, a.min_log_prob, a.max_ngram), a.out, a.min_log_prob, a.gzip)


def reducetopwords(a) -> None:
    words = files.read_topword_counts(_session(), a.model)
    files.write_topwords(train.reduced_topwords(words, a.tw_min_log_prob), a.out, a.tw_min_log_prob, True, a.gzip)


def topwordoverlap(a) -> None:
    tops = files.read_topwords(_session(), a.model).filter(F.col("lang").isin(catalog.parse_languages(a.languages)))
    train.topword_overlap(tops).orderBy(F.desc("best_u"), "word").show(a.limit or 1000, truncate=False)


def showlanguages(a) -> None:
    alphabet = catalog.parse_alphabet(a.alphabet) if a.alphabet else None
    if alphabet == "UNKNOWN":
        raise SystemExit(f"unknown alphabet: {a.alphabet}")
    found = [x for x in catalog.LANGUAGES if alphabet is None or alphabet in x.alphabets]
    print("\n".join(x.name for x in found) if a.names else " ".join(x.iso for x in found))


def phraseeval(a) -> None:
    spark = _session()
    phrases = _cleaned(a, files.read_phrases(spark, a.infile)).withColumn("phrase", F.monotonically_increasing_id())
    found = detect(phrases, _model(spark, a), ["phrase"], _params(a), _boosts(a), keep=["expected", "text"])
    evaluate.accuracy(found).orderBy(F.col("expected").asc_nulls_last()).show(200)
    if a.show_misses:
        evaluate.confusion(found).orderBy(F.desc("n"), "expected", "detected").show(1000)
        evaluate.snippets(found, ["phrase"]).show(1000, truncate=False)


def wikieval(a) -> None:
    spark = _session()
    texts = _cleaned(a, files.read_labelled(spark, a.infiles)).select(F.col("lang").alias("expected"), "text", F.monotonically_increasing_id().alias("text_no"))
    pars = evaluate.paragraphs(texts, ["text_no"])
    pars = pars if a.limit is None else pars.limit(a.limit)  # over all files
    found = detect(pars, _model(spark, a), ["text_no", "par_no"], _params(a), _boosts(a), keep=["expected", "text"])
    evaluate.chunk_stats(found).orderBy("expected").show(200)
    evaluate.confusion(found).orderBy(F.desc("n"), "expected", "detected").show(1000)
    if a.show_misses:
        evaluate.snippets(evaluate.sampled_misses(found, ["text_no", "par_no"]), ["text_no", "par_no"], size=256).show(1000, truncate=False)


def adhoc(a) -> None:
    spark = _session()
    model, texts = _model(spark, a), _cleaned(a, spark.createDataFrame([(0, a.phrase)], "id int, text string"))
    detect(texts, model, ["id"], _params(a), _boosts(a)).show(truncate=False)
    scores = detect_scores(texts, model, ["id"], _params(a), _boosts(a))
    scores.orderBy(F.desc("total")).show(100)
    score_string(scores, ["id"]).show(truncate=False)


def loadmodelspeed(a) -> None:
    print(evaluate.load_benchmark(_session(), a.model, a.languages, a.variant))


def detectspeed(a) -> None:
    spark = _session()
    texts = files.read_phrases(spark, a.infile) if a.infile else files.read_labelled(spark, a.infiles, limit=a.limit)
    model, texts = _model(spark, a), texts.withColumn("id", F.monotonically_increasing_id())
    for _ in range(a.rounds):
        print(evaluate.throughput(detect(texts, model, ["id"], _params(a))))


COMMANDS = {f.__name__: f for f in (showwiki, ngrams, reducengrams, reducetopwords, topwordoverlap, showlanguages, phraseeval, wikieval, adhoc, loadmodelspeed, detectspeed)}
#: Default floors of files: as they are made, and as they are reduced.
FLOORS = {"ngrams": -20.0, "reducengrams": -16.0, "reducetopwords": -16.0}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lingmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = commands.add_parser(name)
        for option in ("--infile", "--infiles", "--outfile", "--out", "--model", "--alphabet", "--skipwords", "--phrase"):
            p.add_argument(option)
        for option, default in (("--min-log-prob", FLOORS.get(name)), ("--tw-min-log-prob", FLOORS.get(name))):
            p.add_argument(option, type=float, default=default)
        for option, default in (("--limit", None), ("--rounds", 3), ("--min-ngram", 1), ("--stop-if-covered", 3), ("--max-ngram", 5)):
            p.add_argument(option, type=int, default=default)
        for option in ("--gzip", "--no-topwords", "--tw-as-log-prob", "--no-markup", "--names", "--remove-accents", "--show-misses"):
            p.add_argument(option, action="store_true")
        p.add_argument("--languages", default="all")
        p.add_argument("--variant", choices=list(M.VARIANTS), default="lite")
        p.add_argument("--boosts", default="", help="language=boost,language=boost")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](a)


if __name__ == "__main__":
    main()
