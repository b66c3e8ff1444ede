"""All queries of the language-identification engine by name, with their SQL oracles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as T
from ..operators import cj, evaluate, incremental, train
from ..operators import model as M
from ..operators.detect import Params, detect, detect_scores, score_words, words_of
from ..sources import files
from . import fixed, sql
from . import oracle as O

#: The languages of the documents table.
LANGS = ["en", "fr", "de", "es"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SUMS = ("ng_u", "ng_hits", "tw_u", "tw_hits")
_tables: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small, as it may come in one part then; large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _bytes(df) < cores * 32e6 else df


def _bytes(df: DataFrame) -> int:
    """What Spark reckons a table on disk to hold."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """n-gram and topword tables of all documents, kept while the session lasts."""
    return _trained((spark.sparkContext.applicationId, sf_dir), documents(spark, sf_dir))


def _trained(key: tuple, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables come from the distinct words, so these are kept as well: texts are split once."""
    if key not in _tables:
        words = train.training_words(texts).persist()
        _tables[*key, "words"] = (words,)
        _tables[key] = (train.ngram_model(train.ngram_counts(words)).persist(), train.topword_model(words).persist())
    return _tables[key]


def model(spark: SparkSession, sf_dir: str, languages: list[str] | None = None, floor: float = -12.0, tw_floor: float | None = -12.0) -> M.Model:
    key = (spark.sparkContext.applicationId, sf_dir, tuple(languages or LANGS), floor, tw_floor)
    if key not in _tables:
        _tables[key] = M.assemble(*trained(spark, sf_dir), languages or LANGS, floor, tw_floor).persist()
    return _tables[key]


def forget() -> None:
    """Let go of all model tables: what runs next works them out again."""
    for held in _tables.values():
        for df in [held] if isinstance(held, M.Model) else held:
            df.unpersist()
    _tables.clear()


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumnRenamed("lang", "expected")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(expected(spark, sf_dir), model(spark, sf_dir), ["doc_id"], keep=["expected"])


COLUMNS = ["doc_id", "expected", "detected", "gap", "num_words", "num_chars", "num_lookups"]
DOCS = f"SELECT doc_id, lang AS expected, {O.FINAL} FROM documents LEFT JOIN dec USING (doc_id)"


# catalogues


_FIXED = [(int(i), *rest) for i, *rest in fixed.rows(fixed.LANGUAGES)]


@query("SELECT * FROM " + O.values(_FIXED, "lang_ord, name, iso, iso3, aliases, alphabets"))
def languages_catalog(spark, sf_dir):
    return catalog.languages(spark).withColumns({c: F.array_join(c, ",") for c in ("aliases", "alphabets")})


@query("SELECT lang_ord, iso FROM " + O.values(_FIXED, "lang_ord, name, iso, iso3, aliases, alphabets") + " WHERE list_contains(string_split(alphabets, ','), 'CYRILLIC')")
def languages_of_alphabet(spark, sf_dir):
    return catalog.languages(spark, "CYRILLIC").select("lang_ord", "iso")


@query("SELECT alpha_ord, name, CAST(w AS DOUBLE) AS weight FROM " + O.values([(int(i), a, float(w)) for i, a, w in fixed.rows(fixed.ALPHABETS)], "alpha_ord, name, w"))
def alphabets_catalog(spark, sf_dir):
    return catalog.alphabets(spark)


@query("SELECT alias, len(string_split(members, ',')) AS n, members FROM " + O.values([tuple(r) for r in fixed.rows(fixed.GROUPS)], "alias, members"))
def language_groups(spark, sf_dir):
    return catalog.groups(spark).groupBy("alias").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("iso")), ",").alias("members"))


# words


@query(f"WITH {O.word_ctes('documents', 'doc_id', ['LATIN'])} SELECT script, word, count(*) AS n_docs, CAST(sum(cnt) AS BIGINT) AS n FROM words GROUP BY 1, 2")
def tokenize_words(spark, sf_dir):
    words = words_of(documents(spark, sf_dir), model(spark, sf_dir), ["doc_id"])
    return words.groupBy("script", "word").agg(F.count("*").alias("n_docs"), F.sum("cnt").alias("n"))


@query(f"WITH {O.word_ctes('documents', 'doc_id', ['LATIN'])} SELECT doc_id, script, CAST(sum(cnt) AS BIGINT) AS words, CAST(sum(cnt * length(word)) AS BIGINT) AS chars FROM words GROUP BY 1, 2")
def script_profile(spark, sf_dir):
    words = words_of(documents(spark, sf_dir), model(spark, sf_dir), ["doc_id"])
    return words.groupBy("doc_id", "script").agg(F.sum("cnt").alias("words"), F.sum(F.col("cnt") * F.length("word")).alias("chars"))


# training


@query(f"WITH {O.train_ctes('documents')} SELECT lang, word, cnt FROM tr_words")
def training_words(spark, sf_dir):
    return train.training_words(documents(spark, sf_dir))


_COMMON = "word IN (SELECT word FROM (SELECT word, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) AS r FROM tp0) WHERE r <= 20)"
_TP0 = O.train_ctes("documents").replace("tr_raw", "tr_raw0").replace("tr_words", "tr_words0").replace("ng_counts", "ng_counts0").replace("ng AS", "ng0 AS").replace("tp_total", "tp_total0").replace("tp_counts", "tp_counts0").replace("tp AS", "tp0 AS")


@query(f"WITH {_TP0}, {O.train_ctes('documents', skips=_COMMON)} SELECT lang, n, count(*) AS distinct_grams, any_value(total) AS total, min(u) AS min_logprob_u FROM ng GROUP BY 1, 2")
def training_without_skipwords(spark, sf_dir):
    """Statistics of n-grams trained without the twenty most frequent words of each language."""
    skips = train.skipwords_of(trained(spark, sf_dir)[1], 20)
    words = train.training_words(documents(spark, sf_dir), skipwords=skips)
    return train.table_stats(train.ngram_model(train.ngram_counts(words)))


#: Letters in Cyrillic ones, by which documents of four languages stand for texts of four Cyrillic ones.
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "абцдефгхижклмнопярстувшыйзАБЦДЕФГХИЖКЛМНОПЯРСТУВШЫЙЗ"
CYRILLIC = {"en": "ru", "fr": "bg", "de": "uk", "es": "sr"}


def cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.create_map(*[F.lit(x) for pair in CYRILLIC.items() for x in pair])[F.col("lang")]
    return documents(spark, sf_dir).select("doc_id", F.translate("text", _LATIN, _CYRILLIC).alias("text"), lang.alias("lang"))


_CASE = "CASE lang " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CYRILLIC.items()) + " END"
_CYR = f"cyr AS (SELECT doc_id, translate(text, '{_LATIN}', '{_CYRILLIC}') AS text, {_CASE} AS lang FROM documents)"


@query(O.detect_sql("cyr", "doc_id", list(CYRILLIC.values()), f"SELECT doc_id, lang AS expected, {O.FINAL}, coalesce(pred, 'UNKNOWN') AS pred FROM cyr LEFT JOIN dec USING (doc_id)", ctes=_CYR, model=O.train_ctes("cyr", alphabet="CYRILLIC")))
def detect_cyrillic(spark, sf_dir):
    """Documents with their letters in Cyrillic: trained on, written as text files, read and detected."""
    texts = cyrillic(spark, sf_dir)
    if (spark.sparkContext.applicationId, sf_dir, "cyrillic") not in _tables:
        words = train.training_words(texts, ["CYRILLIC"]).persist()  # both tables and both kinds of files come from these
        grams = train.ngram_model(train.ngram_counts(words)).persist()
        folder = f"{work_dir(spark)}/cyrillic-{uuid.uuid4().hex}"
        files.write_ngrams(grams, folder, -20.0, compress=True)
        files.write_topwords(train.topword_model(words), folder, -20.0, logs=True)
        grams.unpersist()
        words.unpersist()
        _tables[spark.sparkContext.applicationId, sf_dir, "cyrillic"] = M.load(spark, folder, ",".join(CYRILLIC.values()))
    m = _tables[spark.sparkContext.applicationId, sf_dir, "cyrillic"]
    return detect(texts.withColumnRenamed("lang", "expected"), m, ["doc_id"], keep=["expected"])


def work_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lingmill-")
    return found.rstrip("/")


@query(f"WITH {O.train_ctes('documents')} SELECT lang, n, gram, cnt FROM ng_counts")
def ngram_counts(spark, sf_dir):
    return train.ngram_counts(train.training_words(documents(spark, sf_dir)))


@query(f"WITH {O.train_ctes('documents')} SELECT lang, n, gram, cnt, total, u AS logprob_u FROM ng")
def ngram_model(spark, sf_dir):
    return trained(spark, sf_dir)[0]


@query(f"WITH {O.train_ctes('documents')} SELECT lang, n, gram, cnt, total, u AS logprob_u FROM ng WHERE cnt >= greatest(1, ceil(total * exp(-10.0::DOUBLE))) AND NOT (n = 1 AND unicode(gram) < 128)")
def ngram_model_reduced(spark, sf_dir):
    return train.reduced(trained(spark, sf_dir)[0], -10.0)


@query(f"WITH {O.train_ctes('documents')} SELECT lang, word, cnt, total, u AS logprob_u FROM tp")
def topwords_model(spark, sf_dir):
    return trained(spark, sf_dir)[1]


@query(f"WITH {O.train_ctes('documents')} SELECT lang, n, count(*) AS distinct_grams, any_value(total) AS total, min(u) AS min_logprob_u FROM ng GROUP BY 1, 2")
def ngram_table_stats(spark, sf_dir):
    return train.table_stats(trained(spark, sf_dir)[0])


@query(f"WITH {O.train_ctes('documents')} SELECT word, string_agg(lang, ',' ORDER BY u DESC, lang) AS langs, count(*) AS n_langs, max(u) AS best_u FROM tp GROUP BY 1 HAVING count(*) > 1")
def topword_overlap(spark, sf_dir):
    return train.topword_overlap(trained(spark, sf_dir)[1])


@query(f"WITH {O.train_ctes('documents')} SELECT DISTINCT word FROM (SELECT word, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, word) AS r FROM tp) WHERE r <= 20")
def frequent_skipwords(spark, sf_dir):
    return train.skipwords_of(trained(spark, sf_dir)[1], 20)


# detection


@query(O.detect_sql("documents", "doc_id", LANGS, DOCS))
def detect_documents(spark, sf_dir):
    return found(spark, sf_dir).select(*COLUMNS)


@query(O.detect_sql("documents", "doc_id", LANGS, "SELECT doc_id, lang, round(total, 6) AS total, ng_u, ng_hits, tw_u, tw_hits, num_lookups FROM tot"))
def detect_scores_by_language(spark, sf_dir):
    return detect_scores(documents(spark, sf_dir), model(spark, sf_dir), ["doc_id"])


@query(O.detect_sql("documents", "doc_id", LANGS, DOCS, boosts={"fr": 0.3, "de": 0.05}))
def detect_boosted(spark, sf_dir):
    return detect(expected(spark, sf_dir), model(spark, sf_dir), ["doc_id"], boosts={"fr": 0.3, "de": 0.05}, keep=["expected"]).select(*COLUMNS)


@query(O.detect_sql("documents", "doc_id", LANGS, DOCS, min_ngram=2, stop=3, max_ngram=4))
def detect_ngram_params(spark, sf_dir):
    return detect(expected(spark, sf_dir), model(spark, sf_dir), ["doc_id"], Params(2, 3, 4), keep=["expected"]).select(*COLUMNS)


@query(O.detect_sql("documents", "doc_id", LANGS, DOCS, topwords=False))
def detect_no_topwords(spark, sf_dir):
    return detect(expected(spark, sf_dir), model(spark, sf_dir, tw_floor=None), ["doc_id"], Params(topwords=False), keep=["expected"]).select(*COLUMNS)


@query(O.detect_sql("documents", "doc_id", ["en", "de"], DOCS))
def detect_narrowed_langs(spark, sf_dir):
    return detect(expected(spark, sf_dir), model(spark, sf_dir, ["en", "de"]), ["doc_id"], keep=["expected"]).select(*COLUMNS)


_LITE = O.detect_sql("documents", "doc_id", LANGS, "SELECT doc_id, detected AS lite, gap AS lite_gap FROM dec", floor=-9.0, tw_floor=-9.0)
_FULL = O.detect_sql("documents", "doc_id", LANGS, "SELECT doc_id, detected AS full_, gap AS full_gap FROM dec", floor=-15.0, tw_floor=-15.0)


@query(f"SELECT doc_id, coalesce(lite, 'unknown') AS lite, coalesce(lite_gap, 1.0) AS lite_gap, coalesce(full_, 'unknown') AS full, coalesce(full_gap, 1.0) AS full_gap FROM documents LEFT JOIN ({_LITE}) USING (doc_id) LEFT JOIN ({_FULL}) USING (doc_id)")
def detect_lite_vs_full(spark, sf_dir):
    docs = documents(spark, sf_dir)
    one = lambda name, floor: detect(docs, model(spark, sf_dir, floor=floor, tw_floor=floor), ["doc_id"]).select("doc_id", F.col("detected").alias(name), F.col("gap").alias(f"{name}_gap"))
    return one("lite", -9.0).join(one("full", -15.0), "doc_id")


# evaluation: each half of the documents is judged by a model of the other half, so nothing is judged by what it was trained on

HALVES = (0, 1)


def half_model(spark: SparkSession, sf_dir: str, half: int) -> M.Model:
    key = (spark.sparkContext.applicationId, sf_dir, "half", half)
    if key not in _tables:
        texts = documents(spark, sf_dir).filter(F.pmod("doc_id", F.lit(2)) == half)
        _tables[key] = M.assemble(*_trained((*key, "tables"), texts), LANGS).persist()
    return _tables[key]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, expected, text of every line that isn't blank: phrases, long and short."""
    rows = expected(spark, sf_dir).select("doc_id", "expected", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.filter(F.trim("text") != "")


def judged(spark: SparkSession, sf_dir: str, keep: tuple = ()) -> DataFrame:
    """Detections of all lines, by the model of the half that they are not in."""
    rows, out = lines(spark, sf_dir), None
    for half in HALVES:
        mine = rows.filter(F.pmod("doc_id", F.lit(2)) != half)
        found = detect(mine, half_model(spark, sf_dir, half), ["doc_id", "line_no"], keep=["expected", *keep])
        out = found if out is None else out.union(found)
    return out


_RIGHT = "(expected = detected OR (expected LIKE 'zh%' AND detected LIKE 'zh-%'))"
_KNOWN = "detected <> 'unknown'"
_CLOSE = "(expected, detected) IN (('ms', 'id'), ('af', 'nl'), ('nn', 'no'))"
_LINES = "pl AS (SELECT doc_id, lang AS expected, CAST(i - 1 AS INT) AS line_no, p[i] AS text FROM (SELECT doc_id, lang, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(p[i], ' ') <> '' AND doc_id % 2 {})"
_PART = lambda half: O.detect_sql("pl", "doc_id, line_no", LANGS, f"SELECT doc_id, line_no, expected, text, {O.FINAL} FROM pl LEFT JOIN dec USING (doc_id, line_no)", ctes=_LINES.format(f"<> {half}"), model=O.train_ctes("documents", where=f"doc_id % 2 = {half}"))
_JUDGED = f"f AS (({_PART(0)}) UNION ALL ({_PART(1)}))"


@query(f"WITH {_JUDGED} SELECT expected, count(*) FILTER ({_KNOWN} AND {_RIGHT}) AS correct, count(*) FILTER ({_KNOWN}) AS total, count(*) FILTER (NOT {_KNOWN}) AS skipped, round(CASE WHEN count(*) FILTER ({_KNOWN}) > 0 THEN 100.0::DOUBLE * count(*) FILTER ({_KNOWN} AND {_RIGHT}) / count(*) FILTER ({_KNOWN}) ELSE 0 END, 4) AS pct FROM f GROUP BY ROLLUP (expected)")
def phrase_eval(spark, sf_dir):
    return evaluate.accuracy(judged(spark, sf_dir))


@query(f"WITH {_JUDGED} SELECT expected, detected, count(*) AS n, {_CLOSE} AS known_cross FROM f WHERE {_KNOWN} AND NOT {_RIGHT} GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(judged(spark, sf_dir))


@query(f"WITH {_JUDGED} SELECT doc_id, line_no, expected, detected, gap FROM f WHERE {_KNOWN} AND NOT {_RIGHT} ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)), doc_id, line_no LIMIT 10")
def sampled_misses(spark, sf_dir):
    return evaluate.sampled_misses(judged(spark, sf_dir), ["doc_id", "line_no"]).select("doc_id", "line_no", "expected", "detected", "gap")


@query(f"WITH {_JUDGED} SELECT doc_id, line_no, expected, detected, CASE WHEN length(text) > 80 THEN translate(text[:80], chr(10), ' ') || '...' ELSE translate(text, chr(10), ' ') END AS snippet FROM f WHERE {_KNOWN} AND NOT {_RIGHT}")
def miss_snippets(spark, sf_dir):
    return evaluate.snippets(judged(spark, sf_dir, ("text",)), ["doc_id", "line_no"])


_BARE = r"regexp_replace(html, '<[^>]*>', chr(10), 'g')"
_PARS = rf"pars AS (SELECT page_id, expected, CAST(i - 1 AS INT) AS par_no, p[i] AS text FROM (SELECT page_id, expected, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, regexp_extract(html, '<html lang=\"([a-z-]+)\"', 1) AS expected, string_split_regex({_BARE}, '\n{{2,}}') AS p FROM pages)) WHERE length(p[i]) >= 20)"


@query(O.detect_sql("pars", "page_id, par_no", LANGS, f""", g AS (SELECT expected, {O.FINAL} FROM pars LEFT JOIN dec USING (page_id, par_no))
    SELECT expected, count(*) AS chunks, count(*) FILTER ({_KNOWN} AND {_RIGHT}) AS correct, count(*) FILTER ({_KNOWN} AND NOT {_RIGHT}) AS misses, count(*) FILTER ({_KNOWN} AND NOT {_RIGHT} AND num_words <= 2) AS short_misses, count(*) FILTER (NOT {_KNOWN}) AS skipped,
    CAST(CASE WHEN count(*) FILTER ({_KNOWN}) > 0 THEN floor(sum(num_chars) FILTER ({_KNOWN}) / count(*) FILTER ({_KNOWN})) ELSE 0 END AS BIGINT) AS avg_chars, CAST(floor(sum(num_words) / count(*)) AS BIGINT) AS avg_words FROM g GROUP BY 1""", ctes=_PARS).replace(" ,", ","))  # fmt: skip
def paragraph_eval(spark, sf_dir):
    """The paragraphs of all pages, tags being line breaks; the model has seen none of them."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z-]+)"', 1).alias("expected"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    pars = evaluate.paragraphs(pages, ["page_id"])
    return evaluate.chunk_stats(detect(pars, model(spark, sf_dir), ["page_id", "par_no"], keep=["expected"]))


# parts of texts


@query(O.detect_sql("conversations", "conv_id, turn", LANGS, f"SELECT conv_id, {O.FINAL} FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN dec USING (conv_id)", grouped="conv_id"))
def conversation_detect(spark, sf_dir):
    parts = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return incremental.detect_merged(parts, model(spark, sf_dir), ["conv_id"], "turn").drop("pred")


def _running() -> str:
    head = f"WITH {O.detect_ctes('conversations', 'conv_id, turn', LANGS, model=O.train_ctes('documents'))}"
    head = head.replace("    ev AS (", "    ev0 AS (").replace("    prof AS (", "    prof0 AS (")
    return f"""{head}, steps AS (SELECT DISTINCT conv_id, turn FROM conversations),
    ev AS (SELECT s.conv_id, s.turn, lang, CAST(sum(ng_u) AS BIGINT) AS ng_u, CAST(sum(ng_hits) AS BIGINT) AS ng_hits, CAST(sum(tw_u) AS BIGINT) AS tw_u, CAST(sum(tw_hits) AS BIGINT) AS tw_hits FROM steps s JOIN ev0 e ON e.conv_id = s.conv_id AND e.turn <= s.turn GROUP BY ALL),
    prof AS (SELECT s.conv_id, s.turn, script, sum(chars) AS chars, sum(nw) AS nw, sum(lookups) AS lookups FROM steps s JOIN prof0 e ON e.conv_id = s.conv_id AND e.turn <= s.turn GROUP BY ALL),
    {O.decide_ctes('conv_id, turn', LANGS)} SELECT conv_id, turn, {O.FINAL} FROM steps LEFT JOIN dec USING (conv_id, turn)"""


@query(_running())
def conversation_running_detect(spark, sf_dir):
    parts = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return incremental.detect_running(parts, model(spark, sf_dir), ["conv_id"], "turn").drop("pred")


# documents with what they lack: apostrophes, skipwords, digits in words, a second script

_GREEK = ("abdegiklmnoprstz", "αβδεγικλμνοπρστζ")
_BETWEEN = "' http www.km 4you don''t, "


def altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elisions and apostrophes at the end, addresses and units between words, and Spanish half in Greek letters."""
    text = F.replace(F.replace("text", F.lit("e "), F.lit("e'")), F.lit(", "), F.lit(_BETWEEN))
    text = F.when(F.col("lang") == "es", F.translate(text, *_GREEK)).otherwise(text)
    return documents(spark, sf_dir).select("doc_id", text.alias("text"), "lang")


_ALTERED = f"""alt0 AS (SELECT doc_id, lang, replace(replace(text, 'e ', {O.q("e'")}), ', ', {O.q(_BETWEEN)}) AS t FROM documents),
    alt AS (SELECT doc_id, lang, CASE WHEN lang = 'es' THEN translate(t, '{_GREEK[0]}', '{_GREEK[1]}') ELSE t END AS text FROM alt0)"""


@query(O.detect_sql("alt", "doc_id", [*LANGS, "el"], f"SELECT doc_id, lang AS expected, {O.FINAL}, coalesce(pred, 'UNKNOWN') AS pred FROM alt LEFT JOIN dec USING (doc_id)", ctes=_ALTERED, model=O.train_ctes("alt")))
def detect_altered_documents(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "altered")
    if key not in _tables:
        _tables[key] = M.assemble(*_trained((*key, "tables"), altered(spark, sf_dir)), [*LANGS, "el"]).persist()
    return detect(altered(spark, sf_dir).withColumnRenamed("lang", "expected"), _tables[key], ["doc_id"], keep=["expected"])


@query(f"WITH {_ALTERED}, {O.train_ctes('alt')} SELECT lang, word, cnt, total, u AS logprob_u FROM tp")
def topwords_of_altered_documents(spark, sf_dir):
    return _trained((spark.sparkContext.applicationId, sf_dir, "altered", "tables"), altered(spark, sf_dir))[1]


# cleaning


def _accents(column: str) -> str:
    out = f"translate({column}, {O.q(fixed.ACCENTED)}, {O.q(fixed.PLAIN)})"
    for pair in fixed.JOINED.split():
        out = f"replace({out}, {O.q(pair[0])}, {O.q(pair[2:])})"
    return out


@query(f"SELECT doc_id, {_accents('text')} AS text FROM documents")
def remove_accents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.remove_accents(F.col("text")).alias("text"))


@query(f"SELECT i, {_accents('text')} AS text FROM (SELECT CAST(unnest(range(160, 65536)) AS BIGINT) AS i, chr(CAST(i AS INT)) || 'x' AS text) WHERE (i < 55296 OR i >= 57344) AND i <> 65279")
def accent_table(spark, sf_dir):
    """What becomes of every letter of the first plane."""
    rows = spark.range(160, 65536).filter("(id < 55296 OR id >= 57344) AND id <> 65279").select(F.col("id").alias("i"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    return rows.select("i", T.remove_accents(F.concat("c", F.lit("x"))).alias("text"))


@query(O.detect_sql("plain", "doc_id", LANGS, DOCS, ctes=f"plain AS (SELECT doc_id, {_accents('text')} AS text FROM documents)"))
def detect_accent_stripped(spark, sf_dir):
    plain = expected(spark, sf_dir).withColumn("text", T.remove_accents(F.col("text")))
    return detect(plain, model(spark, sf_dir), ["doc_id"], keep=["expected"]).select(*COLUMNS)


#: Texts with wiki markup, and what is left of them.
MARKUP = [
    ("see [[link target]] for details", "see  for details"),
    ("before {{template|arg}} after", "before  after"),
    ("a [[outer [[inner]] text]] b", "a  b"),
    ('before <ref name="x"> after', "before  after"),
    ("visit https://example.com/page for info", "visit  for info"),
    ("a &lt; b &amp; c", "a  b  c"),
    ('before {| class="wikitable"\n|cell\n|} after', "before  after"),
    ("header\n| row1\n| row2\nfooter", "header\n\n\nfooter"),
    ("&#160;", "&#160;"),
    ("open [[never closed", "open "),
    ("http:", "http:"),
]


@query("SELECT id, cleaned FROM " + O.values([(i, b) for i, (_, b) in enumerate(MARKUP)], "id, cleaned"))
def wiki_markup_strip(spark, sf_dir):
    return spark.createDataFrame([(i, a) for i, (a, _) in enumerate(MARKUP)], "id int, text string").select("id", T.remove_markup("text").alias("cleaned"))


#: What is taken out where nothing is nested, in the SQL's dialect; and what is put into documents, with all that nests.
_UNNESTED = r"(?m)^\|[^\n]*|<[^>\n]*>?|&[A-Za-z]+;|https?://[^\x00-\x20\]]*"
_NESTED = ". {{note [[a|b]] {{c\n|d}} }}{| e {| f |} |}<ref name='x'>&amp;http://x.org/a?b "


@query(f"SELECT page_id, regexp_replace(html, '{_UNNESTED}', '', 'g') AS cleaned FROM pages")
def wiki_markup_pages(spark, sf_dir):
    """Every page without its markup."""
    return spread(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", T.remove_markup("html").alias("cleaned"))


@query(f"SELECT doc_id, replace(regexp_replace(replace(text, '. ', chr(1)), '{_UNNESTED}', '', 'g'), chr(1), '.  ') AS cleaned FROM documents")
def wiki_markup_documents(spark, sf_dir):
    """Every document with nested markup after each sentence, and without it again."""
    marked = F.replace("text", F.lit(". "), F.lit(_NESTED))
    return documents(spark, sf_dir).select("doc_id", T.remove_markup(marked).alias("cleaned"))


_PAGE_TEXT = r"regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>|&[a-z]+;', ' ', 'g')"


@query(O.detect_sql("body", "page_id", LANGS, f"SELECT page_id, expected, {O.FINAL} FROM body LEFT JOIN dec USING (page_id)", ctes=f"body AS (SELECT page_id, regexp_extract(html, '<html lang=\"([a-z-]+)\"', 1) AS expected, {_PAGE_TEXT} AS text FROM pages)"))
def pages_detect(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>|&[a-z]+;", " ")
    body = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z-]+)"', 1).alias("expected"), bare.alias("text"))
    return detect(body, model(spark, sf_dir), ["page_id"], keep=["expected"]).drop("pred")


@query(O.detect_sql("documents", "doc_id", LANGS, DOCS))
def detect_sql_function(spark, sf_dir):
    """The same as detect_documents, by the function of SQL."""
    sql.register(spark, model(spark, sf_dir), suffix="_of_documents")
    documents(spark, sf_dir).createOrReplaceTempView("_documents")
    return spark.sql("SELECT doc_id, lang AS expected, r.* FROM (SELECT doc_id, lang, detect_result_of_documents(text) AS r FROM _documents)").select(*COLUMNS)


@query("SELECT trim(text, ' ' || chr(10) || chr(9)) AS text, count(*) AS n FROM documents WHERE trim(text, ' ' || chr(10) || chr(9)) <> '' GROUP BY 1")
def wiki_xml_extract(spark, sf_dir):
    """Documents written as pages of a compressed dump, and their texts as extracted from it."""
    folder = f"{work_dir(spark)}/dump-{uuid.uuid4().hex}"
    pages = documents(spark, sf_dir).select("doc_id", F.struct("text").alias("revision"))
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("compression", "bzip2").save(folder)
    return files.read_wiki(spark, folder, strip=False).groupBy("text").agg(F.count("*").alias("n"))


# hand-made models

NGRAMS = [("en", 2, "th", -4000000), ("en", 2, "he", -4500000), ("en", 2, "le", -6000000), ("fr", 2, "le", -3000000), ("en", 3, "the", -5000000)]
TOPWORDS = [("en", "the", -2500000), ("fr", "le", -3000000), ("fr", "l'", -4000000), ("fr", "ami", -7000000)]
_MICRO = f"ng AS {O.values(NGRAMS, 'lang, n, gram, u')}, tp AS {O.values(TOPWORDS, 'lang, word, u')}"
PHRASES = [(1, "the"), (2, "le"), (3, "l'ami"), (4, "l’a"), (5, "the le"), (6, "thex"), (7, "zzz"), (8, "12'abc the"), (9, "don''t"), (10, ""), (11, "dogs' le")]
SKIPPED = [(1, "http"), (2, "http the"), (3, "www.le.htm"), (4, "fffff le the"), (5, "km the")]
MIXED = [(1, "He likes to say привет"), (2, "我的名字是Jonathan"), (3, "I like the characters 羊驼"), (4, "le привет мир всем"), (5, "Γειά σου the")]
UNIQUE = [(1, "hello"), (2, "事務所"), (3, "مرحبًا"), (4, "բարև"), (5, "Γειά σου"), (6, "שלום"), (7, "नमस्ते"), (8, "สวัสดี"), (9, "வணக்கம்"), (10, "გამარჯობა"), (11, "123")]
UNIQUE_LANGS = "en ja ar hy bn ka el gu he hi pa si ta te th am ml kn km lo my".split()
MIXED_LANGS = "en fr el ru zh-hans zh-hant ja".split()


def _micro(spark: SparkSession, languages: list[str]) -> M.Model:
    ngrams = spark.createDataFrame(NGRAMS, "lang string, n int, gram string, logprob_u long")
    return M.assemble(ngrams, spark.createDataFrame(TOPWORDS, "lang string, word string, logprob_u long"), languages)


def _phrases(name: str, rows: list[tuple], languages: list[str]) -> None:
    sql = O.detect_sql("p", "id", languages, f"SELECT id, {O.FINAL}, coalesce(pred, 'UNKNOWN') AS pred FROM p LEFT JOIN dec USING (id)", ctes=f"p AS {O.values(rows, 'id, text')}", model=_MICRO)

    def run(spark, sf_dir):
        return detect(spark.createDataFrame(rows, "id int, text string"), _micro(spark, languages), ["id"])

    run.__name__ = name
    query(sql)(run)


_phrases("apostrophe_topwords", PHRASES, ["en", "fr"])
_phrases("skipword_filter", SKIPPED, ["en", "fr"])
_phrases("multi_script_detect", MIXED, MIXED_LANGS)
_phrases("unique_alphabet_detect", UNIQUE, UNIQUE_LANGS)

CJ_TRAIN = [("zh-hans", "今天天气很好我们去公园散步这个学生学习汉语"), ("zh-hant", "今天天氣很好我們去公園散步這個學生學習漢語"), ("ja", "今日は天気がいいので公園へ散歩に行きます学生は日本語を勉強します")]
CJ_TEXTS = [(1, "我们学习汉语"), (2, "我們學習漢語"), (3, "日本語を勉強します"), (4, "天气很好"), (5, "hello"), (6, "龘龘"), (7, "今日は天気"), (8, "公園 散步 学"), (9, ""), (10, "学生学習a")]
CJ_LANGS = ["zh-hans", "zh-hant", "ja"]


@query(f"WITH src AS {O.values(CJ_TRAIN, 'lang, text')}, t AS {O.values(CJ_TEXTS, 'id, text')}, {O.cj_train_ctes('src')}, {O.word_ctes('t', 'id', ['HAN', 'JA_KANA'])}, prof AS (SELECT id, script, sum(length(word) * cnt) AS chars FROM words GROUP BY ALL), scripts AS (SELECT '' AS script, 1.0 AS weight WHERE false), {O.cj_ctes('id', CJ_LANGS)} SELECT id, coalesce(detected, 'unknown') AS detected, CAST(kana AS BIGINT) AS kana, CAST(n AS BIGINT) AS cj_chars FROM cj JOIN cj_text USING (id)")
def cj_detect(spark, sf_dir):
    table = cj.train(spark.createDataFrame(CJ_TRAIN, "lang string, text string"))
    return cj.classify(spark.createDataFrame(CJ_TEXTS, "id int, text string"), table, CJ_LANGS, ["id"])


#: Small letters as Chinese or Japanese characters, by which documents of four languages stand for three; capitals stay Latin.
CJ_LETTERS = {"en": ("zh-hans", "的一是不了人我在有他这个们中来上大为和国地到以说时要"), "fr": ("zh-hant", "的一是不了人我在有他這個們中來上大為和國地到以說時要"), "de": ("ja", "の一是不人日大年中本国時上出長生間月行見学高前小要を"), "es": ("ja", "一是不人日大年中本国時上出長生間月行見学高前小要手水火")}
_SMALL = "abcdefghijklmnopqrstuvwxyz"


def cj_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, lang = F.col("text"), F.lit(None).cast("string")
    for x, (to, characters) in CJ_LETTERS.items():
        text, lang = F.when(F.col("lang") == x, F.translate("text", _SMALL, characters)).otherwise(text), F.when(F.col("lang") == x, to).otherwise(lang)
    return documents(spark, sf_dir).select("doc_id", text.alias("text"), lang.alias("lang"))


def cj_model(spark: SparkSession, sf_dir: str) -> M.Model:
    """English, which no other language shares its script with, and the three languages of Han characters."""
    key = (spark.sparkContext.applicationId, sf_dir, "cj")
    if key not in _tables:
        none = spark.createDataFrame([], "lang string, n int, gram string, logprob_u long")
        tops = spark.createDataFrame([], "lang string, word string, logprob_u long")
        _tables[key] = M.assemble(none, tops, ["en", *CJ_LANGS], cj=cj.train(cj_documents(spark, sf_dir))).persist()
    return _tables[key]


_CJ_DOCS = "cjd AS (SELECT doc_id, CASE lang " + " ".join(f"WHEN '{x}' THEN translate(text, '{_SMALL}', '{c}')" for x, (_, c) in CJ_LETTERS.items()) + " ELSE text END AS text, CASE lang " + " ".join(f"WHEN '{x}' THEN '{to}'" for x, (to, _) in CJ_LETTERS.items()) + " END AS lang FROM documents)"
_NONE = "ng AS (SELECT '' AS lang, 1 AS n, '' AS gram, 0 AS u WHERE false), tp AS (SELECT '' AS lang, '' AS word, 0 AS u WHERE false)"


def _cj(name: str, boosts: dict | None) -> None:
    select = f"SELECT doc_id, lang AS expected, {O.FINAL}, coalesce(pred, 'UNKNOWN') AS pred FROM cjd LEFT JOIN dec USING (doc_id)"

    def run(spark, sf_dir):
        texts = cj_documents(spark, sf_dir).withColumnRenamed("lang", "expected")
        return detect(texts, cj_model(spark, sf_dir), ["doc_id"], boosts=boosts, keep=["expected"])

    run.__name__ = name
    query(O.detect_sql("cjd", "doc_id", ["en", *CJ_LANGS], select, ctes=_CJ_DOCS, model=f"{O.cj_train_ctes('cjd')}, {_NONE}", cj=True, boosts=boosts))(run)


_cj("cj_detect_documents", None)
_cj("cj_detect_boosted", {"ja": 0.2, "zh-hant": 0.05})


_TURNS = "t AS (SELECT conv_id, turn, CASE conv_id % 3 " + " ".join(f"WHEN {i} THEN translate(text, '{_SMALL}', '{CJ_LETTERS[x][1]}')" for i, x in enumerate(("en", "fr", "de"))) + " END AS text FROM conversations)"


@query(f"WITH {_CJ_DOCS}, {_TURNS}, {O.cj_train_ctes('cjd')}, {O.word_ctes('t', 'conv_id, turn', ['HAN', 'JA_KANA'])}, prof AS (SELECT conv_id, turn, script, sum(length(word) * cnt) AS chars FROM words GROUP BY ALL), scripts AS (SELECT '' AS script, 1.0 AS weight WHERE false), {O.cj_ctes('conv_id, turn', CJ_LANGS)} SELECT conv_id, turn, coalesce(detected, 'unknown') AS detected, CAST(kana AS BIGINT) AS kana, CAST(n AS BIGINT) AS cj_chars FROM cj JOIN cj_text USING (conv_id, turn)")
def cj_detect_conversations(spark, sf_dir):
    """Every turn, its small letters as characters of one of three languages, by the classifier alone."""
    table = cj.train(cj_documents(spark, sf_dir))
    text = F.col("text")
    for i, x in enumerate(("en", "fr", "de")):
        text = F.when(F.col("conv_id") % 3 == i, F.translate("text", _SMALL, CJ_LETTERS[x][1])).otherwise(text)
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return cj.classify(turns, table, CJ_LANGS, ["conv_id", "turn"])


@query(O.detect_sql("documents", "doc_id", LANGS, "SELECT script, word, lang, CAST(ng_u AS BIGINT) AS ng_u, CAST(ng_hits AS BIGINT) AS ng_hits, CAST(tw_u AS BIGINT) AS tw_u, CAST(tw_hits AS BIGINT) AS tw_hits FROM hit"))
def word_scores(spark, sf_dir):
    """Evidence of each distinct word of the documents."""
    m = model(spark, sf_dir)
    rows, _ = score_words(words_of(documents(spark, sf_dir), m, ["doc_id"]), m)
    return rows.groupBy("script", "word", "lang").agg(*[F.sum(c).alias(c) for c in SUMS])
