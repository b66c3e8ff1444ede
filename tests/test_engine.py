"""Queries against their SQL, sources and sinks, stored models, streams, held-out accuracy."""

import bz2
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lingmill.functions import catalog
from lingmill.operators import evaluate, incremental, scoring, train
from lingmill.operators import model as M
from lingmill.operators.detect import Params, detect, detect_scores, score_string
from lingmill.plans import registry
from lingmill.sources import files
from lingmill.streaming.detect import Accumulator, word_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["languages_catalog", "languages_of_alphabet", "alphabets_catalog", "language_groups", "training_without_skipwords", "detect_cyrillic", "ngram_model_reduced", "topwords_model", "topword_overlap", "detect_documents", "detect_ngram_params", "detect_scores_by_language", "phrase_eval", "confusion_matrix", "sampled_misses", "miss_snippets", "paragraph_eval", "conversation_detect", "conversation_running_detect", "apostrophe_topwords", "skipword_filter", "multi_script_detect", "remove_accents", "accent_table", "wiki_markup_pages", "wiki_markup_documents", "wiki_xml_extract", "detect_altered_documents", "topwords_of_altered_documents", "detect_sql_function", "cj_detect", "cj_detect_conversations", "cj_detect_documents", "cj_detect_boosted", "word_scores"])
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert len(got)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    norm = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert norm(got) == norm(want)


def test_held_out_accuracy(spark):
    docs = registry.documents(spark, SF)
    model = M.assemble(*M.train_tables(docs.filter("doc_id % 2 = 0")), registry.LANGS)
    held = docs.filter("doc_id % 2 = 1").withColumnRenamed("lang", "expected")
    found = detect(held, model, ["doc_id"], keep=["expected"]).cache()
    total = evaluate.accuracy(found).filter("expected IS NULL").first()
    assert total["pct"] > 95 and total["total"] + total["skipped"] == held.count()
    assert evaluate.throughput(found)["texts"] == held.count()


@pytest.mark.parametrize("name", ["detect_documents", "detect_scores_by_language", "detect_no_topwords", "conversation_running_detect", "cj_detect_boosted", "apostrophe_topwords", "multi_script_detect"])
def test_joined_models_say_the_same(spark, monkeypatch, name):
    """A model that is too large to be sent gives what a sent one gives."""
    registry.forget()
    norm = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).toPandas().astype(str).to_numpy().tolist()))
    sent = norm(registry.QUERIES[name](spark, SF))
    monkeypatch.setattr(M, "SENT_ENTRIES", -1)
    registry.forget()
    assert norm(registry.QUERIES[name](spark, SF)) == sent
    registry.forget()


def test_small_tables_of_pieces_start_anew(spark, monkeypatch):
    texts = [r[0] for r in registry.documents(spark, SF).select("text").limit(60).collect()] + [None, "", "1'2", "x" * 300]
    facts, params = registry.model(spark, SF).facts, Params()
    tables = registry.model(spark, SF).sent(params).value[2]
    whole = scoring.Pieces(facts, tables, params).sums(texts)
    monkeypatch.setattr(scoring, "TABLE_BYTES", 0)
    small = scoring.Pieces(facts, tables, params)
    small.size, small.slice = 300, 100
    assert (small.sums(texts) == whole).all() and len(small) <= 300


def test_many_languages_add_up(spark):
    """More languages than have columns of their own in a sum."""
    grams = spark.createDataFrame([(x, 1, "a", -i * 1000 - 1) for i, x in enumerate(catalog.GROUPS["latin_alphabet"], 1)], "lang string, n int, gram string, logprob_u long")
    model = M.assemble(grams, None, catalog.GROUPS["latin_alphabet"], tw_floor=None)
    parts = spark.createDataFrame([(1, 0, "a b"), (1, 1, "aa"), (2, 0, None), (2, 1, "a"), (3, 0, "")], "k int, part int, text string")
    merged = {r["k"]: (r["detected"], r["num_words"]) for r in incremental.detect_merged(parts, model, ["k"], "part", Params(topwords=False)).collect()}
    assert merged == {1: ("af", 3), 2: ("af", 1), 3: ("unknown", 0)}
    running = {(r["k"], r["part"]): (r["detected"], r["num_words"]) for r in incremental.detect_running(parts, model, ["k"], "part", Params(topwords=False)).collect()}
    assert running == {(1, 0): ("af", 2), (1, 1): ("af", 3), (2, 0): ("unknown", 0), (2, 1): ("af", 1), (3, 0): ("unknown", 0)}


def test_files_round_trip(spark, tmp_path):
    docs = registry.documents(spark, SF)
    words = train.training_words(docs)
    grams, tops = train.ngram_model(train.ngram_counts(words)), train.topword_model(words)
    for compress in (False, True):
        folder = str(tmp_path / f"files{compress}")
        files.write_ngrams(grams, folder, -20.0, compress)
        files.write_topwords(tops, folder, -20.0, compress=compress)
        end = ".txt.gz" if compress else ".txt"
        assert sorted(os.listdir(folder)) == sorted(x for k in ("ngrams", "topwords") for lang in registry.LANGS for x in (f"{k}-{lang}{end}", f".{k}-{lang}{end}.crc") if not x.startswith(".") or x in os.listdir(folder))
        back = files.read_ngrams(spark, folder)
        assert back.drop("file_floor_u").exceptAll(grams.select("lang", "n", "gram", "logprob_u")).count() == 0 and back.count() == grams.count()
        back = files.read_topwords(spark, folder)
        assert back.drop("file_floor_u").exceptAll(tops.select("lang", "word", "logprob_u")).count() == 0 and back.count() == tops.count()
        assert {r[0] for r in back.select("file_floor_u").distinct().collect()} == {-20_000_000}
    with open(tmp_path / "filesFalse" / "ngrams-en.txt", encoding="utf-8") as f:
        lines = f.read().split("\n")
    assert lines[0].startswith("# 1:") and [x.split(" ")[0] for x in lines[1:4]] == sorted(x.split(" ")[0] for x in lines[1:4])
    # by folder and by prefix, the loaded model says what the tables say
    for n in os.listdir(tmp_path / "filesTrue"):
        if not n.startswith("."):
            os.rename(tmp_path / "filesTrue" / n, tmp_path / f"mine-{n}")
    texts = docs.limit(30)
    want = sorted(map(tuple, detect(texts, M.assemble(grams, tops, registry.LANGS), ["doc_id"]).collect()))
    for path in (str(tmp_path / "filesFalse"), str(tmp_path / "mine-")):
        assert sorted(map(tuple, detect(texts, M.load(spark, path, "en,fr,de,es"), ["doc_id"]).collect())) == want
    M.clear_cache()


def test_floors_of_files(spark, tmp_path):
    """An entry must reach the caller's floor and its file's; the highest of all floors holds for all languages."""
    (tmp_path / "ngrams-en.txt").write_text("# 1:2/100 2:1/50 MinLogProb: -6.0\nab 30\nxy -7.5\nthe -1.0\n")
    (tmp_path / "ngrams-fr.txt").write_text("# 2:2/50 1:0/1 MinLogProb: -9.0\nab -8.0\ncd -9.5\n".replace("# 2:2/50 1:0/1", "# 1:0/1 2:2/50"))
    (tmp_path / "topwords-en.txt").write_text("# Count: 10 MinLogProb: -4.0\nthe 5\na 4\nrare -4.5\n")
    (tmp_path / "skipwords.txt").write_text("# words\n\nhttp\n")
    grams, tops, cj, skips = M.tables_of(spark, str(tmp_path))
    assert cj is None and [r[0] for r in skips.collect()] == ["http"]
    for floor, want_floor, want in ((-12.0, -6.0, {("ab", "en"): -510826, ("ab", "fr"): -6000000}), (-2.0, -2.0, {("ab", "en"): -510826}), (0, -6.0, {("ab", "en"): -510826, ("ab", "fr"): -6000000})):
        m = M.assemble(grams, tops, ["en", "fr"], floor, 0, skips)
        got = {(r["gram"], x["lang"]): x["u"] for r in m.ngrams.collect() for x in r["langs"]}
        assert got == want and m.floor_u == want_floor * 1e6 and m.tw_floor_u == -4_000_000
    assert {r["word"] for r in m.topwords.collect()} == {"the"}
    with pytest.raises(FileNotFoundError):
        M.load(spark, str(tmp_path), "en,fr,de")


def test_models_in_their_homes(spark, tmp_path):
    words = train.training_words(registry.documents(spark, SF))
    M.save(train.ngram_model(train.ngram_counts(words)), train.topword_model(words), str(tmp_path / "a" / "lite"))
    homes = [str(tmp_path / "none"), str(tmp_path / "a")]
    assert M.load_packaged(spark, "en,fr", homes=homes).floor_u == -12_000_000
    with pytest.raises(FileNotFoundError):
        M.load_packaged(spark, "en,fr", "full", homes=homes)
    os.rename(tmp_path / "a" / "lite", tmp_path / "a" / "full")
    assert M.load_packaged(spark, "en,fr", homes=homes).floor_u == -15_000_000
    assert M.load_packaged(spark, "en,fr", "lite", homes=homes).floor_u == -12_000_000
    M.clear_cache()
    told = evaluate.load_benchmark(spark, str(tmp_path / "a" / "full"), "en,fr")
    assert set(told["ngrams"]) == {1, 2, 3, 4, 5} and told["entries"] > 0 and told["bytes"] > 0 and told["readable"][-1] in "KM"
    M.clear_cache()


def test_skipword_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# top\nthe 10\nof 9\n\nand 8\n")
    (tmp_path / "b.txt").write_text("www\n")
    assert {r[0] for r in files.read_skipword_lists(spark, f"{tmp_path}/a.txt/2, {tmp_path}/b.txt").collect()} == {"the", "of", "www"}
    assert {r[0] for r in files.read_skipword_lists(spark, f"{tmp_path}/a.txt").collect()} == {"the", "of", "and"}
    assert files.read_skipword_lists(spark, "").count() == 0


def test_small_files(spark, tmp_path):
    (tmp_path / "skip.txt").write_text("# comment\n\nwww\nhttp\n")
    assert {r[0] for r in files.read_skipwords(spark, str(tmp_path / "skip.txt")).collect()} == {"www", "http"}
    (tmp_path / "ph").mkdir()
    (tmp_path / "ph" / "en.txt").write_text("one phrase\n\n  \nanother\n")
    (tmp_path / "ph" / "zh.txt").write_text("今天\n")
    phrases = files.read_phrases(spark, str(tmp_path / "ph"))
    assert {tuple(r) for r in phrases.collect()} == {("en", "one phrase"), ("en", "another"), ("zh-hans", "今天")}
    either = spark.createDataFrame([("zh-hans", "zh-hant"), ("zh", "zh-hans"), ("ja", "zh-hans"), ("en", "unknown")], "expected string, detected string")
    assert evaluate.accuracy(either).filter("expected IS NULL").select("correct", "total", "skipped").first()[:] == (2, 3, 1)
    xml = "<mediawiki><page><text a='1'>First [[link]] x</text></page><page><text></text></page><page><text b='2'>Second</text></page></mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    dump = str(tmp_path / "d.xml.bz2")
    assert sorted(r[0] for r in files.read_wiki(spark, dump).collect()) == ["First  x", "Second"]
    files.write_wiki(spark, dump, str(tmp_path / "shown"), strip=False)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "shown")).collect()) == ["", "", "First [[link]] x", "Second"]
    both = files.read_labelled(spark, f"{dump}:en,{dump}:german")
    assert sorted(r["lang"] for r in both.collect()) == ["de", "de", "en", "en"] and files.read_labelled(spark, f"{dump}:en,{dump}:de", limit=3).count() == 3


def test_stored_models(spark, tmp_path):
    M.save(*registry.trained(spark, SF), str(tmp_path))
    lite = M.load(spark, str(tmp_path), "es,en,de,French", "lite")
    assert lite.languages == ["en", "fr", "de", "es"] and lite.info().count() == 4
    assert M.load(spark, str(tmp_path), "en,fr,de,es", "lite") is lite
    M.clear_cache()
    assert M.load(spark, str(tmp_path), "en,fr,de,es", "lite") is not lite
    with pytest.raises(FileNotFoundError):
        M.load(spark, str(tmp_path), "efigs", "lite")  # Italian is needed, and there is none
    M.clear_cache()
    assert M.needs_ngrams(["en", "th", "ja"]) == []


def test_streams(spark, tmp_path):
    parts = registry.read(spark, SF, "conversations").select("conv_id", "turn", "text")
    model = registry.model(spark, SF)
    parts.filter("turn < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    parts.filter("turn >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    acc = Accumulator(str(tmp_path / "acc"), model, ["conv_id"], "turn")
    acc.start(stream, str(tmp_path / "cp")).awaitTermination()
    columns = ["conv_id", "detected", "gap", "num_words", "num_chars"]
    want = incremental.detect_merged(parts, model, ["conv_id"], "turn").filter("num_words > 0").select(columns)
    assert sorted(map(tuple, acc.result().select(columns).collect())) == sorted(map(tuple, want.collect()))
    q = word_counts(stream, ["conv_id"], model).writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(words) FROM wc").first()[0] == acc.result().agg(F.sum("num_words")).first()[0]
    before = sorted(map(tuple, acc.result().collect()))
    acc.compact()
    acc.add(parts.filter("turn < 2"), 0)  # a batch that is replayed after compaction counts once
    assert sorted(map(tuple, acc.result().collect())) == before and acc._generations("evidence/epoch") == []
    one = parts.select("conv_id").orderBy("conv_id").limit(1)
    acc.clear(one)
    gone = one.first()[0]
    assert {r["conv_id"] for r in acc.result().collect()} == {r[0] for r in before} - {gone}
    acc.add(spark.createDataFrame([(gone, 99, "the end")], "conv_id long, turn long, text string"), 7)
    acc.compact()
    assert {r["conv_id"]: r["num_words"] for r in acc.result().collect()}[gone] == 2


def test_score_string(spark):
    texts = spark.createDataFrame([(1, "the le")], "doc_id int, text string")
    model = registry._micro(spark, ["en", "fr"])
    rows = score_string(detect_scores(texts, model, ["doc_id"], Params()), ["doc_id"]).collect()
    assert rows[0]["scores"] == "en=-4.300 fr=-5.700" and rows[0]["ratios"] == "en=1.000 fr=0.754"


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 200
