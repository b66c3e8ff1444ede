"""Commands and SQL functions, end to end on small files."""

import os

import pytest
from pyspark.sql import functions as F

from lingmill import __main__ as commands
from lingmill.functions import text as T
from lingmill.operators import incremental
from lingmill.operators.detect import Params, detect
from lingmill.plans import registry, sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dumps(spark, tmp_path_factory):
    """A dump for each of two languages."""
    folder, docs = tmp_path_factory.mktemp("dumps"), registry.documents(spark, SF)
    for lang in ("en", "fr"):
        pages = docs.filter(F.col("lang") == lang).select("doc_id", F.struct("text").alias("revision"))
        pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("compression", "gzip").save(f"{folder}/{lang}")
    return folder


def test_from_dumps_to_detections(spark, dumps, tmp_path, capsys):
    spec, out, small = f"{dumps}/en:en,{dumps}/fr:french", str(tmp_path / "model"), str(tmp_path / "small")
    commands.main(["ngrams", "--infiles", spec, "--out", out, "--gzip"])
    assert {f for f in os.listdir(out) if not f.startswith(".")} == {f"{k}-{x}.txt.gz" for k in ("ngrams", "topwords") for x in ("en", "fr")}
    commands.main(["reducengrams", "--model", out, "--out", small, "--min-log-prob", "-9", "--max-ngram", "4"])
    commands.main(["reducetopwords", "--model", out, "--out", small, "--tw-min-log-prob", "-9"])
    with open(f"{small}/ngrams-en.txt", encoding="utf-8") as f:
        rows = [x.rsplit(" ", 1)[0] for x in f.read().strip().split("\n")[1:]]
    assert rows and all(len(g) <= 4 and not (len(g) == 1 and g.isascii()) for g in rows)
    with open(f"{small}/topwords-fr.txt", encoding="utf-8") as f:
        values = [float(x.rsplit(" ", 1)[1]) for x in f.read().strip().split("\n")[1:]]
    assert values == sorted(values, reverse=True) and values[-1] >= -9
    capsys.readouterr()
    commands.main(["adhoc", "--model", small, "--languages", "en,fr", "--phrase", "le les des une dans", "--boosts", "fr=0.1"])
    assert "|fr" in capsys.readouterr().out
    (tmp_path / "ph").mkdir()
    (tmp_path / "ph" / "fr.txt").write_text("les des une dans\n\nthe and\n")
    commands.main(["phraseeval", "--model", small, "--languages", "en,fr", "--infile", str(tmp_path / "ph"), "--show-misses", "--remove-accents"])
    assert "the and" in capsys.readouterr().out
    commands.main(["wikieval", "--model", small, "--languages", "en,fr", "--infiles", spec, "--limit", "20", "--show-misses"])
    assert "chunks" in capsys.readouterr().out
    commands.main(["topwordoverlap", "--model", out, "--languages", "en,fr"])
    commands.main(["loadmodelspeed", "--model", small, "--languages", "en,fr"])
    commands.main(["detectspeed", "--model", small, "--languages", "en,fr", "--infiles", spec, "--rounds", "1"])
    assert "words_per_s" in capsys.readouterr().out
    commands.main(["showlanguages", "--alphabet", "cyrillic"])
    assert capsys.readouterr().out.strip() == "be bg mk mn ru sr uk"
    commands.main(["showwiki", "--infile", f"{dumps}/en", "--outfile", str(tmp_path / "shown"), "--no-markup"])
    assert spark.read.text(str(tmp_path / "shown")).count() > 0
    with pytest.raises(SystemExit):
        commands.main(["showlanguages", "--alphabet", "runes"])


def test_training_in_another_script(spark, tmp_path):
    pages = spark.createDataFrame([("Привет мир, это текст cat " * 3,), ("Это мир",)], "text string").select(F.struct("text").alias("revision"))
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(str(tmp_path / "ru"))
    (tmp_path / "skip.txt").write_text("мир 5\nэто 3\n")
    commands.main(["ngrams", "--infiles", f"{tmp_path}/ru:ru", "--out", str(tmp_path / "m"), "--alphabet", "cyrillic", "--skipwords", f"{tmp_path}/skip.txt/1"])
    with open(tmp_path / "m" / "topwords-ru.txt", encoding="utf-8") as f:
        assert [x.rsplit(" ", 1)[0] for x in f.read().strip().split("\n")[1:]] == ["это", "привет", "текст"]


def test_sql_functions(spark):
    model = registry.model(spark, SF)
    sql.register(spark, model, suffix="_t")
    turns = registry.read(spark, SF, "conversations").select("conv_id", "turn", "text")
    turns.union(spark.createDataFrame([(-1, 0, None), (-2, 0, "12 --")], "conv_id long, turn long, text string")).createOrReplaceTempView("turns_t")
    columns = ["detected", "gap", "num_words", "num_chars", "num_lookups", "pred"]
    got = spark.sql("SELECT conv_id, turn, r.* FROM (SELECT conv_id, turn, detect_result_t(text) AS r FROM turns_t)")
    want = detect(spark.table("turns_t"), model, ["conv_id", "turn"])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select("conv_id", "turn", *columns).collect()))
    merged = spark.sql(f"SELECT conv_id, r.* FROM (SELECT conv_id, decide_evidence_t({spark.conf.get('lingmill.added_t')}) AS r FROM (SELECT conv_id, language_evidence_t(text) AS ev FROM turns_t) GROUP BY conv_id)")
    want = incremental.detect_merged(spark.table("turns_t"), model, ["conv_id"], "turn")
    assert sorted(map(key, merged.collect())) == sorted(map(key, want.select("conv_id", *columns).collect()))
    one = spark.sql("SELECT detect_language_t('the and of'), detect_language_with_t('zzz the', 'german', 5.0), detect_language_with_t('the', null, null), strip_markup_t('a [[b]] c'), accents_removed_t('Straße é')").first()
    assert one[0] == "en" and one[1] == "de" and one[2] == "en" and one[3] == "a  c" and one[4] == "Strasse e"
    assert spark.table("model_languages_t").count() == 4 and spark.table("languages_t").count() == 84
    assert spark.range(1).select(T.remove_accents(F.lit("é"))).first()[0] == "e"
    with pytest.raises(ValueError):
        sql.register(spark, model, Params(4, 3, 2), suffix="_u")
