"""Catalogue, tokenizers, cleaning."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lingmill.functions import catalog
from lingmill.functions import text as T
from lingmill.operators import scoring, train
from lingmill.operators.detect import Params
from lingmill.plans import registry


def test_catalogue():
    assert len(catalog.LANGUAGES) == 84 and len(catalog.ALPHABETS) == 24 and len(catalog.GROUPS) == 16
    assert catalog.parse_language("English") == catalog.parse_language(" EN ") == catalog.parse_language("eng") == "en"
    assert catalog.parse_language("zh-TW") == "zh-hant" and catalog.parse_language("nb") == "no" and catalog.parse_language("klingon") == "unknown"
    assert len(catalog.parse_languages("efigs,en")) == 6 and len(catalog.parse_languages("nordic,ja")) == 5
    with pytest.raises(ValueError):
        catalog.parse_languages("en,nothing")
    assert {"th", "el", "ko", "my"} <= set(catalog.GROUPS["unique_alphabet"]) and len(catalog.GROUPS["unique_alphabet"]) == 18
    assert not {"en", "ar", "zh-hans", "ja"} & set(catalog.GROUPS["unique_alphabet"])
    assert [len(catalog.GROUPS[g]) for g in ("europe_west_common", "europe_east_latin", "europe_common", "europe_latin")] == [11, 11, 28, 30]
    assert catalog.is_equivalent("zh-hans", "zh-hant") and not catalog.is_equivalent("en", "fr")


def words(spark, texts, alphabets):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.posexplode(T.chunks(F.col("text"), alphabets)).alias("k", "c"))
    rows = rows.withColumn("s", T.script_of(F.col("c"), alphabets)).select("i", "k", F.posexplode(T.detection_words(F.col("c"), F.col("s"))).alias("j", "w"))
    out = [[] for _ in texts]
    for r in rows.orderBy("i", "k", "j").collect():
        out[r["i"]].append(r["w"])
    return out


CASES = {
    "": [], "   ": [], "---...!!!": [], "12345": [], "hello---world": ["hello", "world"], "Hello WORLD FoO": ["hello", "world", "foo"], "don't": ["don't"], "don’t": ["don't"], "don\u0092t": ["don't"],
    "dogs' ": ["dogs"], "don''t": ["don", "t"], "abc123def": [], "hello 42world": ["hello"], "12'abc": ["abc"], "helloАworld": ["hello", "world"], "x" * 70: ["x" * 64],
}


def test_detection_words(spark):
    assert words(spark, list(CASES), ["LATIN"]) == list(CASES.values())
    assert words(spark, ["hello一", "あい一二", "123一二", "一" * 300], ["LATIN", "HAN", "JA_KANA"]) == [["hello", "一"], ["あい", "一二"], ["一二"], ["一" * 256, "一" * 44]]


def machine(text):
    """The rules of the Latin tokenizer, a character at a time."""
    out, word, digit, was_open = [], "", False, False

    def emit():
        nonlocal word, digit
        w = word[:64].rstrip("'") if word.endswith("'") else word[:64]
        if word and not digit:
            out.append(w.lower())
        word, digit = "", False

    for c in text:
        if c.isalpha():
            word += c
        elif c in "0123456789":
            digit = True
        elif c == "'" and word and not word.endswith("'"):
            word += "'"
        else:
            emit()
    emit()
    return [w for w in out if w]


def test_random_texts_against_a_state_machine(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abZ''1 -") for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for t, got in zip(texts, words(spark, texts, ["LATIN"]), strict=True):
        assert got == machine(t), t


def test_long_numbers_take_linear_time(spark):
    rows = spark.createDataFrame([(1, "1" * 300_000 + " a12b 12'abc 7x")], "i int, text string")
    assert rows.select(T.chunks(F.col("text"), ["LATIN"]).alias("c")).first()[0] == ["a12b", "abc", "7x"]
    assert re.compile(scoring.piece_pattern(["LATIN"])).findall("1" * 300_000 + " a12b 12'abc 7x") == ["a12b", "abc", "7x"]


def test_pieces_and_words_are_those_of_the_plan(spark):
    """The pattern and rules of scoring find what the DataFrame functions find."""
    scripts = ["LATIN", "HAN", "JA_KANA", "CYRILLIC", "GREEK"]
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "É", "İ", "'", "’", "1", " ", "漢", "字", "か", "ナ", "д", "Ж", "ω", "-", "9"]) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["漢" * 600, "x" * 200]
    found, pattern = words(spark, texts, scripts), re.compile(scoring.piece_pattern(scripts))
    one = [re.compile(f"[{scoring.letters(a)}]") for a in scripts]
    for text, want in zip(texts, found, strict=True):
        assert [w for p in pattern.findall(text) for w in scoring.Pieces.words(p, next(a for a, x in zip(scripts, one, strict=True) if x.search(p)))] == want, text


def test_training_words(spark):
    more = spark.createDataFrame([("ru", "Привет cat мир-мир"), ("zz", "one мир"), ("ja", "日本 x"), ("am", "ሰላም")], "lang string, text string")
    got = sorted((r["lang"], r["word"], r["cnt"]) for r in train.training_words(more).collect())
    assert got == [("am", "ሰላም", 1), ("ru", "мир", 2), ("ru", "привет", 1), ("zz", "one", 1)]
    assert [r["word"] for r in train.training_words(more, ["CYRILLIC"], skipwords=spark.createDataFrame([("мир",)], "word string")).collect()] == ["привет"]
    rows = spark.createDataFrame([("en", "The cat, sat."), ("de", "hello abc123 "), ("fr", "dogs' bones"), ("es", "a'b'c"), ("en", None), (None, "x")], "lang string, text string")
    got = sorted((r["lang"], r["word"], r["cnt"]) for r in train.training_words(rows).collect())
    assert got == [("de", "hello", 1), ("en", "cat", 1), ("en", "sat", 1), ("en", "the", 1), ("fr", "bones", 1), ("fr", "dogs", 1)]


def test_cleaning(spark):
    rows = ["café naïve über résumé", "æ œ ß ﬀ ﬁ ﬂ ﬃ Straße", "漢字", "É", "plain", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(T.remove_accents(F.col("t"))).collect()]
    assert got == ["cafe naive uber resume", "ae oe ss ff fi fl ffi Strasse", "漢字", "É", "plain", None]
    for text, clean in registry.MARKUP:
        assert T.strip_markup(text) == clean, text
    for text, clean in (("see https://", "see https://"), ("http:// x", " x"), ("&é; &x", "&é; &x"), ("a <b\nc> d", "a \nc> d"), ("{{a\n}}|b", "|b"), ("|x", ""), ("{|{|a|}|}b", "b"), ("<" * 100_000, ""), ("&a" * 100_000, "&a" * 100_000)):
        assert T.strip_markup(text) == clean, text[:20]
    sizes = [0, 512, 1024, 1536, 1 << 20]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(T.human_bytes(F.col("n"))).collect()] == ["0B", "512B", "1.0K", "1.5K", "1.0M"]


def test_markup_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    assert sorted(map(tuple, registry.QUERIES["wiki_markup_pages"](spark, sf).collect())) == sorted((r["page_id"], T.strip_markup(r["html"])) for r in rows)


def test_texts_of_detect_cyrillic_are_read_twice(spark, monkeypatch):
    """Once to train and once to detect, whatever is made of the words and however many files are written."""
    sf, read, of = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0), registry.cyrillic
    texts = of(spark, sf)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(registry, "cyrillic", lambda *a: texts.mapInArrow(counted, texts.schema))
    registry.forget()
    rows = registry.QUERIES["detect_cyrillic"](spark, sf).collect()
    registry.forget()
    assert len(rows) == texts.count() and read.value == 2 * len(rows)


def test_tiles_say_what_words_say_one_by_one():
    facts = scoring.Facts(("bg", "ru"), ("CYRILLIC",), -12_000_000, -12_000_000, False)
    grams = {g: tuple((i, -1000 * len(g) - 7 * i - ord(g[-1])) for i in range(2) if (ord(g[0]) + i) % 3) for w in ("привет", "мир", "при'вет", "ёж") for n in range(1, 6) for g in (w[i : i + n] for i in range(len(w) - n + 1))}
    tables = {"grams": {g: e for g, e in grams.items() if e}, "tops": {"мир": ((1, -5),)}, "skips": {"ёж"}, "cj": {}}
    texts = ["Привет, мир! ПРИ’ВЕТ 12мир", "ёж я", "щщщщ мирмирмир " + "при" * 40, "", None, "я", "'п'р' мир'"]
    for params in (Params(), Params(2, 3, 4), Params(1, 1, 1), Params(1, 5, 5), Params(topwords=False)):
        at_once, single = scoring.Pieces(facts, tables, params), scoring.Pieces(facts, tables, params)
        assert at_once.tiles.fits
        single.tiles.fits = False
        assert (at_once.sums(texts) == single.sums(texts)).all()


def test_a_tally_taken_often_counts_the_same():
    texts = [("ru", "Привет мир МИР 1мир ми٣р об'ект об’ект а'б'в мир' İ"), ("xx", "The the don't abc1 İx"), ("ru", "мир abc"), ("zh-hans", "中文 abc")]
    whole, often, added = train.Tally(("LATIN", "CYRILLIC")), train.Tally(("LATIN", "CYRILLIC")), {}
    rows = lambda tally: [(r["lang"], r["word"], r["cnt"]) for r in tally.taken().to_pylist()]
    for lang, text in texts:
        whole.add(lang, text)
        often.add(lang, text)
        for x, w, n in rows(often):
            added[x, w] = added.get((x, w), 0) + n
    assert added == {(x, w): n for x, w, n in rows(whole)} == {("ru", "привет"): 1, ("ru", "мир"): 4, ("ru", "об'ект"): 2, ("xx", "the"): 2, ("xx", "don't"): 1, ("xx", "ix"): 1}
    assert not whole.full and train.Tally(("CYRILLIC",)).alphabet("en") is None
