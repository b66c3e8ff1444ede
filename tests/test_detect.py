"""Scoring and decisions on a hand-made model, worked out by hand."""

import pytest

from lingmill.operators import model as M
from lingmill.operators.detect import Params, detect, detect_scores
from lingmill.plans import registry

NGRAMS = [("en", 2, "th", -4.0), ("en", 2, "he", -4.5), ("en", 2, "le", -6.0), ("fr", 2, "le", -3.0), ("en", 3, "the", -5.0)]
TOPWORDS = [("en", "the", -2.5), ("fr", "le", -3.0), ("fr", "l'", -4.0), ("fr", "ami", -7.0)]
#: text, parameters, boosts, detected, total en, total fr, gap, words, chars, lookups
CASES = [
    ("the", {}, {}, "en", -3.0, -12.0, 0.75, 1, 3, 1),
    ("le", {}, {}, "fr", -10.8, -3.0, 0.722222, 1, 2, 1),
    ("l'ami", {}, {}, "fr", -9.6, -4.4, 0.541667, 1, 5, 2),
    ("l'a", {}, {}, "fr", -9.6, -3.2, 0.666667, 1, 3, 1),
    ("http", {}, {}, "unknown", None, None, 1.0, 0, 0, 0),
    ("http", {"topwords": False}, {}, "unknown", 0, 0, 0.0, 1, 4, 0),
    ("http the", {}, {}, "en", -3.0, -12.0, 0.75, 1, 3, 1),
    ("zzz", {}, {}, "unknown", 0, 0, 0.0, 1, 3, 1),
    ("the le", {}, {}, "en", -4.3, -5.7, 0.245614, 2, 5, 2),
    ("the le", {}, {"fr": 0.3}, "fr", -4.3, -3.99, 0.072093, 2, 5, 2),
    ("the le", {"topwords": False}, {}, "en", -5.5, -7.5, 0.266667, 2, 5, 0),
    ("the", {"stop": 2}, {}, "en", -2.9, -12.0, 0.758333, 1, 3, 1),
    ("thex", {}, {}, "en", -4.5, -12.0, 0.625, 1, 4, 1),
    ("", {}, {}, "unknown", None, None, 1.0, 0, 0, 0),
    (None, {}, {}, "unknown", None, None, 1.0, 0, 0, 0),
]


@pytest.fixture(scope="module")
def micro(spark):
    ngrams = spark.createDataFrame([(a, b, c, round(d * 1e6)) for a, b, c, d in NGRAMS], "lang string, n int, gram string, logprob_u long")
    topwords = spark.createDataFrame([(a, b, round(c * 1e6)) for a, b, c in TOPWORDS], "lang string, word string, logprob_u long")
    return M.assemble(ngrams, topwords, ["fr", "en"], max_ngram=3)


@pytest.mark.parametrize("way", ["sent", "joined"])
def test_hand_made_cases(spark, micro, way, monkeypatch):
    if way == "joined":
        monkeypatch.setattr(M, "SENT_ENTRIES", 0)
    kinds = {}
    for k, case in enumerate(CASES):
        kinds.setdefault((tuple(case[1].items()), tuple(case[2].items())), []).append((k, case[0]))
    for (params, boosts), rows in kinds.items():
        texts = spark.createDataFrame(rows, "doc_id long, text string")
        params = Params(**({"max_ngram": 3} | dict(params)))
        got = {r["doc_id"]: r for r in detect(texts, micro, ["doc_id"], params, dict(boosts)).collect()}
        totals = {(r["doc_id"], r["lang"]): r["total"] for r in detect_scores(texts, micro, ["doc_id"], params, dict(boosts)).collect()}
        for k, text in rows:
            _, _, _, detected, en, fr, gap, words, chars, lookups = CASES[k]
            r = got[k]
            assert (r["detected"], r["gap"], r["num_words"], r["num_chars"], r["num_lookups"]) == (detected, pytest.approx(gap, abs=1e-6), words, chars, lookups), text
            assert totals.get((k, "en")) == (None if en is None else pytest.approx(en, abs=1e-6)), text
            assert totals.get((k, "fr")) == (None if fr is None else pytest.approx(fr, abs=1e-6)), text


def test_bad_parameters(spark, micro):
    texts = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    for bad in ({"min_ngram": 0}, {"min_ngram": 4}, {"stop": 4}, {"max_ngram": 5}):
        with pytest.raises(ValueError):
            detect(texts, micro, ["doc_id"], Params(**({"max_ngram": 3} | bad)))


def test_changed_parameters_and_boosts(micro):
    assert Params().changed(5, stop=2) == (Params(stop=2), True) and Params().changed(3, stop=2) == (Params(), False)
    assert micro.boosts({"french": 0.3, "de": 1.0}) == micro.boosts("FR", 0.3) == {"fr": 0.3} and micro.boosts("en", 1, "fra", 2) == {"en": 1.0, "fr": 2.0}


def _empty(spark, languages):
    ngrams = spark.createDataFrame([], "lang string, n int, gram string, logprob_u long")
    topwords = spark.createDataFrame([], "lang string, word string, logprob_u long")
    return M.assemble(ngrams, topwords, languages)


def test_unique_scripts_need_no_tables(spark):
    model = _empty(spark, "en ja ar hy bn ka el gu he hi pa si ta te th am ml kn km lo my".split())
    rows = [("hello", "en"), ("事務所", "ja"), ("مرحبًا", "ar"), ("բարև", "hy"), ("Γειά σου", "el"), ("שלום", "he"), ("नमस्ते", "hi"), ("สวัสดี", "th"), ("வணக்கம்", "ta"), ("გამარჯობა", "ka")]
    texts = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(rows)], "doc_id long, text string, want string")
    for r in detect(texts, model, ["doc_id"], keep=["want"]).collect():
        assert (r["detected"], r["gap"]) == (r["want"], 1.0)


def test_mixed_scripts(spark):
    model = _empty(spark, "en fr de es el ru zh-hans zh-hant ja ko".split())
    rows = [("He likes to say привет", 5, 18, "LATIN"), ("我的名字是Jonathan", 2, 13, "HAN"), ("I like the characters 羊驼", 5, 20, "LATIN")]
    texts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, w int, c int, p string")
    for r in detect(texts, model, ["doc_id"], keep=["w", "c", "p"]).collect():
        assert (r["num_words"], r["num_chars"], r["pred"]) == (r["w"], r["c"], r["p"])


def test_forget_lets_go_of_all_that_is_held(spark):
    registry.forget()
    sf = "/root/testdata/sf0.001"
    registry.QUERIES["phrase_eval"](spark, sf)
    held = [*registry.trained(spark, sf), registry.half_model(spark, sf, 0).ngrams, registry.half_model(spark, sf, 1).topwords]
    assert all(df.storageLevel.useMemory for df in held)
    registry.forget()
    assert not registry._tables and not any(df.storageLevel.useMemory for df in held)
