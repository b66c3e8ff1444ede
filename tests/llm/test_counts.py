"""Token counts, quality, mixing, sharding."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingmill.llm import mixing, quality, queries, sharding, tokens

from .conftest import SF, texts_of


def greedy(word, starts, inner):
    """Longest-match pieces, one after the other."""
    i = n = 0
    pieces = starts
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), 0)
        if not j:
            return 1
        i, n, pieces = j, n + 1, inner
    return n


def test_automaton_counts_what_longest_match_makes():
    r = random.Random(1)
    some = lambda: {bytes(r.choice(b"abc") for _ in range(r.randint(1, 4))) for _ in range(4)}
    for _ in range(1500):
        starts, inner = some(), some()
        two, one = tokens.Automaton(sorted(starts), sorted(inner)), tokens.Automaton(sorted(starts))
        for _ in range(5):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(0, 8)))
            assert two.count(word) == greedy(word, starts, inner) and one.count(word) == greedy(word, starts, starts)


def test_token_counts(spark, messy, empty):
    vocabulary = set(tokens.load_vocabulary())
    rows = tokens.count_tokens(messy)
    want = []
    for i, t in texts_of(messy):
        words = (t or "").encode().split()
        want.append((str(i), len((t or "").encode()), len(words), sum(greedy(b" " + w, vocabulary, vocabulary) for w in words)))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_words"], r["n_tokens"]) for r in rows.collect()) == sorted(want)
    assert tokens.count_tokens(empty).count() == 0
    docs = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    want = sorted((i, len(t.encode()), len(t.split()), sum(greedy(b" " + w, vocabulary, vocabulary) for w in t.encode().split())) for i, t in docs)
    assert sorted(map(tuple, queries.QUERIES["op2_token_counts"](spark, SF).collect())) == want
    held = tokens.Counts(tokens.Automaton([b"a"]), b"")
    assert held[b"a" * 1000] == 1000 and len(held) == 0


def test_quality(spark, messy, empty):
    r = random.Random(2)
    words = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [r.choice(words) for _ in range(r.randint(8, 60))]
        kind = i % 5
        if kind == 0:
            text = [x for w in text[:10] for x in [w] * 8]
        if kind == 1:
            text[r.randrange(len(text))] = "awful"
        rows.append((i, " ".join(text)))
        if i < 700:
            labels.append((i, int(kind != 0), int(kind == 1)))
    labels += [(None, 1, 0), (5, None, 1), (6, 1, None), (10**9, 0, 0), labels[0]]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.grade_documents(docs, marks).collect()}
    right = [got[i]["keep"] == (i % 5 > 1) for i in range(700, 900)]
    assert sum(right) >= 190 and all(x["p_ge1"] >= x["p_ge2"] for x in got.values())
    kept = quality.grade_documents(docs, marks, carry=True)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["keep"]}
    assert sorted(map(tuple, quality.grade_documents(docs, marks).collect())) == sorted(map(tuple, got.values()))
    assert quality.grade_documents(messy, marks).count() == messy.count()
    assert quality.grade_documents(messy, marks, carry=True).columns == messy.columns
    assert quality.grade_documents(empty, marks).count() == 0
    assert quality.grade_documents(messy, marks.limit(0), carry=True).count() == messy.count()


def test_sample_takes_each_text_of_an_id_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, grades: seen.append([tuple(x) for x in rows]))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)], "doc_id long, quality int, toxic int")
    one_each = [(i, f"text{i}") for i in range(1, 11)]
    for more, n in (([(1, "text1")] * 500, 10), ([(1, f"other{i}") for i in range(500)], 20)):
        docs = spark.createDataFrame(more + one_each, "doc_id long, text string").repartition(3)
        quality.train(docs, labels, sample=10)
        assert len(seen[-1]) == len(set(seen[-1])) == n
        wanted = {tuple(quality.features(t.encode(), quality.Buckets())) for i, t in one_each if i > 1}
        assert wanted <= set(seen[-1])


def test_probabilities_and_decisions(spark, messy, monkeypatch):
    """Recomputed from weights and thresholds, text by text; at p = 1/2 a document stays; very long texts are read whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights, cuts = quality.train(docs, labels)
    monkeypatch.setattr(quality, "train", lambda *a: (weights, cuts))
    extra = [(-1, "word " * 300_000 + " ".join(t for _, t in texts_of(docs)[:5])), (-2, None), (-3, "")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    for g in quality.grade_documents(rows, labels).join(rows, "doc_id").collect():
        score = float(weights[quality.features((g["text"] or "").encode(), quality.Buckets())].sum(dtype=np.float64))
        tail = [1 - 1 / (1 + math.exp(-max(-40, min(40, c - score)))) for c in cuts]
        assert abs(g["p_ge1"] - tail[0]) < 2e-6 and abs(g["p_ge2"] - tail[1]) < 2e-6 and abs(g["expected_grade"] - sum(tail)) < 3e-6
        assert g["keep"] == (tail[1] >= 0.5) or abs(tail[1] - 0.5) < 1e-9
    monkeypatch.setattr(quality, "train", lambda *a: (np.zeros(1 << quality.BITS, dtype=np.float32), np.array([-1.0, 0.0])))
    assert all(r["keep"] and r["p_ge2"] == 0.5 for r in quality.grade_documents(messy, labels).collect())
    assert quality.grade_documents(messy, labels, carry=True).count() == messy.count()


def test_gradient():
    r = np.random.default_rng(5)
    n, dim = 60, 12
    docs = np.repeat(np.arange(n), 4)
    flat, grades = r.integers(0, dim, 4 * n), r.integers(0, 3, n)
    p = np.concatenate([r.normal(size=dim), [-0.5, 0.3]])
    _, g = quality.likelihood(p, flat, docs, grades, dim)
    for i in range(len(p)):
        step = np.zeros_like(p)
        step[i] = 1e-6
        numeric = (quality.likelihood(p + step, flat, docs, grades, dim)[0] - quality.likelihood(p - step, flat, docs, grades, dim)[0]) / 2e-6
        assert abs(numeric - g[i]) < 1e-7
    # likelihood by its definition
    cuts = [-math.inf, *quality.thresholds(p, dim), math.inf]
    cdf = lambda x: 0.0 if x == -math.inf else 1.0 if x == math.inf else 1 / (1 + math.exp(-x))
    scores = [sum(p[f] for f, d in zip(flat, docs, strict=True) if d == i) for i in range(n)]
    want = -sum(math.log(cdf(cuts[k + 1] - s) - cdf(cuts[k] - s)) for k, s in zip(grades, scores, strict=True)) / n
    assert abs(quality.likelihood(p, flat, docs, grades, dim)[0] - want) < 1e-12


def test_ordered_fit():
    rows = [np.array([k], dtype=np.int32) for k in (0, 1, 2) for _ in range(60)]
    weights, cuts = quality.fit(rows, np.repeat([0, 1, 2], 60))
    assert cuts[0] < cuts[1] and weights[0] < weights[1] < weights[2]


def words_in(text):
    return len([w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w])


def targets(sizes, share=1.5, most=2.0):
    """Sharing out by weight, the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: most * sizes[s] for s in over}


def test_mix(spark, messy, empty):
    for docs in (messy, spark.read.parquet(f"{SF}/documents.parquet")):
        sizes, got, largest = defaultdict(int), mixing.mix(docs, carry=True).select("*", "row.source", "row.text").collect(), defaultdict(int)
        for r in got:
            assert r["size"] == words_in(r["text"]) and r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
            sizes[r["source"]] += r["size"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        want, taken = targets(dict(sizes)), Counter()
        for r in got:
            taken[r["source"]] += r["taken"]
            assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        for s, t in want.items():
            assert abs(taken[s] - t) <= max(0.02 * t, largest[s] / 2), (s, taken[s], t)  # a copy is never cut: a small source may miss by half of one
        again = mixing.mix(docs).select("doc_id", "size", "taken")
        key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
        assert sorted(map(key, again.collect())) == sorted(map(key, got))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).columns == empty.columns
    rows = mixing.mixed_rows(messy)
    assert rows.columns == messy.columns and rows.count() == mixing.mix(messy).agg(F.sum("copies")).first()[0]


def test_mix_of_many_and_odd_sources(spark, monkeypatch):
    """Sources of one long document, of nothing but empty texts, of equal texts; more targets than steps are an error."""
    rows = [(i, "w " * (1 + i % 7), f"s{i % 40:02d}") for i in range(1200)] + [(5000, "w " * 30_000, "long"), (5001, "w", "long")] + [(6000 + i, ["", None][i % 2], "none") for i in range(20)] + [(7000 + i, "same text", "same") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sources, sizes, taken = {i: s for i, _, s in rows}, defaultdict(int), defaultdict(int)
    for g in got:
        sizes[sources[g["doc_id"]]] += g["size"]
        taken[sources[g["doc_id"]]] += g["taken"]
    want = targets(dict(sizes))
    largest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in want}
    assert all(abs(taken[s] - t) <= max(1, largest[s] / 2) for s, t in want.items()) and all(g["copies"] == 1 for g in got if not g["size"])
    by = defaultdict(set)
    for g in got:
        by[sources[g["doc_id"]], g["size"]].add(g["copies"])
    assert all(max(c) - min(c) <= 1 for c in by.values())
    again = mixing.mix(docs.repartition(7).orderBy(F.rand(3)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    with pytest.raises(RuntimeError):
        mixing.with_duals(mixing.with_targets(docs.groupBy(F.lit(False).alias("no_source"), "source").agg(F.sum(F.length("text")).alias("source_size"), F.count("*").alias("n_docs")), 1.5, 2.0), docs.groupBy(F.lit(False).alias("no_source"), "source", F.length("text").cast("long").alias("size")).agg(F.count("*").alias("n")).filter("size > 0"), 2.0, steps=1)
    with pytest.raises(ValueError):
        mixing.mix(docs, most=1.5)


def test_permutation_in_the_plan(spark):
    """The permutation of the plan is the one that Python makes by the same rule, cycle walking included."""
    for n, seed in ((1, 11), (2, 11), (97, 3), (1000, 11), (10_001, 5)):
        a, keys = max(1, math.isqrt(n - 1) + 1), sharding.round_keys(seed)

        def once(x, a=a, keys=keys):
            left, right = divmod(x, a)
            for k in keys:
                t = (right * 48271 + k) % sharding.PRIME
                left, right = right, (left + (t * t + k * 7 + 3) % sharding.PRIME) % a
            return left * a + right

        want = []
        for x in range(n):
            y = once(x)
            while y >= n:
                y = once(y)
            want.append(y)
        assert [r[0] for r in spark.range(n).orderBy("id").select(sharding.permuted("id", n, seed)).collect()] == want


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 17, 100, 1000, 4097):
        a, keys = max(1, math.isqrt(n - 1) + 1), sharding.round_keys(11)

        def step(x, a=a, keys=keys):
            left, right = divmod(x, a)
            for k in keys:
                t = (right * 48271 + k) % sharding.PRIME
                left, right = right, (left + (t * t + k * 7 + 3) % sharding.PRIME) % a
            return left * a + right

        out = []
        for x in range(n):
            y, walks = step(x), 0
            while y >= n:
                y, walks = step(y), walks + 1
            assert walks <= sharding.STEPS
            out.append(y)
        assert sorted(out) == list(range(n))


def test_shards(spark, messy, empty):
    for docs in (messy, spark.read.parquet(f"{SF}/documents.parquet"), messy.limit(1)):
        got = sharding.shard(docs).collect()
        n = len(got)
        assert n == docs.count() and sorted(r["row_no"] for r in got) == list(range(n))
        assert sorted(16 * r["slot"] + r["shard"] for r in got) == list(range(n))
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts_of(docs))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        if n > 100:
            assert sharding.shard(docs.repartition(5)).select("doc_id", "size", "shard", "slot").exceptAll(sharding.shard(docs).select("doc_id", "size", "shard", "slot")).count() == 0
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(messy, carry=True).select("row.*").columns == messy.columns
