"""Jaccard join, neighbours, decontamination and the pipeline, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lingmill.llm import decontaminate, jaccard, mixing, neighbours, quality, queries

from .conftest import SF, texts_of


def sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(texts, percent=75):
    """(id, set size, smallest id of the component, links) of each row, all pairs compared."""
    s = [sets(t) for _, t in texts]
    up, links = list(range(len(s))), [0] * len(s)

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            o = len(s[i] & s[j])
            if o and 100 * o >= percent * len(s[i] | s[j]):
                up[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s[k]), least.get(find(k), i), links[k]) for k, (i, _) in enumerate(texts)]


def same(spark, texts, docs=None):
    docs = spark.createDataFrame(texts, "doc_id long, text string") if docs is None else docs
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in jaccard.join(docs).collect())
    assert got == sorted((str(a), b, str(c), d) for a, b, c, d in classes(texts))


def test_join_on_messy_rows(spark, messy, empty):
    same(spark, texts_of(messy), messy)
    assert jaccard.join(empty).count() == 0
    kept = jaccard.distinct_rows(messy)
    assert kept.columns == messy.columns and jaccard.distinct_rows(empty).count() == 0
    found = {(str(i), c) for i, n, c, _ in classes(texts_of(messy)) if n}
    rows = messy.collect()
    want = []
    for c in {c for _, c in found}:
        want.append(next(r for r in rows if r["doc_id"] == c))
    want += [r for r in rows if not sets(r["text"])]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want))
    twice = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (2, "A b c", "x")], "doc_id long, text string, source string")
    again = [jaccard.distinct_rows(twice.repartition(n)).collect() for n in (1, 2, 3)]
    assert len(again[0]) == 1 and again[0] == again[1] == again[2]


def test_join_families(spark):
    """Copies, chains of ever more edits, families around a text, texts at the very threshold, and a passage that many share."""
    r = random.Random(3)
    words = ["w%d" % i for i in range(2000)]
    draw = lambda n: [r.choice(words) for _ in range(n)]
    texts, common = [], draw(60)
    for _ in range(12):
        base = draw(r.randint(20, 120))
        texts += [base] * r.randint(1, 6)
        for _ in range(r.randint(0, 12)):
            x = list(base)
            for _ in range(r.randint(1, 3)):
                x[r.randrange(len(x))] = r.choice(words)
            texts.append(x)
        for _ in range(6):
            base = base[2:] + draw(2)
            texts.append(base)
    texts += [common + draw(r.randint(5, 40)) for _ in range(60)]
    edge = draw(11)
    texts += [edge, edge[:-1] + ["q"], edge + ["q"], edge + ["q", "r"], edge + ["q", "r", "s"], edge[:5], edge[:6], edge[:7], edge[:8], edge[:4], edge[:4]]
    r.shuffle(texts)
    same(spark, [(1000 - i, " ".join(t)) for i, t in enumerate(texts)])


def test_links_by_blocks(spark, monkeypatch):
    """A component larger than a block."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 7)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(jaccard, "TOGETHER", 5)
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        x = list(base)
        for _ in range(i % 4):
            x[r.randrange(60)] = f"x{i}"
        texts.append((i, " ".join(x)))
    texts += [(100 + i, " ".join(f"y{j}" for j in range(i % 3, 20))) for i in range(9)]
    same(spark, texts)


def test_join_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(spark, texts_of(docs), docs)


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16)).round(2)
    x[200:500] = x[200]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    bad = [None, [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0] * 3, []]
    rows += [(2000 + i, v, "b") for i, v in enumerate(bad)] + [(None, x[3].tolist(), "c"), rows[100], rows[100]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string")
    got = defaultdict(list)
    for g in neighbours.search(vectors).collect():
        got[g["query_id"]].append((g["rank"], g["score"], g["vec_id"]))
    assert set(got) == set(range(0, 1500, 100))
    ids = [*range(1500), 100, 100]
    hits = 0
    for i, found in got.items():
        d = [(float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in ids if j != i]
        want = sorted(d)[:10]
        assert [f[0] for f in sorted(found)] == list(range(1, 11)) and all((f[1], f[2]) in d for f in found)
        assert sorted(found) == sorted(found, key=lambda f: (f[1], f[2]))
        hits += len({j for _, j in want} & {f[2] for f in found})
    assert hits >= 0.9 * 10 * len(got)
    few = neighbours.search(vectors.filter("vec_id IN (0, 5, 7)")).collect()
    assert sorted(f["vec_id"] for f in few) == [5, 7] and neighbours.search(vectors.limit(0)).count() == 0


def test_blocks_of_a_hot_leaf(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 64)
    monkeypatch.setattr(neighbours, "QUERIES", 2)
    rows = [(i, [1.0, 2.0]) for i in range(1200)] + [(5000, [1.5, 2.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = defaultdict(list)
    for g in sorted(got, key=lambda g: g["rank"]):
        by[g["query_id"]].append(g["vec_id"])
    assert by[300] == list(range(10)) and by[0] == list(range(1, 11)) and by[5000] == list(range(10))


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = r.integers(0, 5, r.integers(1, 15)), r.integers(0, 5, r.integers(1, 30))
        assert decontaminate.align(a, b)[0] == smith_waterman(a, b)


def leak_fixture(seed=5):
    r = random.Random(seed)
    words = ["v%d" % i for i in range(3000)] + ["the", "of", "and"] * 400
    draw = lambda n: [r.choice(words) for _ in range(n)]
    items = [draw(r.randint(12, 50)) for _ in range(25)]
    docs, planted = [], set()
    for i in range(250):
        text = draw(r.randint(0, 200))
        if i % 5 == 0:
            k = r.randrange(25)
            leak = list(items[k])
            for _ in range(len(leak) * (i % 3) // 10):  # none, a tenth or a fifth edited
                leak[r.randrange(len(leak))] = r.choice(words)
            at = r.randint(0, len(text))
            text[at:at] = [w.upper() + "," for w in leak]
            planted.add((i, k))
        docs.append((i, " ".join(text)))
    return items, docs, planted


def test_leaks(spark, messy, empty):
    items, docs, planted = leak_fixture()
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(98, None), (99, " .. ")], "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.find_leaks(rows, bench).collect()
    assert {(g["doc_id"], g["item_id"]) for g in got} == planted
    plain = lambda t: [decontaminate.plain(w.encode()) for w in t.split()]
    for g in got:
        text, item = plain(dict(docs)[g["doc_id"]]), [w.encode() for w in items[g["item_id"]]]
        assert round(smith_waterman(item, text) / 2 / len(item), 6) == g["score"]
        assert smith_waterman(item, text[g["first_word"] : g["end_word"]]) == smith_waterman(item, text)
    blocks = decontaminate.BLOCK_ITEMS
    try:
        decontaminate.BLOCK_ITEMS = 10
        assert {(g["doc_id"], g["item_id"]) for g in decontaminate.find_leaks(rows, bench).collect()} == planted
    finally:
        decontaminate.BLOCK_ITEMS = blocks
    left = decontaminate.clean_rows(rows, bench)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in planted}
    assert decontaminate.clean_rows(messy, bench).columns == messy.columns and decontaminate.clean_rows(messy, bench).count() == messy.count()
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(messy, bench.limit(0)).count() == 0


def rows_of(df):
    return Counter(map(str, df.collect()))


def test_stages_on_messy_and_empty_rows(spark, messy, empty):
    """What each stage makes of nulls, empty and very long texts, ties, repeated rows and clashing columns; and of no rows."""
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, empty, SF).count() == 0 and set(empty.columns) <= set(stage(spark, empty, SF).columns), name
    all_rows = messy.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = Counter((r["doc_id"], r["p_ge2"]) for r in quality.grade_documents(messy, labels).filter("keep").collect())
    out = stages["quality classifier"](spark, messy, SF)
    assert out.columns == messy.columns and Counter(r["doc_id"] for r in out.collect()) == Counter(i for (i, _), n in kept.items() for _ in range(n))
    assert not rows_of(out) - rows_of(messy)
    out = stages["n-gram Jaccard join"](spark, messy, SF)
    wanted = {c for _, n, c, _ in classes(texts_of(messy)) if n} | {r["doc_id"] for r in all_rows if not sets(r["text"])}
    assert out.columns == messy.columns and {r["doc_id"] for r in out.collect()} == wanted and max(rows_of(out).values()) == 1
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    leaky = messy.withColumn("text", F.when(F.col("doc_id") == 14, F.lit("x y z " + item.upper() + " end")).otherwise(F.col("text")))
    out = stages["benchmark decontamination"](spark, leaky, SF)
    assert out.columns == messy.columns and rows_of(out) == rows_of(leaky.filter("doc_id IS NULL OR doc_id <> 14"))
    out = stages["mixing sources to target weights"](spark, messy, SF)
    copies = {r["text"]: r["copies"] for r in mixing.mix(messy, carry=True).select("copies", "row.text").collect()}
    assert out.columns == messy.columns and sum(rows_of(out).values()) == mixing.mix(messy).agg(F.sum("copies")).first()[0] and not rows_of(out) - rows_of(messy.union(messy))
    assert all(copies[t] == 1 for t in (None, "", "   \n\t"))
    out = stages["sharding"](spark, messy, SF)
    assert rows_of(out.select(messy.columns)) == rows_of(messy) and "text_crc32" in out.columns and out.filter("slot IS NULL").count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        docs = corpus_pipeline.table(docs, f"t{k}")
        if k < 4:
            assert docs.columns == before.columns
        if k == 1:
            want = {(i, c) for i, _, c, _ in classes(texts_of(before))}
            assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted({c for _, c in want})
    assert sorted(16 * r["slot"] + r["shard"] for r in docs.collect()) == list(range(docs.count()))
    assert corpus_pipeline.run(spark, SF).select(docs.columns).exceptAll(docs).count() == 0


def test_long_texts(spark):
    """A text of millions of words is looked through as a whole."""
    r = random.Random(2)
    item = [f"v{r.randrange(10**6)}" for _ in range(40)]
    rows = [(1, "filler " * 1_000_000 + " ".join(item) + " filler" * 10), (2, "filler " * 1000)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(x["doc_id"], x["item_id"], x["score"], x["first_word"]) for x in decontaminate.find_leaks(docs, bench).collect()] == [(1, 7, 1.0, 1_000_000)]
    assert [x["doc_id"] for x in decontaminate.clean_rows(docs, bench).collect()] == [2]
    assert sorted((x["doc_id"], x["n_shingles"]) for x in jaccard.join(docs).collect()) == [(1, 1 + 44), (2, 1)]


def test_all_are_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and list(corpus_pipeline.QUERIES) == ["pipeline"]
    for name in ("op9_neighbours", "op10_decontamination", "op3_quality"):
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_seeds_do_not_depend_on_blocks(spark, monkeypatch):
    """A short item with every fourth word edited is found or not, whatever items stand in its block; common words make long seeds."""
    r = random.Random(9)
    draw = lambda n: [f"v{r.randrange(3000)}" for _ in range(n)]
    item = draw(12)
    leak = [f"v{r.randrange(3000)}" if i % 4 == 3 else w for i, w in enumerate(item)]
    few = [f"c{i}" for i in range(8)]
    common = [r.choice(few) for _ in range(30)]
    edited = list(common)
    edited[15] = "other"
    texts = [(1, " ".join(draw(20) + leak + draw(20))), (2, " ".join(draw(5) + edited + draw(5))), (3, " ".join(draw(17_500))), (4, " ".join(r.choice(few) for _ in range(2000)))]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(common))] + [(k, " ".join(draw(1500))) for k in range(2, 30)], "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = []
    for size in (1, 10, 20_000):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", size)
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 700 if size < 20_000 else 2_000_000)
        found.append(sorted(map(tuple, decontaminate.find_leaks(docs, bench, least=0.3).collect())))
        assert {x["doc_id"] for x in decontaminate.clean_rows(docs, bench, least=0.3).collect()} == {3, 4}
    assert found[0] == found[1] == found[2] and {x[:2] for x in found[0]} >= {(1, 0), (2, 1)}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 20_000)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    items = bench.select("item_id", "text")
    assert [len(b) for b in decontaminate.blocks_of(items)] == [1] * 30


def test_exact_search_is_brute_force(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 8)).round(1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "ROWS", 50)
    got = sorted((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in neighbours.search(vectors, every=20, recall=1.0).collect())
    want = []
    for i in range(0, 700, 20):
        d = sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in range(700) if j != i)[:10]
        want += [(i, k, j, s) for k, (s, j) in enumerate(d, 1)]
    assert got == want
    found = neighbours.search(vectors, every=20, recall=0.9)
    reached = {g["recall"] for g in found.collect()}
    hits = {(q, j) for q, _, j, _ in want} & {(g["query_id"], g["vec_id"]) for g in found.collect()}
    assert len(reached) == 1 and 0.9 <= reached.pop() and len(hits) >= 0.9 * len(want)
