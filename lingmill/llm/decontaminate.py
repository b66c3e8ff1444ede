"""Benchmark decontamination: rare n-gram seeds join passages of documents to test items, Smith-Waterman scores them.

Words are split at ASCII white space, in lower case, without symbols at their ends. How often each word of the benchmark
occurs is counted over all documents. From every position of an item the shortest n-gram that chance would hardly make
(the product of its words' shares is below `rare`) is a seed, however long; an item that has none, as it is all common words
and few, is its own seed as a whole: its edits could not be told from chance. A document's seeds
are looked up in one pass over its words. Hits of an item that lie near each other mark a passage; the local
alignment of passage and item (match 2, mismatch -1, gap -1, by word), as a share of the item's best possible score, counts
as a leak from `least` on. Edited and paraphrased copies keep some seeds and most of the score.

Words are counted once for the whole benchmark, so that an item's seeds don't depend on the other items of its block. Items go
to all tasks in blocks of bounded number and characters (an item longer than that is a block of its own); clean_rows reads the
documents once for all blocks, find_leaks once a block. Nothing of the documents is shuffled but word counts, added up in each
task before. A worker keeps the seeds of the block at hand for its next task, but no words.

Defined results: a null or wordless text or item has no leak; of several passages the best counts, the first if they tie;
repeated items give a row each; repeated documents give rows each; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chance share below which an n-gram is a seed, least score of a leak.
RARE, LEAST = 1e-9, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items and characters of items that go to the tasks at once, and words that are counted at once.
BLOCK_ITEMS, BLOCK_CHARS, BLOCK_WORDS = 20_000, 16_000_000, 2_000_000
REMEMBERED = 100_000
#: Rows that are looked through at once.
ROWS = 1000
#: Size of the table of n-gram hashes that lets most positions go.
QUICK = 1 << 23
#: Symbols that don't count at the ends of a word.
EDGES = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|*#$%&-_=+/\\~^`@"
EDGE_BYTES = EDGES.encode()


class WordIds(dict):
    """raw word -> its number in the vocabulary, -1 if not in it, -2 if it is nothing but symbols; forgets all when full."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: bytes) -> int:
        word = raw.strip(EDGE_BYTES).lower() if raw.isascii() else plain(raw)
        found = self.vocabulary.get(word, -1) if word else -2
        if len(raw) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[raw] = found
        return found

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts, each text followed by a -1; where each text starts, and the end."""
        raw = [t.split() for t in texts]
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(raw)), dtype=np.int64)
        doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        keep = ids != -2
        ids, doc = ids[keep], doc[keep]
        starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(raw)) + 1)])
        out = np.full(len(ids) + len(raw), -1, dtype=np.int64)
        out[np.arange(len(ids)) + doc] = ids
        return out, starts


def chunks(keys, texts, size: int = 2_000_000):
    """Keys and texts in lists of about `size` bytes: what a task holds at once doesn't grow with a batch."""
    held_k, held_t, n = [], [], 0
    for key, t in zip(keys, texts, strict=True):
        held_k.append(key)
        held_t.append(t)
        n += len(t) + 100
        if n >= size:
            yield held_k, held_t
            held_k, held_t, n = [], [], 0
    if held_k:
        yield held_k, held_t


def plain(raw: bytes) -> bytes:
    return raw.decode("utf-8", "replace").lower().strip(EDGES).encode()


def words_of(text: str | None) -> list[bytes]:
    return [w for w in map(plain, (text or "").encode("utf-8", "replace").split()) if w]


class Seeds:
    """n-grams of word numbers and where in which items they stand, as sorted arrays of hashes; items are numbered as given."""

    def __init__(self, items: list, share: np.ndarray, rare: float = RARE):
        self.items = [np.asarray(x, dtype=np.int64) for x in items]
        found: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            shares, any_rare = share[item].tolist(), False
            for i in range(len(item)):
                p = 1.0
                for n in range(1, len(item) - i + 1):
                    p *= shares[i + n - 1]
                    if n > 1 and p < rare:
                        found.setdefault(n, []).append((k, i))
                        any_rare = True
                        break
            if len(item) and not any_rare:
                found.setdefault(len(item), []).append((k, 0))
        self.by_n: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.quick = np.zeros(QUICK, dtype=bool)
        for n, places in sorted(found.items()):
            h = np.zeros(len(places), dtype=np.uint64)
            for j in range(n):
                h = self.mixed(h, np.array([self.items[k][i + j] for k, i in places]))
            self.quick[h & np.uint64(QUICK - 1)] = True
            order = np.argsort(h, kind="stable")
            self.by_n[n] = h[order], np.array(places, dtype=np.int32)[order]

    @staticmethod
    def mixed(h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The hash of an n-gram, from that of its words but the last."""
        h = (h ^ words.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(position, item, position in the item) of all seeds in a run of texts; no seed holds the -1 between texts."""
        out = []
        known = ids >= 0
        run = np.flatnonzero(np.diff(np.concatenate([known, [False]]).astype(np.int8)) == -1)  # last known words of runs
        at = np.flatnonzero(known)
        left = run[np.searchsorted(run, at)] - at + 1 if len(at) else at  # known words from here on
        h, done = np.zeros(len(at), dtype=np.uint64), 0
        for n, (hashes, places) in self.by_n.items():
            long = left >= n
            at, left, h = at[long], left[long], h[long]
            if not len(at):
                break
            for j in range(done, n):
                h = self.mixed(h, ids[at + j])
            done = n
            some = np.flatnonzero(self.quick[h & np.uint64(QUICK - 1)])
            lo, hi = np.searchsorted(hashes, h[some], "left"), np.searchsorted(hashes, h[some], "right")
            for i, a, b in zip(at[some[hi > lo]].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for k, j in places[a:b].tolist():
                    if np.array_equal(ids[i : i + n], self.items[k][j : j + n]):  # and not only of the same hash
                        out.append((i, k, j))
        return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score, and where in the passage it ends (exclusive); linear gaps."""
    ramp = -GAP * np.arange(len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1, dtype=np.int64), 0, 0
    for w in item.tolist():
        here = np.zeros(len(passage) + 1, dtype=np.int64)
        np.maximum(above[:-1] + np.where(passage == w, MATCH, MISMATCH), above[1:] + GAP, out=here[1:])
        np.maximum(here, 0, out=here)
        above = np.maximum.accumulate(here + ramp) - ramp
        j = int(above.argmax())
        if above[j] > best:
            best, end = int(above[j]), j
    return best, end


def passages(found: list[tuple[int, int]], width: int):
    """Runs of hits of one item that lie at most `width` words apart: first and last position, number of hits."""
    start = 0
    for i in range(1, len(found) + 1):
        if i == len(found) or found[i][0] - found[i - 1][0] > width:
            yield found[start][0], found[i - 1][0], i - start
            start = i


def leaks_in(ids: np.ndarray, starts: np.ndarray, seeds: Seeds, least: float = LEAST):
    """(text, item, score, first word, end word, seeds) of each item that leaked into each of the texts."""
    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
    hits = sorted(seeds.hits(ids))
    docs = np.searchsorted(starts, [h[0] for h in hits], side="right") - 1
    for d, (i, k, j) in zip(docs.tolist(), hits, strict=True):
        by.setdefault((d, k), []).append((i, j))
    for (d, k), found in sorted(by.items()):
        item, lo_doc, hi_doc = seeds.items[k], int(starts[d]), int(starts[d + 1]) - 1
        best = None
        for first, last, n in passages(found, len(item)):
            lo, hi = max(lo_doc, first - 2 * len(item)), min(hi_doc, last + 2 * len(item))
            score, end = align(item, ids[lo:hi])
            if best is None or score > best[0]:
                best = (score, lo, lo + end, n)
        score = best[0] / (MATCH * len(item))
        if score >= least:
            _, back = align(item[::-1], ids[best[1] : best[2]][::-1])
            yield d, k, score, best[2] - back - lo_doc, best[2] - lo_doc, best[3]


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_text"))


def word_counts(rows: DataFrame, vocabulary: dict[bytes, int]) -> dict[int, int]:
    """How often each word of the vocabulary occurs in all documents, by number, and under -1 how often any other word does."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        ids, n = WordIds(shared.value), len(shared.value)
        total = np.zeros(n + 1, dtype=np.int64)
        for b in batches:
            for _, texts in chunks(b["doc_id"], b["_text"]):
                got, starts = ids.of(texts)
                total += np.bincount(got + 1, minlength=n + 1)
                total[0] -= len(starts) - 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"word": at - 1, "n": total[at]})

    got = rows.mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a word of the vocabulary
    return dict(map(tuple, got))


def word_shares(rows: DataFrame, words: list[bytes]) -> dict[bytes, float]:
    """Share of each of the words among all words of all documents (each counted once more than it occurs), however many are counted at once."""
    counts, total = {}, None
    for lo in range(0, len(words), BLOCK_WORDS):
        part = words[lo : lo + BLOCK_WORDS]
        got = word_counts(rows, {w: i for i, w in enumerate(part)})
        total = sum(got.values()) if total is None else total
        counts |= {w: got.get(i, 0) + 1 for i, w in enumerate(part)}
    return {w: n / (total + len(words)) for w, n in counts.items()}


def blocks_of(items: DataFrame):
    """Lists of (item_id, words) in order of id and text, of bounded number and characters; one partition is read at a time."""
    held, chars = [], 0
    for name, text in items.orderBy("item_id", "text").toLocalIterator():
        size = len(text or "")
        if held and (len(held) >= BLOCK_ITEMS or chars + size > BLOCK_CHARS):
            yield held
            held, chars = [], 0
        held.append((name, words_of(text)))
        chars += size
    if held:
        yield held


def _blocks(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> list:
    """The broadcast blocks (key, names, items as word numbers, vocabulary, shares of its words)."""
    spark = rows.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    shares = word_shares(rows, sorted({w for block in blocks_of(items) for _, words in block for w in words}))
    out = []
    for block in blocks_of(items):
        words = sorted({w for _, ws in block for w in ws})
        if words:
            vocabulary = {w: i for i, w in enumerate(words)}
            out.append(spark.sparkContext.broadcast((uuid.uuid4().hex, [k for k, _ in block], [np.array([vocabulary[w] for w in ws], dtype=np.int64) for _, ws in block], vocabulary, np.array([shares[w] for w in words]))))
    return out


#: What a worker keeps between tasks: the seeds of one block, by key and rarity.
_built: dict = {}


def _ready(shared, rare: float) -> tuple[list, WordIds, Seeds]:
    """Names, words and seeds of a block; the seeds are built once in a worker."""
    key, names, items, vocabulary, shares = shared.value
    if (key, rare) not in _built:
        _built.clear()
        _built[key, rare] = Seeds(items, shares, rare)
    return names, WordIds(vocabulary), _built[key, rare]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, rare: float = RARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that leaked into it: doc_id, item_id, score, first_word, end_word, n_seeds."""
    rows = _text(docs, id_col, text_col)
    kind = benchmark.select(F.col(f"`{item_col}`")).schema[0].dataType.simpleString()
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {kind}, score double, first_word long, end_word long, n_seeds long"
    out = docs.sparkSession.createDataFrame([], kinds)
    for k, shared in enumerate(_blocks(rows, benchmark, item_col, item_text)):
        found = rows.mapInPandas(_finder(shared, least, rare), kinds)
        out = out.unionByName(found) if k else found
    return out


def _finder(shared, least: float, rare: float):
    def run(batches):
        names, ids, seeds = _ready(shared, rare)
        for b in batches:
            found = []
            for keys, texts in chunks(b["doc_id"], b["_text"]):
                got, starts = ids.of(texts)
                found += [(keys[d], names[k], round(s, 6), lo, hi, n) for d, k, s, lo, hi, n in leaks_in(got, starts, seeds, least)]
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "first_word", "end_word", "n_seeds"])

    return run


def clean_rows(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, rare: float = RARE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, as they are, into which no item leaked: each block of items is a filter that rows pass where they are read."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    held, at = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)]), docs.columns.index(text_col)
    if held.schema[at].dataType.simpleString() != "string":  # else the text goes to Python once
        held, at = held.withColumn("_text", F.col(names[at]).cast("string")), len(names)
    for shared in _blocks(_text(docs, docs.columns[0], text_col), benchmark, item_col, item_text):
        held = held.mapInArrow(_filter(shared, least, rare, at), held.schema)
    return held.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, names, strict=True)])


def _filter(shared, least: float, rare: float, at: int):
    def run(batches):
        _, ids, seeds = _ready(shared, rare)
        for b in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            keep = np.ones(b.num_rows, dtype=bool)
            for keys, texts in chunks(range(b.num_rows), [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]):
                got, starts = ids.of(texts)
                for d, *_ in leaks_in(got, starts, seeds, least):
                    keep[keys[d]] = False
            yield b.filter(pa.array(keep))

    return run
