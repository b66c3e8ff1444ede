"""Quality by ordinal cumulative-link regression on graded ratings.

Ratings make three grades: 0 toxic, 1 poor but not toxic, 2 sound and clean; each word of abuse may push a text further down.
P(grade <= k) = sigmoid(threshold[k] - w.x), one weight vector w for all grades and ordered thresholds. x marks which hashed features a
text has: its words, the first four letters of longer words, and levels of how it is written (repeats, capitals, digits, symbols,
lengths of words). From the model come the expected grade and the tail probabilities P(grade >= k); a document is kept if
P(grade >= 2) is at least 1/2, 1/2 itself included.

The model is fitted on a sample: of the `sample` labelled ids with the smallest hashes, each distinct text once, and not more than
2 * `sample` texts, one of each id first, then those with the smallest hashes of id and text. A feature has a weight if at least a
thousandth of the fitted texts have it, and two at least. Everything else covers all rows: every document is scored over its whole text.

Defined results: a null text is an empty one and is scored like it; a label without quality or toxic counts for nothing, of
several labels of a document the lowest grade counts; without any usable label everything is kept with p = 1; repeated rows
give a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

BITS = 20
#: The bound of the sample, the least share of its texts that a feature must be in, and the fit's settings.
SAMPLE, MIN_SHARE, SPARSE_STEPS, STEPS, RATE, SPARSE, DECAY = 12_000, 1e-3, 150, 250, 0.1, 1.5e-3, 3e-6
REMEMBERED = 100_000
#: Rows that are scored at once.
ROWS = 1000
EDGES = b" \t\n.,;:!?\"'()[]{}<>|*#$%&-_=+/\\~^`@"


class Buckets(dict):
    """raw word -> its hashed features; forgets all when full."""

    def __missing__(self, raw: bytes) -> tuple:
        word = raw.strip(EDGES).lower()
        mask = (1 << BITS) - 1
        found = (crc32(word) & mask,) + ((crc32(b"^" + word[:4]) & mask,) if len(word) > 5 else ())
        if len(raw) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[raw] = found
        return found


#: Classes of characters: capital and small letters, digits, white space, and letters beyond ASCII.
UPPER, LOWER, DIGITS, SPACE, BEYOND = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\n\v\f\r", bytes(range(128, 256))


def written(text: bytes, words: list[bytes]) -> list[int]:
    """Levels, from 0 to 8, of how a text is written, as hashed features: shares of character classes and of repeated words."""
    n, size = max(1, len(words)), max(1, len(text))
    without = lambda some: len(text) - len(text.translate(None, some))
    upper, lower, digits = without(UPPER), without(LOWER), without(DIGITS)
    symbols = len(text.translate(None, UPPER + LOWER + DIGITS + SPACE + BEYOND))
    shares = {
        "repeat": sum(map(bytes.__eq__, words[1:], words)) / n,
        "fresh": 1 - len(set(words)) / n,
        "upper": upper / max(1, upper + lower),
        "digits": 4 * digits / size,
        "symbols": 2 * symbols / size,
        "bang": text.count(b"!") / n,
        "length": size / n / 24,
    }
    level = lambda x: 0 if x <= 0 else min(8, 1 + int(x * 16))
    return [crc32(f"\0{k}{level(v)}".encode()) & ((1 << BITS) - 1) for k, v in shares.items()]


def features(text: bytes, buckets: Buckets) -> np.ndarray:
    words = text.split()
    return np.unique(np.fromiter(chain(chain.from_iterable(map(buckets.__getitem__, set(words))), written(text, words)), dtype=np.int32))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def likelihood(p: np.ndarray, flat: np.ndarray, docs: np.ndarray, grades: np.ndarray, dim: int) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood and its gradient. p: dim weights, the first threshold, logs of the steps up from it; flat, docs:
    the features of all texts and whose they are."""
    n, cuts = len(grades), np.concatenate([[-np.inf], thresholds(p, dim), [np.inf]])
    score = np.bincount(docs, weights=p[flat], minlength=n)
    hi, lo = sigmoid(cuts[grades + 1] - score), sigmoid(cuts[grades] - score)
    prob = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
    g = np.zeros_like(p)
    g[:dim] = np.bincount(flat, weights=(d_hi - d_lo)[docs], minlength=dim) / n
    by_cut = np.array([-d_hi[grades == k].sum() + d_lo[grades == k + 1].sum() for k in range(len(cuts) - 2)]) / n
    g[dim] = by_cut.sum()
    g[dim + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(p[dim + 1 :])
    return float(-np.log(prob).mean()), g


def thresholds(p: np.ndarray, dim: int) -> np.ndarray:
    return p[dim] + np.concatenate([[0], np.cumsum(np.exp(p[dim + 1 :]))])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds, by full-batch gradient steps (Adam) on the penalised likelihood.

    The first steps bear an absolute penalty that leaves few weights other than 0; the rest fit those with a square penalty.
    """
    n = len(rows)
    flat = np.concatenate(rows)
    docs = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    del rows
    held = np.bincount(flat, minlength=1 << BITS) >= max(2, MIN_SHARE * n)
    flat, docs = flat[held[flat]], docs[held[flat]]
    names, dim = np.flatnonzero(held), int(held.sum())
    flat = (np.cumsum(held) - 1)[flat]
    share = np.array([(np.count_nonzero(grades <= k) + 1) / (n + n_grades) for k in range(n_grades - 1)])
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(dim), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, SPARSE_STEPS + STEPS + 1):
        sparse = step <= SPARSE_STEPS
        if step == SPARSE_STEPS + 1:
            live = p[:dim] != 0
            flat, docs = flat[live[flat]], docs[live[flat]]
            m[:dim] *= live
        _, g = likelihood(p, flat, docs, grades, dim)
        if not sparse:
            g[:dim] += DECAY * p[:dim]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        pace = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        p -= pace * m / (1 - 0.9**step)
        if sparse:
            p[:dim] = np.sign(p[:dim]) * np.maximum(np.abs(p[:dim]) - SPARSE * pace[:dim], 0)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[names] = p[:dim]
    return weights, thresholds(p, dim)


def _bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("_text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """(weights, thresholds), or None without a usable label. labels: doc_id, quality, toxic."""
    grade = F.when(F.col("toxic") >= 1, 0).when(F.col("quality") < 1, 1).otherwise(2)
    graded = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("_grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        buckets = Buckets()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "grade": b["_grade"], "x": [features(t, buckets).tobytes() for t in b["_text"]]})

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = _bytes(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    th = F.xxhash64("_text")
    keys = table(rows.select("doc_id", th.alias("_th")).distinct().withColumn("_h", F.xxhash64("doc_id", "_th")), "texts")
    first = keys.groupBy("doc_id").agg(F.min("_h").alias("_first"))
    keys = keys.join(F.broadcast(first), "doc_id").orderBy(F.col("_h") != F.col("_first"), "_h", "doc_id", "_th").limit(2 * sample).select("doc_id", "_th")
    rows = rows.withColumn("_th", th).join(F.broadcast(keys), ["doc_id", "_th"]).dropDuplicates(["doc_id", "_th"])
    got = rows.select("doc_id", "_grade", "_text").mapInPandas(run, f"doc_id {kind}, grade int, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["doc_id", "x"], ignore_index=True)
    grades, features_ = got["grade"].to_numpy(), got.pop("x").tolist()
    del got  # what is not needed any more leaves the driver before the fit
    return fit([np.frombuffer(x, dtype=np.int32) for x in features_], grades)


def grade_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row for each of docs: doc_id, expected_grade, p_ge1, p_ge2, keep; with carry only the kept rows of docs, as they are."""
    model = train(docs, labels, sample, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts) -> np.ndarray:
        """P(grade >= k) for k = 1, 2 for each text."""
        if shared.value is None:
            return np.ones((len(texts), 2))
        weights, cuts = shared.value
        m = np.array([float(weights[features(t, scores.buckets)].sum(dtype=np.float64)) for t in texts]).reshape(-1, 1)
        return 1 - sigmoid(cuts[None, :] - m)

    if carry:
        keys = [f"_{i}" for i in range(len(docs.columns))]
        held = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, keys, strict=True)])
        at = docs.columns.index(text_col)
        if held.schema[at].dataType.simpleString() != "string":  # else the text goes to Python once
            held, at = held.withColumn("_text", F.col(keys[at]).cast("string")), len(keys)

        def keep(batches):
            scores.buckets = Buckets()
            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    got = scores([t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()])
                    yield part.filter(pa.array(got[:, 1] >= 0.5)).select(keys)

        kept = held.mapInArrow(keep, held.select(*keys).schema)
        return kept.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, keys, strict=True)])

    def run(batches):
        scores.buckets = Buckets()
        for b in (whole.iloc[lo : lo + ROWS] for whole in batches for lo in range(0, len(whole), ROWS)):
            got = scores(b["_text"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "expected_grade": got.sum(axis=1).round(6), "p_ge1": got[:, 0].round(6), "p_ge2": got[:, 1].round(6), "keep": got[:, 1] >= 0.5})

    rows = _bytes(docs, id_col, text_col)
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_ge1 double, p_ge2 double, keep boolean")
