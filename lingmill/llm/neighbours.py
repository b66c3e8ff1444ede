"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

Fit: the tree is built on a sample of at most `sample` vectors, those of the smallest id hash: a node splits into `branch`
clusters until it has at most `leaf` of the sample.

Index: every row goes down the tree to one leaf.

Calibration: CALIBRATION of the queries, those of the smallest id hash, are answered by brute force over all rows. The
number of leaves to visit is widened until `recall` of their true neighbours lie in visited leaves; the recall that this number
gives them is returned with each row. With recall 1 every query visits every leaf, and the search is exact.

Search: a query keeps the nodes yet to see in a priority queue by distance to their centres and visits leaves in that order, as many
as were calibrated, and more until their rows can fill the answer. Neighbouring leaves make a bin of bounded size, and a query
goes once to each bin that it visits, with the leaves to look at there. A bin of many queries, or of one leaf of many rows, is split
by hash into as many parts as it needs, so that no task holds more than a block of rows and a block of queries. A block returns the
k nearest of its rows for each of its queries; the final answer takes the k nearest of these.

Defined results: vectors that are null, zero, of another length than most of the sample, or hold null or non-finite numbers take no part, nor
do rows without id; rows that share the query's id are its own and no candidates; repeated queries count once; ties go
to the smaller id; other columns are ignored; with fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

SAMPLE, BRANCH, LEAF, RECALL, CALIBRATION = 20_000, 8, 48, 0.97, 200
#: Rows and queries of a block.
ROWS, QUERIES = 2048, 1024


class Tree:
    """centres[node], children[node] (empty: a leaf, with its number in leaf_of)."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 3):
        self.centres, self.children, self.leaf_of = [x.mean(axis=0)], [[]], {}
        rng, todo = np.random.default_rng(seed), [(0, x)]
        while todo:
            node, own = todo.pop()
            parts = self._split(own, branch, rng) if len(own) > leaf else []
            if len(parts) < 2:
                self.leaf_of[node] = len(self.leaf_of)
                continue
            for part in parts:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), part))
                self.centres.append(part.mean(axis=0))
                self.children.append([])
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(x: np.ndarray, branch: int, rng, rounds: int = 8) -> list[np.ndarray]:
        centres = x[rng.choice(len(x), min(branch, len(x)), replace=False)]
        for _ in range(rounds):
            near = distances(x, centres).argmin(axis=1)
            centres = np.array([x[near == j].mean(axis=0) for j in range(len(centres)) if (near == j).any()])
        near = distances(x, centres).argmin(axis=1)
        return [x[near == j] for j in range(len(centres)) if (near == j).any()]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child at every node."""
        out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not self.children[node]:
                out[at] = self.leaf_of[node]
                continue
            near = distances(x[at], self.centres[self.children[node]]).argmin(axis=1)
            todo += [(c, at[near == j]) for j, c in enumerate(self.children[node]) if (near == j).any()]
        return out

    def visits(self, q: np.ndarray):
        """Leaves, best bin first."""
        far = distances(q[None, :], self.centres)[0]
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf_of[node]
            for c in self.children[node]:
                heapq.heappush(queue, (far[c], c))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, good enough to choose a cluster."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :], 0)


def nearest(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """For each query: its number, and the positions and distances of its k nearest rows with another id, ties to the smaller id.

    ids must be sorted. Products of matrices choose the candidates, with room for their rounding; distances are those of the vectors.
    """
    near = distances(q, x)
    near[q_ids[:, None] == ids[None, :]] = np.inf
    n = min(k, len(ids))
    room = 1e-10 * ((x * x).sum(axis=1).max() + (q * q).sum(axis=1))
    cut = np.partition(near, n - 1, axis=1)[:, n - 1]
    for i in range(len(q)):
        at = np.flatnonzero((near[i] <= cut[i] + room[i]) & (near[i] < np.inf))
        d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
        best = np.argsort(d, kind="stable")[:n]
        yield i, at[best], d[best]


def visits_for(tree: Tree, queries: dict[int, np.ndarray], leaves: dict[int, list[int]], recall: float) -> tuple[int, float]:
    """Leaves to visit so that this share of the true neighbours, given by their leaves, is in a visited one; the share reached."""
    needed = []
    for i, q in queries.items():
        rank = {leaf: r for r, leaf in enumerate(tree.visits(q), 1)}
        needed += [rank[leaf] for leaf in leaves.get(i, [])]
    if recall >= 1 or not needed:
        return len(tree.leaf_of), 1.0
    needed = np.sort(needed)
    visits = int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)])
    return visits, float(np.mean(needed <= visits))


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def brute_force(rows: DataFrame, queries: dict[int, np.ndarray], k: int) -> DataFrame:
    """query_id, rank, vec_id, score and leaf of the k nearest of all rows(leaf, vec_id, v), for a bounded set of queries."""
    q_ids, q = np.array(list(queries)), np.array(list(queries.values()))
    shared = rows.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches):
        q_ids, q = shared.value
        for b in batches:
            b = b.sort_values("vec_id")
            for lo in range(0, len(b), ROWS):
                part = b.iloc[lo : lo + ROWS]
                ids, leaf = part["vec_id"].to_numpy(), part["leaf"].to_numpy()
                found = [(q_ids[i], ids[j], d, leaf[j]) for i, at, dist in nearest(ids, np.array(part["v"].tolist()), q_ids, q, k) for j, d in zip(at, dist, strict=True)]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score", "leaf"])

    near = rows.select("leaf", "vec_id", "v").mapInPandas(run, "query_id long, vec_id long, score double, leaf long")
    return _best(near, k)


def _best(near: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = 10, every: int = 100, sample: int = SAMPLE, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, recall (that of the calibration queries) for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toPandas()
    if not len(got):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, recall double")
    dim = max(sorted(Counter(map(len, got["v"])).items()), key=lambda x: x[1])[0]
    tree = Tree(np.array([v for v in got["v"] if len(v) == dim]))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches):
        for b in batches:
            yield pd.DataFrame({"leaf": shared.value.leaves(np.array(b["v"].tolist())) if len(b) else [], "vec_id": b["vec_id"], "v": b["v"]})

    index = table(rows.filter(F.size("v") == dim).mapInPandas(assign, "leaf long, vec_id long, v array<double>"), "index")
    per_leaf = dict(index.groupBy("leaf").count().collect())  # a row a leaf; the tree's size is bounded by the sample
    total = sum(per_leaf.values())
    queries = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    some = {r["vec_id"]: np.array(r["v"]) for r in queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()}
    leaves = defaultdict(list)
    if some and recall < 1:
        for r in brute_force(index, some, k).select("query_id", "leaf").collect():  # at most k * CALIBRATION rows
            leaves[r["query_id"]].append(r["leaf"])
    visits, reached = visits_for(tree, some, leaves, recall)

    bins, parts, held = {}, {}, ROWS  # leaves in their order, which keeps those of a branch together
    for leaf in sorted(per_leaf):
        if held + per_leaf[leaf] > ROWS:
            parts[len(parts)], held = -(-per_leaf[leaf] // ROWS), 0
        bins[leaf] = len(parts) - 1
        held += per_leaf[leaf]

    def choose(batches):
        tree = shared.value
        for b in batches:
            out = []
            for i, v in zip(b["vec_id"], b["v"], strict=True):
                rows_seen, to = 0, defaultdict(list)
                for r, leaf in enumerate(tree.visits(np.array(v)), 1):
                    if leaf in bins:
                        to[bins[leaf]].append(leaf)
                        rows_seen += per_leaf[leaf]
                    if r >= visits and rows_seen > min(4 * k, total - 1):
                        break
                out += [(bin_, i, v, some) for bin_, some in to.items()]
            yield pd.DataFrame(out, columns=["bin", "query_id", "q", "leaves"])

    asked = table(queries.mapInPandas(choose, "bin long, query_id long, q array<double>, leaves array<long>"), "visits")
    q_per_bin = dict(asked.groupBy("bin").count().collect())
    parts = F.broadcast(spark.createDataFrame([(leaf, n, parts[n], -(-q_per_bin.get(n, 1) // QUERIES)) for leaf, n in bins.items()], "leaf long, bin long, r long, c long"))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    left = index.join(parts, "leaf").select("bin", F.pmod(F.xxhash64("vec_id", F.lit(1)), "r").alias("r"), F.explode(each("c")).alias("c"), "leaf", "vec_id", "v")
    right = asked.join(parts.drop("leaf").distinct(), "bin").select("bin", F.explode(each("r")).alias("r"), F.pmod(F.xxhash64("query_id", F.lit(2)), "c").alias("c"), "query_id", "q", "leaves")

    def block(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values(["leaf", "vec_id"])
            ids, x, leaf = rows["vec_id"].to_numpy(), np.array(rows["v"].tolist()), rows["leaf"].to_numpy()
            q_ids, q, wants = asked["query_id"].to_numpy(), np.array(asked["q"].tolist()), [set(w) for w in asked["leaves"]]
            found = [[] for _ in q_ids]
            starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
            for lo, hi in zip(starts, [*starts[1:], len(leaf)], strict=True):
                mine = np.array([j for j, w in enumerate(wants) if leaf[lo] in w], dtype=int)
                if len(mine):
                    for i, at, dist in nearest(ids[lo:hi], x[lo:hi], q_ids[mine], q[mine], k):
                        found[mine[i]] += zip(dist.tolist(), ids[lo:hi][at].tolist(), strict=True)
            out = [(i, j, d) for i, got in zip(q_ids, found, strict=True) for d, j in heapq.nsmallest(k, got)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    key = ["bin", "r", "c"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(block, "query_id long, vec_id long, score double")
    return _best(near, k).select("query_id", "rank", "vec_id", "score", F.lit(reached).alias("recall"))
