"""N-gram Jaccard join: a grouped prefix join over sets of hashed word shingles, exact for every pair of different sets.

Words are split at ASCII white space after lower-casing A-Z; a set holds the distinct five-word shingles as 64-bit hashes; fewer words are one
shingle as a whole. Documents with equal sets, by 128-bit digests, are one node. Two nodes link when their similarity is `percent` or more.
Exact means up to clashes of these hashes.

1. Sieve. A partner of a set of n shingles has at least ceil(percent * n) of them. In any order of shingles, then, the first
   floor(n / 4) + l shingles of both hold l common ones (at 75 percent). The order here is by hash; l is about a tenth of n.
   A shingle that no other document has among its first ones is single; a set with more than floor(n / 4) single ones has
   no partner. What remains are the documents with copies, close or not quite close enough.
2. Prefixes. Among the nodes left, shingles are ordered by how many nodes have them. Those of one node stand first
   and can't match; so the rest of the prefix, the size and the number of single shingles say all that the prefix filter
   sees of a node, and nodes that agree in these form one group.
3. Stars. In each bucket (groups with a shingle in their prefixes) every group is paired with two centres only, the group of fewest
   single shingles and one by hash; each group's members with its first one. Pairs that pass the filters of size and position
   are expanded to members and verified. Links make components.
4. Rest. Buckets whose nodes are in one component are done: no further link could change it. In the others, all pairs of nodes
   in different components that pass the filters are verified. No pair is left out that could link components.

Verification needs the shingles that nodes share with any other node, as no other can be common. Buckets, groups and
components are never gathered in a task; aggregations combine before they shuffle, and joins on a hot key can be split.

Defined results: a text that is null or without words has no shingle, links with nothing and is its own component; equal sets
(so equal texts) are in one component; a null id never becomes a component's id unless all ids in it are null; repeated rows
give a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batches_of, drop_table, table

WORDS = 5
REMEMBERED = 100_000
#: Rows that go to Python at once; nodes, and shingles, of a block of a component; nodes of small components that are counted together.
BATCH, BLOCK_NODES, BLOCK_SHINGLES, TOGETHER = 1000, 256, 1_000_000, 256
#: Odd multipliers, one for each word of a shingle, and one for the length of a short text.
FACTORS = [np.uint64(xxhash.xxh64_intdigest(b"factor", seed=i) | 1) for i in range(WORDS + 1)]


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


def shingles(text: bytes, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles of text."""
    words = text.lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(w):
        return w
    short = len(w) < k
    m = 1 if short else len(w) - k + 1
    h = np.full(m, len(w) if short else 0, dtype=np.uint64) * FACTORS[WORDS]
    for j in range(len(w) if short else k):
        h += w[j : j + m] * FACTORS[j]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return np.unique(h)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes(), seed=len(s))


def first_ones(n: int, percent: int) -> int:
    """How many of n shingles the sieve looks at."""
    return min(n, spare(n, percent) + max(1, -(-9 * n // 100)))


def spare(n: int, percent: int) -> int:
    """How many of n shingles a partner may lack."""
    return n - -(-percent * n // 100)


def _sets(rows: DataFrame, percent: int) -> DataFrame:
    """rows(doc_id, _th, _h, _text) -> doc_id, th, h, n, node, firsts."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            n, node, firsts = [], [], []
            for t in b["_text"]:
                s = shingles(t, hashes)
                n.append(len(s))
                node.append(digest(s))
                firsts.append(s[: first_ones(len(s), percent)].view(np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["_th"], "h": b["_h"], "n": n, "node": node, "firsts": firsts})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, h long, n long, node binary, firsts array<long>")


def _full_sets(rows: DataFrame) -> DataFrame:
    """rows(node, n, _text) -> node, n, shingles, of the rows whose text is the node's and not one of the same 64-bit hash."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            found = [(bytes(node), n, s.view(np.int64)) for node, n, t in zip(b["node"], b["n"], b["_text"], strict=True) if digest(s := shingles(t, hashes)) == node]
            yield pd.DataFrame(found, columns=["node", "n", "shingles"])

    return rows.mapInPandas(run, "node binary, n long, shingles array<long>")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(a, b) -> node, label: the smallest node that each node of an edge reaches. Labels spread and are followed until none changes."""
    both = table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_l").alias("_near"))
        stepped = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("_near", "label")).alias("label"))
        stepped = table(stepped, "stepped")  # so that exchanges alone feed the join below, and a hot label can be split
        follow = stepped.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        now = table(stepped.join(follow, "label", "left").select("node", "old", F.least("label", F.coalesce("_next", "label")).alias("label")), "labels")
        if now.filter("label <> old").limit(1).count() == 0:
            return now.select("node", "label")
        labels = now.select("node", "label")
    return components(edges, most * 2)


def _passes(percent: int):
    """Filters of size and position for the sides x and y of a pair with a common shingle."""
    nx, ny = F.col("x_n"), F.col("y_n")
    need = F.ceil(F.lit(percent) * (nx + ny) / F.lit(100 + percent))
    size = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
    return size & (1 + F.least(nx - F.col("x_at") - 1, ny - F.col("y_at") - 1) >= need)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_o", F.size(F.array_intersect("s_a", "s_b")))
    return both.filter(F.col("_o") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("_o"))).select("a", "b")


def _side(name: str, *columns: str) -> list:
    return [F.col(c).alias(f"{name}_{c}") for c in columns]


def _row_hash(docs: DataFrame):
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def labelled(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """A row for each of docs: doc_id, th and h (hashes of text and row), n, label (the same for all of a component; null without
    shingles); with links also n_links (see join)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("_th"), _row_hash(docs).alias("_h"), text.alias("_text"))
    with batches_of(docs.sparkSession, BATCH):
        sets = table(_sets(rows, percent).withColumn("row", F.monotonically_increasing_id()), "sets")
    slim = table(sets.select("doc_id", "th", "h", "n", "node", "row"), "slim")

    firsts = sets.select("row", F.explode("firsts").alias("s"))
    single = firsts.groupBy("s").agg(F.count("*").alias("c"), F.min("row").alias("row")).filter("c = 1").groupBy("row").agg(F.count("*").alias("single"))
    may = F.col("n") - F.ceil(F.col("n") * percent / 100)
    left = slim.filter("n > 0").join(single, "row", "left").filter(F.coalesce("single", F.lit(0)) <= may)
    nodes = table(left.groupBy("node").agg(F.min("th").alias("th"), F.first("n").alias("n")), "nodes")
    drop_table(sets)

    labels, held = _link(rows, nodes, percent)
    if not links:
        return slim.join(labels, "node", "left").select("doc_id", "th", "h", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))
    copies = slim.filter("n > 0").groupBy("node").agg(F.count("*").alias("copies"))
    copies = table(copies.join(labels, "node", "left").filter("copies > 1 OR label IS NOT NULL"), "copies")
    near = link_counts(held.select("node", "n", "shared").join(copies.filter("label IS NOT NULL"), "node"), percent)
    known = table(copies.join(near, "node", "left").select("node", "label", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    label = F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label")
    return slim.join(known, "node", "left").select("doc_id", "th", "h", "n", label, F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def _members(x: list[np.ndarray], n_x: np.ndarray, y: list[np.ndarray], n_y: np.ndarray, percent: int) -> np.ndarray:
    """Which of x (sets of shingles in common with others, and the sizes of the whole sets) link with which of y."""
    flat = np.concatenate(x + y)
    of = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    names, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
    keep = seen[at] > 1
    of, at = of[keep], (np.cumsum(seen > 1) - 1)[at[keep]]
    both = np.zeros((len(x), len(y)), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    width = max(1, 4_000_000 // (len(x) + len(y)))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((len(x) + len(y), width), dtype=np.float32)
        m[of[i:j], at[i:j] - lo] = 1
        both += m[: len(x)] @ m[len(x) :].T
    o = both.astype(np.int64)
    return (o > 0) & (o * 100 >= percent * (n_x[:, None] + n_y[None, :] - o))


def link_counts(nodes: DataFrame, percent: int) -> DataFrame:
    """nodes(node, n, shared, label, copies) -> node, links: the documents of the other nodes that each links with. All links lie in components."""
    size = nodes.groupBy("label").agg(F.count("*").alias("_m"), F.sum(F.size("shared")).alias("_s"))
    blocks = F.ceil(F.greatest(F.col("_m") / BLOCK_NODES, F.col("_s") / BLOCK_SHINGLES)).cast("long")
    size = table(size.select("label", "_m", blocks.alias("b")), "blocks")
    some = size.filter("b = 1").agg(F.coalesce(F.sum("_m"), F.lit(0))).first()[0] // TOGETHER + 1
    dealt = nodes.join(size.drop("_m"), "label").withColumn("i", F.pmod(F.xxhash64("node"), "b"))
    alone = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("b") - 1), lambda j: F.struct(F.least("i", j).alias("i"), F.greatest("i", j).alias("j"), F.when(F.col("i") <= j, 0).otherwise(1).alias("side")))
    dealt = dealt.select("label", "b", "node", "n", "shared", "copies", F.explode(F.when(F.col("b") == 1, F.array(alone)).otherwise(pairs)).alias("p"))
    dealt = dealt.withColumn("key", F.when(F.col("b") == 1, F.pmod(F.xxhash64("label"), F.lit(some))).otherwise(F.xxhash64("label", "p.i", "p.j")))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby(["label", "i", "j"], sort=False):
            sides = [own] if own["i"].iloc[0] == own["j"].iloc[0] else [own[own["side"] == 0], own[own["side"] == 1]]
            x, y = sides[0], sides[-1]
            if len(x) and len(y) and len(own) > 1:
                linked = _members(list(x["shared"]), x["n"].to_numpy(), list(y["shared"]), y["n"].to_numpy(), percent)
                if x is y:
                    np.fill_diagonal(linked, False)
                out.append(pd.DataFrame({"node": x["node"], "links": linked @ y["copies"].to_numpy()}))
                if x is not y:
                    out.append(pd.DataFrame({"node": y["node"], "links": linked.T @ x["copies"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": []})

    counted = dealt.select("key", "b", "label", "p.i", "p.j", "p.side", "node", "n", "shared", "copies").groupBy("key").applyInPandas(count, "node binary, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def join(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: doc_id, n_shingles, component_id, n_links (other rows that it links with, equal ones included)."""
    kept = labelled(docs, percent, id_col, text_col, links=True)
    ids = kept.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = table(ids, "ids")  # so that the join below is fed by exchanges alone, and a hot component can be split
    out = kept.join(ids, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "n_links")


def distinct_rows(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that of the smallest id (null last), then of the smallest hash of the text, then of the
    row; of wholly equal rows one. Documents without shingles all stay, but for repeated rows."""
    found = labelled(docs, percent, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"), F.col("h")))
    chosen = found.filter("label IS NOT NULL").groupBy("label").agg(first.alias("f")).select("f.doc_id", "f.th", "f.h")
    chosen = chosen.union(found.filter("label IS NULL").groupBy("doc_id", "th").agg(F.min("h").alias("h")))
    again = found.groupBy("doc_id", "th", "h").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("_a"), F.col("th").alias("_b"), F.col("h").alias("_c"))
    repeated = F.col("doc_id").eqNullSafe(F.col("_a")) & (F.col("th") == F.col("_b")) & (F.col("h") == F.col("_c"))
    chosen = table(chosen.join(again, repeated, "left").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("h").alias("_hash"), F.col("_c").isNotNull().alias("_again")), "chosen")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))
    held = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)], F.col(f"`{id_col}`").alias("_i"), th.alias("_t"), _row_hash(docs).alias("_h"))
    kept = held.join(chosen, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")) & (F.col("_h") == F.col("_hash")))
    if chosen.filter("_again").limit(1).count():  # only rows that are repeated are told apart by another exchange
        kept = kept.filter("NOT _again").union(kept.filter("_again").dropDuplicates(["_i", "_t", "_h"]))
    return kept.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, names, strict=True)])


def _link(rows: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """node, label for the nodes that link with others; and what of the sets is needed to verify links."""
    n_nodes = nodes.count()
    wanted = F.broadcast(nodes) if n_nodes <= BROADCAST_ROWS else nodes
    texts = rows.join(wanted.select(F.col("th").alias("_th"), "node", "n"), "_th").select("node", "n", "_th", "_text")
    with batches_of(rows.sparkSession, BATCH):
        full = table(_full_sets(texts.dropDuplicates(["node", "_th"])).dropDuplicates(["node"]), "full")
    each = full.select("node", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    shared = each.join(common, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("_d"))
    held = full.select("node", "n").join(shared, "node").select("node", "n", F.transform("_d", lambda d: d["s"]).alias("shared"))
    held = held.withColumn("single", F.col("n") - F.size("shared"))
    in_prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("single")).cast("int")
    held = held.withColumn("prefix", F.when(in_prefix > 0, F.slice("shared", 1, F.greatest(in_prefix, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    held = held.withColumn("group", F.xxhash64("n", "single", "prefix"))
    held = table(held.filter(F.size("prefix") > 0), "held")
    drop_table(full)

    groups = held.groupBy("group").agg(F.min(F.struct("node", "n", "single", "prefix")).alias("g")).select("group", "g.*")
    posts = table(groups.select("group", "node", "n", "single", F.posexplode("prefix").alias("_i", "s")).withColumn("at", F.col("single") + F.col("_i")), "posts")
    entry = F.struct("group", "node", "n", "at")
    centres = posts.groupBy("s").agg(F.count("*").alias("c"), F.min_by(entry, F.struct("single", "node")).alias("_c1"), F.min_by(entry, F.xxhash64("node", F.lit(7))).alias("_c2")).filter("c > 1")
    centres = centres.select("s", F.explode(F.array_distinct(F.array("_c1", "_c2"))).alias("_c")).select("s", F.col("_c.group").alias("x_group"), F.col("_c.node").alias("x_node"), F.col("_c.n").alias("x_n"), F.col("_c.at").alias("x_at"))
    near = posts.select("s", *_side("y", "group", "n", "at")).join(centres, "s").filter((F.col("x_group") != F.col("y_group")) & _passes(percent))
    near = near.groupBy(F.col("x_node").alias("a"), F.col("y_group").alias("group")).agg(F.lit(1).alias("_1")).drop("_1")
    own = groups.select(F.col("node").alias("a"), "group")
    pairs = near.union(own).join(held.select("group", F.col("node").alias("b")), "group").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = table(_verified(pairs, held, percent), "links")
    labels = components(links)

    member = table(held.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("group", "node", "label", "n", "single", "prefix"), "members")
    parts = member.groupBy("group", "label").agg(F.first("n").alias("n"), F.first("single").alias("single"), F.first("prefix").alias("prefix"))
    parts = table(parts.select("group", "label", "n", "single", F.posexplode("prefix").alias("_i", "s")).withColumn("at", F.col("single") + F.col("_i")).drop("_i", "single"), "parts")
    open_ = parts.groupBy("s").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select("s")
    rest = table(parts.join(open_, "s"), "open")
    x, y = rest.select("s", *_side("x", "group", "label", "n", "at")), rest.select("s", *_side("y", "group", "label", "n", "at"))
    cross = x.join(y, (x["s"] == y["s"]) & (F.col("x_label") < F.col("y_label")) & _passes(percent))
    cross = cross.select("x_group", "x_label", "y_group", "y_label").distinct()
    cross = cross.join(member.select(*_side("x", "group", "label"), F.col("node").alias("a")), ["x_group", "x_label"]).join(member.select(*_side("y", "group", "label"), F.col("node").alias("b")), ["y_group", "y_label"])
    more = table(_verified(cross.select("a", "b"), held, percent), "links")
    return (components(links.union(more)) if more.limit(1).count() else labels), held


def oracle(percent: int = 75) -> str:
    """The same rows in DuckDB SQL: all pairs that share a shingle, and whatever they reach; for tables without repeated ids."""
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM d),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        o AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS o FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM o WHERE 100 * o >= {percent} * (n + m - o)),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)), doc_id) AS component_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM s"""
