"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. For every node, a failure link leads to the node of what is left after longest-match tokens were
popped off its front, and the node keeps how many tokens that pops. Counting the pieces that greedy longest match makes of a
word takes one pass over its bytes, without building a piece: follow a child if there is one, else add the node's count and
follow its link. A word of which some part has no token counts as one unknown token.

A text is split at ASCII white space; a word is spelled with a leading space as byte-level vocabularies have it, so its first
piece may be a token that starts a word. Counts of distinct words are remembered in a table of bounded size; the automaton is built
once in a worker and kept for its next task.

Defined results: a null text has 0 words and tokens; repeated rows give a row each; other columns are ignored; an empty table
gives an empty result; the length of a text or a word doesn't matter.
"""

from __future__ import annotations

import base64
import uuid
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words remembered by a task at once, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64
#: A vocabulary goes to every task; larger ones are refused, as they are no vocabularies.
MOST_TOKENS = 2_000_000


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The byte strings of a file of ranks: base64, space, rank in each line."""
    with open(path, "rb") as f:
        found = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    if len(found) > MOST_TOKENS:
        raise ValueError(f"{path} has {len(found)} tokens; at most {MOST_TOKENS} are taken")
    return found


class Automaton:
    """children[node]: byte -> node; link[node]: node or -1; pops[node]: tokens popped on the way over the link.

    starts: tokens that may begin a word; inner: tokens that may continue it (default: the same ones, in the same trie).
    """

    def __init__(self, starts: list[bytes], inner: list[bytes] | None = None):
        self.children: list[dict[int, int]] = [{}]
        self.root, self.inside = 0, 0 if inner is None else 1
        if inner is not None:
            self.children.append({})
        ends = self._add(starts, self.root) | (set() if inner is None else self._add(inner, self.inside))
        n = len(self.children)
        self.link, self.pops = [-1] * n, [0] * n
        queue = deque({self.root, self.inside})
        while queue:
            u = queue.popleft()
            for c, v in self.children[u].items():
                if v in ends:
                    self.link[v], self.pops[v] = self.inside, 1
                else:
                    z, popped = self.link[u], self.pops[u]
                    while z >= 0 and c not in self.children[z]:
                        popped += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.children[z][c], popped
                queue.append(v)

    def _add(self, tokens: list[bytes], root: int) -> set[int]:
        ends = set()
        for token in tokens:
            u = root
            for c in token:
                nxt = self.children[u].get(c)
                if nxt is None:
                    nxt = self.children[u][c] = len(self.children)
                    self.children.append({})
                u = nxt
            if token:
                ends.add(u)
        return ends

    def count(self, word: bytes) -> int:
        """Number of longest-match pieces of word; 1 if some part of it has no token."""
        children, link, pops = self.children, self.link, self.pops
        u, n = self.root, 0
        for c in word:
            v = children[u].get(c)
            while v is None:
                z = link[u]
                if z < 0:
                    return 1
                n += pops[u]
                u = z
                v = children[u].get(c)
            u = v
        while u != self.inside:
            if u == self.root or link[u] < 0:
                return 1 if word else 0
            n += pops[u]
            u = link[u]
        return n


class Counts(dict):
    """word -> pieces, worked out when first asked for; forgets all when full."""

    def __init__(self, automaton: Automaton, lead: bytes):
        super().__init__()
        self.automaton, self.lead = automaton, lead

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.lead + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


#: What a worker keeps between tasks: the automaton of one vocabulary, by its key.
_built: dict[str, Automaton] = {}


def _automaton(shared) -> Automaton:
    key, vocabulary = shared.value
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(vocabulary)
    return _built[key]


def count_tokens(docs: DataFrame, vocabulary: list[bytes] | None = None, lead: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: doc_id, n_bytes, n_words, n_tokens."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, load_vocabulary() if vocabulary is None else vocabulary))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("t"))

    def run(batches):
        counts = Counts(_automaton(shared), lead)
        for b in batches:
            n_words, n_tokens = [], []
            for t in b["t"]:
                words = t.split()
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(t) for t in b["t"]], "n_words": n_words, "n_tokens": n_tokens})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_words long, n_tokens long")


def oracle(path: str = VOCABULARY) -> str:
    """The same rows in DuckDB SQL: longest-match pieces of every distinct word, one after the other."""
    return rf"""WITH RECURSIVE v AS (SELECT DISTINCT hex(from_base64(split_part(line, ' ', 1))) AS t FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM read_text('{path}')) WHERE trim(line) <> ''),
        lens AS (SELECT DISTINCT length(t) AS l FROM v WHERE length(t) > 0),
        d AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents),
        e AS (SELECT r, '20' || hex(encode(unnest(w))) AS h FROM d),
        step AS (SELECT DISTINCT h, 1::BIGINT AS pos, 0::BIGINT AS n FROM e
            UNION ALL SELECT h, pos + max(l), n + 1 FROM step JOIN lens ON l <= length(h) - pos + 1 JOIN v ON v.t = substr(h, pos, l) GROUP BY h, pos, n),
        done AS (SELECT h, n FROM step WHERE pos > length(h)),
        counts AS (SELECT r, CAST(sum(coalesce(n, 1)) AS BIGINT) AS n_tokens FROM e LEFT JOIN done USING (h) GROUP BY r)
        SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_tokens, 0) AS n_tokens FROM d LEFT JOIN counts USING (r)"""
