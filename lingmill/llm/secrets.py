"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger has a row for each pair of blob and
rule version that was scanned, with the spans found (none too). A scan reduces the versions to distinct blobs, drops the
pairs that the ledger has, scans the rest, appends them, and joins the ledger's findings back to all paths. A blob that
occurs a thousand times, or was scanned last month, is scanned once. The last join has the paths' narrow rows on one side,
and one row a blob on the other; Spark may split a hot blob's paths, as the join alone stands above the exchange.

The rule version is a digest of the rules and of SCANNER, so changed rules are new pairs. Two scans at once may append a pair twice;
the ledger's findings are made one a blob before they are joined. A rule is looked for in linear time: the header of a JWT only
at the start of a run of its characters.

Defined results: a null content is an empty one, without findings; repeated rows give a row each; positions are code points
with an exclusive end; other columns are ignored unless named as path columns; an empty table gives an empty result; a path column
named like one of ours is an error in Ledger.scan, while scan_documents takes any name.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path

#: The base rules, by the contract; group 2 of `assign` must have 8 characters, the others count as a whole.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind, pattern, least length, group whose length counts, texts of which one is in any (lower-cased) text with a match.
BASE = (
    ("assign", ASSIGN, 8, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", ACCESS, 16, 0, ("akia",)),
    ("hex", r"[0-9a-f]{32,}", 32, 0, ()),
)
#: Rules beyond the base: well-known public token shapes.
MORE = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 39, 0, ("aiza",)),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 28, 0, ("eyj",)),
    ("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27, 0, ("private key",)),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
)
RULES = BASE + MORE
JWT_RE2 = r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
#: Goes up whenever spans_of changes what it makes of the same rules.
SCANNER = 2


def version_of(rules: tuple) -> str:
    return hashlib.sha256(repr((SCANNER, rules)).encode()).hexdigest()[:16]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def spans_of(text: str, rules: tuple = RULES) -> list[tuple[str, int, int]]:
    """All spans in text, by start and then by the order of the rules."""
    low, found = text.lower(), []
    for order, (kind, pattern, least, group, hints) in enumerate(rules):
        if hints and not any(h in low for h in hints):
            continue
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def scan_blobs(blobs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """blobs(blob, content), scanned: blob, rule_version, spans."""
    rule_version = version_of(rules)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"blob": b["blob"], "rule_version": rule_version, "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, rules)] for t in b["content"]]})

    return blobs.mapInPandas(run, f"blob binary, rule_version string, spans {SPANS}")


class Ledger:
    """What was scanned and found, as Parquet in the folder `path` that all machines reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        schema = f"blob binary, rule_version string, spans {SPANS}"
        try:
            self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def scan(self, versions: DataFrame, path_cols: list[str], content_col: str, rules: tuple = RULES) -> DataFrame:
        """Scan what is new in versions; then a row for each of them: path columns, blob, spans."""
        if {"blob", "spans"} & {c.lower() for c in path_cols}:
            raise ValueError("path columns cannot be named blob or spans")
        rule_version = version_of(rules)
        content = F.coalesce(F.col(f"`{content_col}`").cast("string"), F.lit(""))
        blob = F.unhex(F.sha2(content.cast("binary"), 256)).alias("blob")
        seen = self.read().filter(F.col("rule_version") == rule_version)
        unseen = versions.select(blob, content.alias("content")).dropDuplicates(["blob"]).join(seen.select("blob"), "blob", "left_anti")
        scan_blobs(unseen, rules).write.mode("append").parquet(self.path)
        found = self.read().filter(F.col("rule_version") == rule_version).select("blob", "spans").filter(F.size("spans") > 0).dropDuplicates(["blob"])
        paths = versions.select(*[F.col(f"`{c}`") for c in path_cols], blob)
        return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def scan_documents(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's row for each document: counts of base spans, digest of the base spans, all spans."""
    spark = docs.sparkSession
    rows = Ledger(spark, ledger_path or fresh_path(spark, "ledger")).scan(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), ["doc_id"], "text")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r[0] for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", *[count(r[0]) for r in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.lower(F.hex("blob")).alias("blob"))


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def pieces_sql(pattern: str, order: int, text: str = "t") -> str:
    """DuckDB columns: the matches of a kind, and the lengths of what lies between them."""
    return f"regexp_extract_all({text}, {quoted(pattern)}) AS m{order}, list_transform(string_split_regex({text}, {quoted(pattern)}), lambda x: length(x)) AS p{order}"


def spans_sql(name: str, order: int, keep: str) -> str:
    """DuckDB list of {s, o, k, m} of the kept matches of a kind: a match starts after all pieces and matches before it."""
    return f"""list_filter(list_transform(range(1, len(m{order}) + 1), lambda i: {{'s': CAST(list_sum(p{order}[1:i]) + coalesce(list_sum(list_transform(m{order}[1:i-1], lambda y: length(y))), 0) AS BIGINT), 'o': {order}, 'k': '{name}', 'm': m{order}[i]}}), lambda x: {keep})"""


JOINED = "array_to_string(list_transform({}, lambda x: x.k || ':' || CAST(x.s AS VARCHAR) || ':' || CAST(x.s + length(x.m) AS VARCHAR)), ',')"


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    re2 = {"hex": HEX, "jwt": JWT_RE2}
    patterns = [re2.get(k, p) for k, p, *_ in RULES]
    keeps = [f"length(regexp_extract(x.m, {quoted(p)}, {g})) >= {least}" for p, (_, _, least, g, _) in zip(patterns, RULES, strict=True)]
    # RE2 has no look-behind: the character before a JWT is part of the match, and taken off again
    cut = {"jwt": f"list_transform({{}}, lambda x: {{{{'s': x.s + length(x.m) - length(regexp_extract(x.m, 'eyJ.*', 0)), 'o': x.o, 'k': x.k, 'm': regexp_extract(x.m, 'eyJ.*', 0)}}}})"}
    spans = [cut.get(r[0], "{}").format(spans_sql(r[0], o, k)) for o, (r, k) in enumerate(zip(RULES, keeps, strict=True))]
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        e AS (SELECT doc_id, sha256(t) AS blob, {', '.join(pieces_sql(p, o) for o, p in enumerate(patterns))} FROM d),
        f AS (SELECT doc_id, blob, list_sort({' || '.join(spans)}) AS a FROM e)
        SELECT doc_id, {', '.join(f"CAST(len(list_filter(a, lambda x: x.k = '{r[0]}')) AS BIGINT) AS n_{r[0]}" for r in BASE)},
        sha256({JOINED.format("list_filter(a, lambda x: x.o < 3)")}) AS base_sha256, {JOINED.format('a')} AS spans, blob FROM f"""
