"""Sharding: a Feistel permutation with cycle walking over global row numbers. DataFrame and SQL functions only.

Row number x in 0..N-1 goes to y = P(x), its shard is y % shards and its slot y // shards, so either can be computed from
the other by anyone who knows N and the seed. P is a six-round Feistel network on Z_a x Z_a with a = ceil(sqrt(N)); a
value outside 0..N-1 is permuted again until it is inside. a * a exceeds N by at most 2 * sqrt(N), so this is rare.

Defined results: rows with a null id come first in the numbering; a null text counts as an empty one (size 1, CRC 0);
rows that are equal in id, CRC and size are numbered by a hash of the row, and wholly equal rows are interchangeable; an
empty table gives an empty result; columns beside id and text are carried or left out, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, table

ROUNDS = 6
PRIME = 2147483647
STEPS = 64


def round_keys(seed: int) -> list[int]:
    keys, x = [], (seed * 2 + 1) % PRIME
    for _ in range(ROUNDS):
        x = (x * 16807 + 12345) % PRIME
        keys.append(x)
    return keys


def permute_sql(x: str, a: int, keys: list[int]) -> str:
    """SQL of the Feistel network on Z_a x Z_a for the BIGINT expression x; products stay below 2^63 for a < 2^31."""
    mixed = f"((s.r * 48271 + k) % {PRIME}L)"
    f = f"(({mixed} * {mixed} + k * 7 + 3) % {PRIME}L)"
    ks = ", ".join(f"{k}L" for k in keys)
    return f"aggregate(array({ks}), named_struct('l', {x} div {a}L, 'r', {x} % {a}L), (s, k) -> named_struct('l', s.r, 'r', (s.l + {f}) % {a}L), s -> s.l * {a}L + s.r)"


def permuted(row_no: str, total: int, seed: int) -> Column:
    """A reproducible permutation of 0..total-1, applied to the column row_no."""
    a, keys = max(1, math.isqrt(max(total, 1) - 1) + 1), round_keys(seed)
    first = permute_sql("x", a, keys)
    walk = f"aggregate(sequence(1, {STEPS}), y, (z, i) -> if(z < {total}L, z, {permute_sql('z', a, keys)}))"
    inner = f"transform(array({first}), y -> if(y < {total}L, y, {walk}))[0]"
    return F.expr(f"transform(array({row_no}), x -> {inner})[0]")


def shard(docs: DataFrame, shards: int = 16, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row for each of docs: id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard, row_no.

    The law is `rows`: shard sizes differ by one row at most, slots run from 0 without gaps; grown_shard is null.
    carry: also the row itself, as struct column `row`.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    if not carry:
        narrow = table(narrow, "sizes")  # numbering looks at its rows twice, and texts need to be read but once
    rows, total = numbered(narrow, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    rows = rows.withColumn("_y", permuted("row_no", total, seed))
    return rows.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_y"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_y div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
        *(["row"] if carry else []),
    )


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 * (c & 1))
        out.append(c)
    return out


def oracle(shards: int = 16, seed: int = 11) -> str:
    """The same rows in DuckDB SQL, for tables without repeated ids."""
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, size), lambda i: CAST('0x' || h[2 * i - 1:2 * i] AS BIGINT))), lambda c, b: xor(c >> 8, ({_crc_table()})[xor(c, b) % 256 + 1])), 4294967295)"

    def permuted(x: str) -> str:
        out = f"{{'l': {x} // a, 'r': {x} % a}}"
        for k in round_keys(seed):
            mixed = f"((s.r * 48271 + {k}::BIGINT) % {PRIME})"
            out = f"list_transform([{out}], lambda s: {{'l': s.r, 'r': (s.l + ({mixed} * {mixed} + {k}::BIGINT * 7 + 3) % {PRIME}) % a}})[1]"
        return f"list_transform([{out}], lambda s: s.l * a + s.r)[1]"

    return f"""WITH RECURSIVE d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents),
        e AS (SELECT doc_id, size, CAST({crc} AS BIGINT) AS text_crc32 FROM d),
        f AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_no, count(*) OVER () AS n FROM e),
        g AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM f),
        p AS (SELECT row_no, n, a, {permuted('row_no')} AS y FROM g UNION ALL SELECT row_no, n, a, {permuted('y')} FROM p WHERE y >= n)
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % {shards} AS INT) AS shard, y // {shards} AS slot, CAST(NULL AS INT) AS grown_shard, row_no FROM g JOIN (SELECT row_no, y FROM p WHERE y < n) USING (row_no)"""
