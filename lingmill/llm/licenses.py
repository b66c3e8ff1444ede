"""License scans by canonical digests. DataFrame and SQL functions only.

A text is brought to a canonical form: A-Z in lower case, copyright lines gone, equivalent spellings made one, everything
but letters and digits made single spaces. Its SHA-256 is joined by hash to the digests of known texts, canonical in the
same way: whole licence texts against whole texts, and licence notices against whole lines. Known are the notices of KNOWN and
license_digests.tsv, a shipped table of whole texts of twelve licences in their usual wordings and wrappings, which
license_table makes; oracle() knows KNOWN only, which is enough for tables without whole licence texts.

Defined results: a null text is an empty one and matches nothing; repeated rows give a row each; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings that count as equal, as published for the matching of licences.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("organisation", "organization"),
    ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("per cent", "percent"),
    ("https://", "http://"),
    ("&", " and "),
)
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*"
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}\n]+"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known texts: licence, text. Notices are single lines; whole texts may have several.
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),  # a notice that stands beside many licences, and none itself
)


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks."""
    out = F.translate(text, UPPER, LOWER)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.when(F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("(c)")) | F.contains(out, F.lit("©")), F.regexp_replace(out, COPYRIGHT, "$1")).otherwise(out)
    return F.regexp_replace(out, OTHER, " ")


def canonical(lines: Column) -> Column:
    """The canonical form as one line."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@cache
def shipped() -> str:
    """The shipped table of whole texts: lines of licence, tab, digest."""
    return files(__package__).joinpath("license_digests.tsv").read_text().strip("\n")


def known_rows() -> int:
    return len(KNOWN) + shipped().count("\n") + 1


def known_digests(spark: SparkSession, known: tuple = KNOWN, whole_texts: bool = True) -> DataFrame:
    """license, digest of each known text, and of the shipped whole texts; one row a digest (the first licence by name)."""
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in known])).alias("r")).select("r.*")
    rows = rows.select(digest(canonical(canonical_lines(F.col("text")))).alias("digest"), "license")
    if whole_texts:
        lines = spark.range(1).select(F.explode(F.split(F.lit(shipped()), "\n")).alias("r")).select(F.split("r", "\t").alias("r"))
        rows = rows.union(lines.select(F.col("r")[1].alias("digest"), F.col("r")[0].alias("license")))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, known_rows: int, id_col: str = "doc_id", text_col: str = "text", bound: int = 200_000) -> DataFrame:
    """A row for each of docs: doc_id, digest (of the whole text), text_license, n_notices, notices (licences of its lines, sorted).

    known(license, digest) is broadcast if it has at most `bound` rows; otherwise Spark joins by shuffling.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), canonical_lines(text).alias("_t"))
    units = F.concat(F.array(canonical(F.col("_t"))), F.transform(F.split("_t", "\n"), lambda x: F.trim(x)))
    units = rows.select("doc_id", "_row", F.posexplode(units).alias("_pos", "_unit")).filter((F.col("_pos") == 0) | (F.col("_unit") != ""))
    hashed = units.select("doc_id", "_row", "_pos", digest(F.col("_unit")).alias("digest"))
    found = hashed.join(F.broadcast(known) if known_rows <= bound else known, "digest", "left").filter((F.col("_pos") == 0) | F.col("license").isNotNull())
    whole, line = F.col("_pos") == 0, F.col("_pos") > 0
    per = found.groupBy("_row", "doc_id").agg(
        F.max(F.when(whole, F.col("digest"))).alias("digest"),
        F.max(F.when(whole, F.col("license"))).alias("text_license"),
        F.count(F.when(line, 1)).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license")))), ",").alias("notices"),
    )
    return per.drop("_row")


def scan_documents(docs: DataFrame) -> DataFrame:
    return scan(docs, known_digests(docs.sparkSession), known_rows())


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    def lines(text: str) -> str:
        low = f"translate({text}, '{UPPER}', '{LOWER}')"
        for a, b in SPELLINGS:
            low = f"replace({low}, {q(a)}, {q(b)})"
        return f"regexp_replace(regexp_replace({low}, {q(COPYRIGHT)}, '\\1', 'g'), {q(OTHER)}, ' ', 'g')"

    one = lambda text: f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'), ' ')"
    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN)
    return f"""WITH known AS (SELECT sha256({one(lines('text'))}) AS digest, min(license) AS license FROM (VALUES {values}) v(license, text) GROUP BY 1),
        d AS (SELECT doc_id, row_number() OVER () AS r, {lines("coalesce(text, '')")} AS t FROM documents),
        u AS (SELECT doc_id, r, 0 AS pos, {one('t')} AS unit FROM d UNION ALL SELECT doc_id, r, 1, trim(unnest(string_split(t, chr(10))), ' ') FROM d),
        h AS (SELECT doc_id, r, pos, sha256(unit) AS digest FROM u WHERE pos = 0 OR unit <> '')
        SELECT doc_id, max(CASE WHEN pos = 0 THEN digest END) AS digest, max(CASE WHEN pos = 0 THEN license END) AS text_license,
            count(CASE WHEN pos = 1 THEN license END) AS n_notices, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN pos = 1 THEN license END) FILTER (pos = 1 AND license IS NOT NULL)), ','), '') AS notices
        FROM h LEFT JOIN known USING (digest) GROUP BY r, doc_id"""
