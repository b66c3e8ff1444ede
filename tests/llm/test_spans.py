"""Secrets, personal data and licences against plain Python or SQL."""

import hashlib
import random
import re
import textwrap
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lingmill.llm import license_table, licenses, pii, queries, secrets

from .conftest import SF, texts_of

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def digest(spans, order):
    spans = sorted(spans, key=lambda s: (s[1], order.index(s[0])))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secret_row(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = ["assign", "access", "hex"]
    return [sum(k == s[0] for s in found) for k in kinds] + [digest(found, kinds)]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii_row(text):
    text, found = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    return [sum(k == s[0] for s in found) for k in kinds] + [digest(found, kinds)]


def noise(alphabet, n, seed):
    r = random.Random(seed)
    return [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))) for i in range(n)]


def compare(rows, texts, expected, columns):
    got = sorted((str(r["doc_id"]), *[r[c] for c in columns]) for r in rows.collect())
    assert got == sorted((str(i), *expected(t)) for i, t in texts)


SECRET = ["n_assign", "n_access", "n_hex", "base_sha256"]
PII = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def test_secrets_by_hand(spark, messy, empty):
    compare(secrets.scan_documents(messy), texts_of(messy), secret_row, SECRET)
    texts = noise(["token", "Secret", "API_KEY", "paſsword", "=", ": ", " ", "'", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é", "x", "="], 1500, 1)
    compare(secrets.scan_documents(spark.createDataFrame(texts, "doc_id long, text string")), texts, secret_row, SECRET)
    assert secrets.scan_documents(empty).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    first = spark.createDataFrame([("a", 1, "token: abcdefgh1"), ("b", 1, "token: abcdefgh1"), ("c", 1, None)], "path string, version int, content string")
    assert {(r["path"], len(r["spans"])) for r in ledger.scan(first, ["path", "version"], "content").collect()} == {("a", 1), ("b", 1), ("c", 0)}
    assert ledger.read().count() == 2
    second = first.union(spark.createDataFrame([("a", 2, "clean"), ("d", 1, "token: abcdefgh1")], first.schema))
    assert sum(len(r["spans"]) for r in ledger.scan(second, ["path", "version"], "content").collect()) == 3
    assert ledger.read().count() == 3 and ledger.read().select("blob").distinct().count() == 3
    assert ledger.scan(second, ["path"], "content", rules=secrets.BASE).count() == 5 and ledger.read().count() == 6
    ledger.read().write.mode("append").parquet(str(tmp_path / "ledger"))  # as if two scans had run at once
    assert sum(len(r["spans"]) for r in ledger.scan(second, ["path", "version"], "content").collect()) == 3
    assert ledger.scan(second, ["path"], "content").count() == 5
    with pytest.raises(ValueError):
        ledger.scan(second.withColumnRenamed("path", "blob"), ["blob"], "content")


def test_long_runs_take_linear_time():
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    began = time.perf_counter()
    for text in ("eyJ" * 3_500_000, "eyJaaaaaaaa." * 800_000, "-----BEGIN " * 900_000, "ghp_" * 2_000_000, "token" + " " * 5_000_000, "xoxb-" * 100 + "a" * 5_000_000):
        secrets.spans_of(text)
    assert time.perf_counter() - began < 60
    assert secrets.spans_of(f"x {jwt} {jwt}{jwt}") == [("jwt", 2, 2 + len(jwt)), ("jwt", 3 + len(jwt), 3 + 2 * len(jwt) + jwt.index("."))]
    assert secrets.spans_of("x" + jwt) == []


def test_pii_by_hand(spark, messy, empty):
    compare(pii.scan_documents(messy), texts_of(messy), pii_row, PII)
    texts = noise(["1", "22", "255", "0004", ".", ".", "-", " ", "4111111111111111", "+", "+1", "(", "a", "@", "b.c", "é", "𝒳", "5555 5555 5555 4444"], 2500, 2)
    compare(pii.scan_documents(spark.createDataFrame(texts, "doc_id long, text string")), texts, pii_row, PII)
    assert pii.scan_documents(empty).count() == 0


def test_pii_long_texts_and_checksums(spark):
    texts = [(1, "1 " * 20_000), (2, "1." * 20_000), (3, "a." * 20_000 + "@"), (4, "x@" + "a." * 20_000 + "b"), (5, "1.2.3.4 " * 1500), (6, "+1" + " (" * 20_000)]
    compare(pii.scan_documents(spark.createDataFrame(texts, "doc_id long, text string")), texts, pii_row, PII)
    rows = spark.createDataFrame([(1, "pay to iban GB82WEST12345698765432 now"), (2, "GB83WEST12345698765432"), (3, "4111111111111111")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_iban"], r["score"]) for r in pii.scan_documents(rows).collect()}
    assert got == {1: (1, 105), 2: (0, 0), 3: (0, 80)}


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_token_counts", "op4_source_mix", "op5_jaccard_join", "op6_license_scan", "op7_pii", "op8_sharding"])
def test_against_sql(spark, name, tmp_path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' UNION ALL SELECT 10000000, 'a eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl, xeyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl', 'en', 's', 1")
    con.sql("SELECT * FROM documents").write_parquet(str(tmp_path / "documents.parquet"))
    got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    norm = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).to_numpy().tolist()))
    assert norm(got) == norm(want)


def test_context_words_are_whole(spark):
    ip = "10.1.2.3"
    texts = [("shipping " + ip, 50), ("the ip: " + ip, 65), (ip + " is our server", 65), (ip + " recipe", 50), ("hotel +1 555 123 4567", 50), ("tel +1 555 123 4567", 65), ("basically +1 555 123 4567", 50), ("x" * 50 + " host " + "y" * 50 + " " + ip, 50)]
    rows = pii.scan_documents(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string"))
    assert {r["doc_id"]: r["score"] for r in rows.collect()} == {i: n for i, (_, n) in enumerate(texts)}


def test_ibans_in_print_and_glued(spark):
    gb, de, no = "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"
    many = (gb + " ") * 1500
    texts = [
        (1, f"é pay to iban {gb} now", [(14, 41)]),
        (2, f"{de} BIC COBADEFF, {no}.", [(0, 27), (42, 60)]),
        (3, "XX" + gb.replace(" ", "") + "10", [(2, 24)]),
        (4, gb.replace("82", "83") + " " + de.replace("89", "88"), []),
        (5, gb.replace("WEST", "W EST") + " " + gb.replace(" ", "  "), []),
        (6, gb.replace(" ", "") + " " + gb, [(0, 22), (23, 50)]),
        (7, many, [(28 * i, 28 * i + 27) for i in range(1500)]),
    ]
    rows = pii.scan_documents(spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string"))
    got = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("iban:")] for r in rows.collect()}
    assert got == {i: spans for i, _, spans in texts}


def test_licenses(spark, messy, empty):
    assert licenses.scan_documents(empty).count() == 0
    known = {license_table.canonical(t): n for n, t in sorted(licenses.KNOWN, reverse=True)}
    want = []
    for i, t in texts_of(messy):
        found = [known[c] for c in (license_table.canonical(x) for x in (t or "").split("\n")) if c in known]
        want.append((str(i), hashlib.sha256(license_table.canonical(t or "").encode()).hexdigest(), known.get(license_table.canonical(t or "")), len(found), ",".join(sorted(set(found)))))
    assert sorted(want, key=str) == sorted(((str(r["doc_id"]), r["digest"], r["text_license"], r["n_notices"], r["notices"]) for r in licenses.scan_documents(messy).collect()), key=str)
    mit = licenses.MIT.replace("sublicense", "sub-license").replace(",", " ,").upper()
    rows = spark.createDataFrame([(1, "Copyright (c) 2024 Someone\n" + mit), (2, "text\n  released under the   mit licence  \nLicensed under CC BY 4.0"), (3, None), (4, "x " * 100_000), (2, "Released under the MIT License!")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text_license"], r["n_notices"], r["notices"]) for r in licenses.scan_documents(rows).fillna("", ["text_license"]).collect())
    assert got == [(1, "MIT", 0, ""), (2, "", 2, "CC-BY-4.0,MIT"), (2, "MIT", 1, "MIT"), (3, "", 0, ""), (4, "", 0, "")]
    known = licenses.known_digests(spark)
    assert licenses.scan(rows, known, 10**9).select("doc_id", "notices").exceptAll(licenses.scan_documents(rows).select("doc_id", "notices")).count() == 0
    assert known.groupBy("digest").count().filter(F.col("count") > 1).count() == 0


BSD = """Copyright (c) 2019, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_whole_licenses(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    texts = [(p.stem, p.read_text()) for p in sorted(folder.glob("*.txt"))]
    assert [n for n, _ in texts] == ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    texts += [("BSD-2-Clause", BSD % ""), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD % NAMES), ("MIT", "\n\n".join(textwrap.fill(x, 72) for x in licenses.MIT.split("\n"))), ("ISC", licenses.ISC)]
    by = dict(texts)
    texts += [("GPL-3.0", by["GPL-3.0"][by["GPL-3.0"].index("Preamble\n") :]), ("Apache-2.0", by["Apache-2.0"].split("APPENDIX")[0]), ("Unlicense", "The Unlicense\n\n" + by["Unlicense"])]
    texts += [("", by["GPL-3.0"].replace("freedom", "liberty")), ("", BSD % "" + "Not quite.")]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] or "" for r in licenses.scan_documents(rows).collect()}
    assert [(n, got[i]) for i, (n, _) in enumerate(texts)] == [(n, n) for n, _ in texts]


def test_shipped_digests_are_those_of_the_texts():
    rows = [line.split("\t") for line in licenses.shipped().split("\n")]
    assert {d: n for n, d in rows} == license_table.table() and len(rows) + len(licenses.KNOWN) == licenses.known_rows()
