"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame and SQL functions only.

Matches come from regexp_extract_all, their positions from the lengths of the pieces that split leaves between them. The
patterns are those of the contract in a form that Java's matcher runs in linear time and without recursion: possessive
where nothing after could need a shorter match, and, where a start inside a run of characters fails whenever the start of
the run does, looked for at the start of a run (or right after a match) only.

A card is confirmed by Luhn's sum, an IBAN by its remainder 1 modulo 97. IBANs are proposed in two ways: unbroken runs of capitals
and digits of any country, as a whole; and, wherever a country of LENGTHS, two digits and as many characters as it has stand, in
printed form too, that is with or without one space after each four characters, also glued to other capitals or digits. Spaces
are taken out before the sum; of spans that overlap, the unbroken run counts, else the one that starts first. oracle() has the
unbroken runs only. A span scores the base of its kind, and more if a whole word for that kind stands in the 40 characters before
or after it; `score` is the best of the row, 0 without spans.

Defined results: a null text is an empty one, without spans; repeated rows give a row each; positions are code points with an
exclusive end; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values by the contract (all but iban): kind, pattern, the same for Java in linear time, quick test of a text.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
)
BASE = 4
#: Characters of an IBAN by country.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Base score of a kind, and words that raise it.
SCORES = {"email": (60, "mail|contact|write"), "ip": (50, "ip|host|server|address"), "card": (80, "card|visa|credit|debit|payment"), "phone": (50, "phone|tel|call|mobile|fax"), "iban": (90, "iban|account|bank")}
BONUS, NEAR = 15, 40


def whole_word(words: str) -> str:
    """A pattern for one of the words, not inside another."""
    return f"(?:^|[^a-z0-9])(?:{words})(?:$|[^a-z0-9])"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bind(value: str, name: str, body: str) -> str:
    """SQL that works out value once and uses it by name in body, however often."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sum_before(w: str) -> str:
    """SQL: for each number of array w (a name) the sum of those before it, by blocks of about the square root of its size."""
    total = "aggregate({}, 0L, (a, v) -> a + v)"
    blocks = f"transform(sequence(0, (size({w}) - 1) div k), g -> slice({w}, g * k + 1, k))"
    inner = f"transform(bs, (x, g) -> {bind(total.format('slice(sums, 1, g)'), 'before', f'transform(x, (v, i) -> before + {total.format("slice(x, 1, i)")})')})"
    body = bind(blocks, "bs", bind(f"transform(bs, x -> {total.format('x')})", "sums", f"flatten({inner})"))
    return f"if(size({w}) = 0, cast(array() as array<bigint>), {bind(f'cast(ceil(sqrt(size({w}))) as int)', 'k', body)})"


LUHN = "aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, int(substr(d, -i, 1)), if(int(substr(d, -i, 1)) > 4, int(substr(d, -i, 1)) * 2 - 9, int(substr(d, -i, 1)) * 2))) % 10 = 0"
MOD97 = "aggregate(split(concat(substr({0}, 5), substr({0}, 1, 4)), ''), 0, (a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + ascii(c) - 48) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"
#: SQL for a match x.m that counts.
KEEP = {
    "email": "true",
    "ip": r"forall(split(x.m, '[.]'), p -> p rlike '^0*+(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
    "card": rf"length(regexp_replace(x.m, '[^0-9]', '')) between 14 and 19 and exists(array(regexp_replace(x.m, '[^0-9]', '')), d -> {LUHN})",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) between 10 and 15",
    "iban": MOD97.format("x.m"),
}


def _printed(n: int) -> str:
    """What follows the country in an IBAN of n characters, with or without a space after each four."""
    full, rest = divmod(n - 4, 4)
    return "[0-9]{2}" + f"(?:\\x20?[A-Z0-9]{{4}}){{{full}}}" + (f"\\x20?[A-Z0-9]{{{rest}}}" if rest else "")


#: An IBAN of a known country; its first character where such a one follows, so that starts may be near each other; a quick test.
KNOWN_IBAN = "(?:" + "|".join(f"(?:{'|'.join(c.split())}){_printed(n)}" for n, c in LENGTHS.items()) + ")"
IBAN_START = f"(?={KNOWN_IBAN})[A-Z]"
IBAN_QUICK = r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}\x20?[A-Z0-9]{4}"
LONGEST = max(LENGTHS) + max(LENGTHS) // 4


def _add_known_ibans(found: str) -> str:
    """SQL: the IBANs of `found` (structs s, m), and those of known countries that overlap none of these and none before them."""
    text = f"regexp_extract(substring(t, cast(s + 1 as int), {LONGEST}), r'^{KNOWN_IBAN}', 0)"
    starts = f"zip_with({sum_before('w')}, slice(q_known, 1, size(w)), (a, c) -> a + c)"
    more = bind("transform(slice(q_known, 1, size(m_known)), c -> c + 1)", "w", f"transform({starts}, s -> named_struct('s', s, 'm', {text}))")
    more = f"filter({more}, x -> {bind("replace(x.m, ' ', '')", 'v', MOD97.format('v'))})"
    each = lambda rows, k: f"transform({rows}, x -> named_struct('s', x.s, 'k', {k}, 'm', x.m))"
    free = "size(acc) = 0 or x.s >= element_at(acc, -1).s + length(element_at(acc, -1).m)"
    step = f"if({free}, concat(acc, array(x)), if(x.k = 0, concat(slice(acc, 1, size(acc) - 1), array(x)), acc))"
    both = f"aggregate(array_sort(concat({each('u', 0)}, {each(more, 1)})), cast(array() as array<struct<s:bigint,k:int,m:string>>), (acc, x) -> {step})"
    return bind(found, "u", f"if(size(m_known) = 0, {each('u', 0)}, {both})")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: doc_id, spans as array<struct<s,o,k,m,e,score>> by start and kind."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    quote = lambda p: "r'" + p + "'"
    pieces = {}
    for kind, _, java, quick in KINDS:
        hit = F.expr(f"t rlike {quote(quick)}")
        pieces[f"m_{kind}"] = F.when(hit, F.expr(f"regexp_extract_all(t, {quote(java)}, 0)")).otherwise(F.array().cast("array<string>"))
        pieces[f"q_{kind}"] = F.when(hit, F.expr(f"transform(split(t, {quote(java)}, -1), x -> cast(length(x) as bigint))")).otherwise(F.array().cast("array<bigint>"))
    hit = F.expr(f"t rlike {quote(IBAN_QUICK)}")
    pieces["m_known"] = F.when(hit, F.expr(f"regexp_extract_all(t, {quote(IBAN_START)}, 0)")).otherwise(F.array().cast("array<string>"))
    pieces["q_known"] = F.when(hit, F.expr(f"transform(split(t, {quote(IBAN_START)}, -1), x -> cast(length(x) as bigint))")).otherwise(F.array().cast("array<bigint>"))
    held = base.withColumns(pieces)
    kinds = []
    for order, (kind, *_) in enumerate(KINDS):
        around = f"concat(substring(t, cast(greatest(x.s - {NEAR}, 0) + 1 as int), cast(least(x.s, {NEAR}) as int)), ' ', substring(t, cast(x.s + length(x.m) + 1 as int), {NEAR}))"
        low = f"translate({around}, '{UPPER}', '{LOWER}')"
        points, words = SCORES[kind][0], whole_word(SCORES[kind][1])
        starts = f"zip_with({sum_before('w')}, q, (a, c) -> a + c)"
        found = f"filter(zip_with({starts}, m, (a, c) -> named_struct('s', a, 'm', c)), x -> {KEEP[kind]})"
        found = bind(f"m_{kind}", "m", bind(f"slice(q_{kind}, 1, size(m))", "q", bind("zip_with(q, m, (a, c) -> a + length(c))", "w", found)))
        if kind == "iban":
            found = _add_known_ibans(found)
        kinds.append(f"transform({found}, x -> named_struct('s', x.s, 'o', {order}, 'k', '{kind}', 'm', x.m, 'e', x.s + length(x.m), 'score', {points} + if({low} rlike '{words}', {BONUS}, 0)))")
    return held.select("doc_id", F.expr(f"array_sort(concat({', '.join(kinds)}))").alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's row for each document: counts of base spans, digest of the base spans, all spans; n_iban, score."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["k"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["o"] < BASE)
    names = [k[0] for k in KINDS]
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0)).cast("long")
    return find(docs, id_col, text_col).select("doc_id", *[count(k) for k in names[:BASE]], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), *[count(k) for k in names[BASE:]], score.alias("score"))


def oracle() -> str:
    """The same rows in DuckDB SQL, with the patterns as the contract has them."""
    from .secrets import JOINED, pieces_sql, spans_sql

    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({digits}[-i] AS INT) ELSE (CAST({digits}[-i] AS INT) * 2) - CASE WHEN CAST({digits}[-i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    turned = "(x.m[5:] || x.m[1:4])"
    keep = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.m, '.'), lambda p: NOT regexp_full_match(p, '0*([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])'))) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({turned}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) AS BIGINT) = 1",
    }
    around = f"substr(t, greatest(x.s - {NEAR}, 0) + 1, least(x.s, {NEAR})) || ' ' || substr(t, x.s + length(x.m) + 1, {NEAR})"
    near = f"regexp_matches(translate({around}, '{UPPER}', '{LOWER}'), "
    score = "CASE x.k " + " ".join(f"WHEN '{k}' THEN {p} + CASE WHEN {near}'{whole_word(w)}') THEN {BONUS} ELSE 0 END" for k, (p, w) in SCORES.items()) + " END"
    names = [k[0] for k in KINDS]
    n = lambda k: f"CAST(len(list_filter(a, lambda x: x.k = '{k}')) AS BIGINT) AS n_{k}"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        e AS (SELECT doc_id, t, {', '.join(pieces_sql(p, o) for o, (_, p, *_) in enumerate(KINDS))} FROM d),
        f AS (SELECT doc_id, t, list_sort({' || '.join(spans_sql(k, o, keep[k]) for o, k in enumerate(names))}) AS a FROM e)
        SELECT doc_id, {', '.join(map(n, names))}, sha256({JOINED.format(f"list_filter(a, lambda x: x.o < {BASE})")}) AS base_sha256, {JOINED.format('a')} AS spans,
        CAST(coalesce(list_max(list_transform(a, lambda x: {score})), 0) AS BIGINT) AS score FROM f"""
