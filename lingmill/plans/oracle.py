"""DuckDB SQL for the registered queries, written from the rules and not from the DataFrame plans."""

from __future__ import annotations

from ..functions import catalog
from . import fixed

#: RE2's names of the scripts, where they differ from ours.
SCRIPTS = {"HAN": r"\p{Han}", "JA_KANA": r"\p{Hiragana}\p{Katakana}"}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def letters(alphabet: str) -> str:
    return SCRIPTS.get(alphabet) or rf"\p{{{alphabet.capitalize()}}}"


def pattern(alphabets: list[str], digit: str = "0-9") -> str:
    """Digits, a letter, letters and digits; then any number of apostrophe, digits, letter, letters and digits; then maybe an apostrophe and digits."""
    quote = "['’\u0092]"
    each = [f"[{digit}]*[{c}][{c}{digit}]*" for c in map(letters, alphabets)]
    return q("|".join(f"{x}(?:{quote}{x})*(?:{quote}[{digit}]*)?" for x in each))


FOLD = "translate(lower(translate({}, 'İ', 'i')), '’\u0092', '''''')"
SKIPPED = f"regexp_full_match(word, '{fixed.SKIPWORD}')"


def values(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else ("true" if v is True else "false" if v is False else repr(v))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns}))"


def train_ctes(source: str, where: str = "true", alphabet: str = "LATIN", skips: str = "false") -> str:
    """CTEs tr_words(lang, word, cnt), ng(lang, n, gram, cnt, total, u), tp(lang, word, cnt, total, u) from source(lang, text)."""
    return f"""
    tr_raw AS (SELECT lang, unnest(regexp_extract_all(coalesce(text, ''), {pattern([alphabet], chr(92) + 'p{Nd}')})) AS c FROM {source} WHERE lang IS NOT NULL AND {where}),
    tr_words AS (SELECT lang, word, count(*) AS cnt FROM (SELECT lang, regexp_replace({FOLD.format('c')}, '''$', '') AS word FROM tr_raw WHERE NOT regexp_matches(c, '\\p{{Nd}}'))
        WHERE length(word) - length(replace(word, '''', '')) <= 1 AND NOT ({skips}) GROUP BY 1, 2),
    ng_counts AS (SELECT lang, n, substr(word, i, n) AS gram, CAST(sum(cnt) AS BIGINT) AS cnt FROM
        (SELECT lang, word, cnt, n, unnest(range(1, length(word) - n + 2)) AS i FROM tr_words, (SELECT CAST(unnest(range(1, 6)) AS INT) AS n) WHERE length(word) < 64 AND length(word) >= n) GROUP BY 1, 2, 3),
    ng AS (SELECT lang, n, gram, cnt, total, CAST(round(ln(cnt / total) * 1e6) AS BIGINT) AS u FROM (SELECT *, CAST(sum(cnt) OVER (PARTITION BY lang, n) AS BIGINT) AS total FROM ng_counts)),
    tp_total AS (SELECT lang, CAST(sum(cnt) AS BIGINT) AS total FROM tr_words GROUP BY 1),
    tp_counts AS (SELECT lang, word, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT lang, cnt, unnest(CASE WHEN strpos(word, '''') > 0 THEN [word[:strpos(word, '''')], word[strpos(word, '''') + 1:]] ELSE [word] END) AS word FROM tr_words) WHERE word <> '' GROUP BY 1, 2),
    tp AS (SELECT lang, word, cnt, total, CAST(round(ln(cnt / total) * 1e6) AS BIGINT) AS u FROM tp_counts JOIN tp_total USING (lang) WHERE length(word) > 1 OR unicode(word) >= 128)"""


def word_ctes(texts: str, key: str, alphabets: list[str]) -> str:
    """CTE words(key, script, word, cnt) from texts(key, text)."""
    script = "CASE " + " ".join(f"WHEN regexp_matches(c, '[{letters(a)}]') THEN '{a}'" for a in alphabets) + " END"
    return f"""
    raw AS (SELECT {key}, unnest(regexp_extract_all(coalesce(text, ''), {pattern(alphabets)})) AS c FROM {texts}),
    scripted AS (SELECT {key}, c, {script} AS script FROM raw),
    lowered AS (SELECT {key}, script, {FOLD.format("regexp_replace(c, '[0-9]', '', 'g')")} AS w FROM scripted WHERE NOT (script = 'LATIN' AND regexp_matches(c, '[0-9]'))),
    cut AS (SELECT {key}, script, unnest(CASE WHEN script IN ('HAN', 'JA_KANA') THEN regexp_extract_all(w, '(?s).{{1,256}}') ELSE [substr(w, 1, 64)] END) AS w FROM lowered),
    words AS (SELECT {key}, script, regexp_replace(w, '''$', '') AS word, count(*) AS cnt FROM cut WHERE w NOT IN ('', '''') GROUP BY ALL)"""


def cj_train_ctes(source: str) -> str:
    """CTE cjm(lang, n, gram, u) from source(lang, text)."""
    return f"""
    cj_run AS (SELECT lang, unnest(regexp_extract_all(coalesce(text, ''), '{letters("HAN")}{{1,256}}|[{letters("JA_KANA")}]{{1,256}}')) AS run FROM {source}),
    cj_counts AS (SELECT lang, n, substr(run, i, n) AS gram, count(*) AS cnt FROM (SELECT lang, run, n, unnest(range(1, length(run) - n + 2)) AS i FROM cj_run, (SELECT CAST(unnest([1, 2]) AS INT) AS n) WHERE length(run) >= n) GROUP BY 1, 2, 3),
    cjm AS (SELECT lang, n, gram, CAST(round(ln(cnt / sum(cnt) OVER (PARTITION BY lang, n)) * 1e6) AS BIGINT) AS u FROM cj_counts)"""


def cj_ctes(k: str, languages: list[str], boosts: dict | None = None, share: float = 0.01, floor_u: int = -12_000_000) -> str:
    """CTE cj(key, detected, gap, pred) of the texts in which Han and kana weigh more than any other script, from words, prof, cjm."""
    own = [x for x in languages if x in ("zh-hans", "zh-hant", "ja")]
    rows = values([(x, i, float((boosts or {}).get(x, 0.0))) for i, x in enumerate(own)], "lang, o, b")
    return f"""
    cj_w AS (SELECT {k}, CAST(sum(chars * CASE script WHEN 'HAN' THEN 3 ELSE 2 END) AS DOUBLE) AS w, sum(CASE WHEN script = 'JA_KANA' THEN chars ELSE 0 END) AS kana, sum(chars) AS n FROM prof WHERE script IN ('HAN', 'JA_KANA') GROUP BY ALL),
    cj_other AS (SELECT {k}, max(chars * weight) AS ow FROM prof JOIN scripts USING (script) WHERE script NOT IN ('HAN', 'JA_KANA') GROUP BY ALL),
    cj_text AS (SELECT {k}, kana, n FROM cj_w LEFT JOIN cj_other USING ({k}) WHERE w > coalesce(ow, 0)),
    cj_tile AS (SELECT {k}, n, substr(word, i, n) AS gram, sum(cnt) AS c FROM (SELECT {k}, word, cnt, n, unnest(range(1, length(word) - n + 2)) AS i FROM words, (SELECT CAST(unnest([1, 2]) AS INT) AS n) WHERE script IN ('HAN', 'JA_KANA') AND length(word) >= n) GROUP BY ALL),
    cj_sum AS (SELECT {k}, lang, o, b, CAST(sum(coalesce(u, {floor_u}) * c) AS BIGINT) AS u, CAST(sum(c) AS BIGINT) AS n, count(u) AS hits FROM cj_tile CROSS JOIN {rows} LEFT JOIN (SELECT lang, n, gram, u FROM cjm WHERE u >= {floor_u}) USING (lang, n, gram) GROUP BY ALL),
    cj_tot AS (SELECT {k}, lang, o, t + b * abs(t) AS t, sum(hits) OVER (PARTITION BY {k}) AS hits FROM (SELECT *, u / 1e6 / n AS t FROM cj_sum)),
    cj_best AS (SELECT {k}, arg_min(lang, struct_pack(t := -t, o := o)) AS lang, max(t) AS t1, list_sort(list(t), 'DESC')[2] AS t2 FROM cj_tot WHERE hits > 0 GROUP BY ALL),
    cj AS (SELECT {k}, CASE WHEN kana > {share} * n THEN 'ja' WHEN coalesce(t1, 0) <> 0 THEN lang END AS detected, CASE WHEN kana > {share} * n THEN 1.0 WHEN coalesce(t2, 0) = 0 THEN 0.0 ELSE round(1 - t1 / t2, 6) END AS gap, CASE WHEN kana > {share} * n THEN 'JA_KANA' ELSE 'HAN' END AS pred FROM cj_text LEFT JOIN cj_best USING ({k}))"""


def detect_ctes(
    texts: str, key: str, languages: list[str], *, model: str = "", floor: float = -12.0, tw_floor: float = -12.0, min_ngram: int = 1, stop: int = 3, max_ngram: int = 5, topwords: bool = True, boosts: dict | None = None, grouped: str | None = None, cj: bool = False
) -> str:
    """CTEs up to dec(key, detected, gap, num_words, num_chars, num_lookups) and tot(key, lang, total, ...).

    texts: name of a relation with key columns and text; model: CTEs that give ng(lang, n, gram, u) and tp(lang, word, u);
    grouped: columns of key to which evidence is added up before deciding (default: key).
    """
    languages = catalog.ordered(languages)
    used = {a for x in languages for a in catalog.BY_ISO[x].alphabets}
    alphabets = [a for a in catalog.ALPHABETS if a in used]
    users = {a: [x for x in languages if a in catalog.BY_ISO[x].alphabets] for a in alphabets}
    lang_rows = values([(x, i, float((boosts or {}).get(x, 0.0))) for i, x in enumerate(languages)], "lang, lang_ord, boost")
    script_rows = values([(a, i, catalog.ALPHABETS[a][0], users[a][0] if len(users[a]) == 1 or (cj and a in ("HAN", "JA_KANA")) else None) for i, a in enumerate(alphabets)], "script, alpha_ord, weight, only_lang")
    user_rows = values([(a, x) for a in alphabets for x in users[a]], "script, lang")
    shared = [x for x in languages if x not in catalog.GROUPS["cj"] and any(len(users[a]) > 1 for a in catalog.BY_ISO[x].alphabets)]
    f_u, t_u = round(floor * 1e6), round(tw_floor * 1e6)
    k = grouped or key
    skip = SKIPPED
    has = "strpos(word[2:], '''') > 0 AND strpos(word[2:], '''') + 1 < length(word) AND word[1] <> ''''"
    at = "(strpos(word[2:], '''') + 1)"
    eligible = "(length(word) > 1 OR unicode(word) >= 128)"
    tw_ctes = f"""
    mt AS (SELECT lang, word, u FROM tp WHERE lang IN ({', '.join(map(q, languages))}) AND u >= {t_u} AND {eligible} AND NOT {skip}),
    tried AS (SELECT script, word, NOT one AND {eligible} AS go, word IN (SELECT word FROM mt) AS whole FROM dict),
    parts AS (SELECT script, word AS w, unnest([word[:{at}], word[{at} + 1:]]) AS part, length(word[{at} + 1:]) > 1 AS two FROM tried WHERE go AND NOT whole AND length(word) > 2 AND {has}),
    lk AS (SELECT script, word, CAST(go AS BIGINT) + CASE WHEN go AND NOT whole AND length(word) > 2 AND {has} AND length(word[{at} + 1:]) > 1 THEN 1 ELSE 0 END AS lookups FROM tried),
    tw_hit AS (SELECT t.script, t.word, lang, u FROM tried t JOIN mt USING (word) WHERE go UNION ALL SELECT p.script, w, lang, u FROM parts p JOIN mt ON mt.word = p.part WHERE part LIKE '%''' OR length(part) > 1)"""
    no_tw = """
    lk AS (SELECT script, word, 0 AS lookups FROM dict),
    tw_hit AS (SELECT script, word, '' AS lang, 0 AS u FROM dict WHERE false)"""
    return f"""{model + ',' if model else ''}{word_ctes(texts, key, alphabets)},
    scripts AS {script_rows}, langs AS {lang_rows}, script_langs AS {user_rows},
    dict AS (SELECT DISTINCT script, word, only_lang IS NOT NULL AS one FROM words JOIN scripts USING (script) {f'WHERE only_lang IS NOT NULL OR NOT {skip}' if topwords else ''}),
    mn AS (SELECT lang, n, gram, u FROM ng WHERE lang IN ({', '.join(map(q, shared)) or "''"}) AND u >= {f_u} AND n <= 5),
    tile AS (SELECT script, word, n, i, substr(word, i, n) AS gram FROM (SELECT script, word, n, unnest(range(1, length(word) - n + 2)) AS i FROM dict, (SELECT CAST(unnest(range({min_ngram}, {max_ngram + 1})) AS INT) AS n) WHERE NOT one AND length(word) >= n)),
    known AS (SELECT DISTINCT n, gram FROM mn),
    cover AS (SELECT script, word, n, bool_and(k.gram IS NOT NULL) AS whole FROM tile LEFT JOIN known k USING (n, gram) GROUP BY 1, 2, 3),
    from_n AS (SELECT script, word, coalesce(max(CASE WHEN whole AND n <= {stop} THEN n END), {min_ngram}) AS lo FROM cover GROUP BY 1, 2),
    ng_hit AS (SELECT script, word, lang, u FROM tile JOIN from_n USING (script, word) JOIN mn USING (n, gram) WHERE n >= lo),
    {tw_ctes if topwords else no_tw},
    hit AS (SELECT script, word, lang, sum(nu) AS ng_u, sum(nh) AS ng_hits, sum(tu) AS tw_u, sum(th) AS tw_hits FROM (SELECT script, word, lang, u AS nu, 1 AS nh, 0 AS tu, 0 AS th FROM ng_hit UNION ALL SELECT script, word, lang, 0, 0, u, 1 FROM tw_hit) GROUP BY 1, 2, 3),
    ev AS (SELECT {k}, lang, CAST(sum(ng_u * cnt) AS BIGINT) AS ng_u, CAST(sum(ng_hits * cnt) AS BIGINT) AS ng_hits, CAST(sum(tw_u * cnt) AS BIGINT) AS tw_u, CAST(sum(tw_hits * cnt) AS BIGINT) AS tw_hits FROM words JOIN hit USING (script, word) GROUP BY ALL),
    prof AS (SELECT {k}, script, sum(length(word) * cnt) AS chars, sum(cnt) AS nw, sum(lookups * cnt) AS lookups FROM words JOIN lk USING (script, word) GROUP BY ALL)"""


def decide_ctes(k: str, languages: list[str], floor: float = -12.0, tw_floor: float = -12.0, cj: bool = False, boosts: dict | None = None) -> str:
    """CTEs dec and tot from ev, prof, scripts, langs, script_langs; with cj from words and cjm, too (for models in which no other
    script is shared, so that a text of unknown Chinese or Japanese is unknown)."""
    f_u, t_u = round(floor * 1e6), round(tw_floor * 1e6)
    own, heavy, decided = "", "w DESC, alpha_ord", "dec AS (SELECT * FROM dec0)"
    if cj:
        own, heavy = cj_ctes(k, catalog.ordered(languages), boosts) + ",", "w DESC, script IN ('HAN', 'JA_KANA'), alpha_ord"
        decided = f"""dec AS (SELECT {k}, CASE WHEN c.pred IS NULL THEN d.detected ELSE coalesce(c.detected, 'unknown') END AS detected, CASE WHEN c.pred IS NULL THEN d.gap ELSE c.gap END AS gap, num_words, num_chars, num_lookups, coalesce(c.pred, d.pred) AS pred FROM dec0 d LEFT JOIN cj c USING ({k}))"""
    return f"""{own}
    top AS (SELECT {k}, script AS pred, only_lang, row_number() OVER (PARTITION BY {k} ORDER BY {heavy}) AS r, CAST(sum(nw) OVER (PARTITION BY {k}) AS BIGINT) AS num_words, CAST(sum(chars) OVER (PARTITION BY {k}) AS BIGINT) AS num_chars, CAST(sum(lookups) OVER (PARTITION BY {k}) AS BIGINT) AS num_lookups FROM (SELECT *, chars * weight AS w FROM prof JOIN scripts USING (script))),
    pr AS (SELECT {k}, pred, only_lang, num_words, num_chars, num_lookups FROM top WHERE r = 1),
    dense AS (SELECT pr.*, langs.*, coalesce(ng_u, 0) AS ng_u, coalesce(ng_hits, 0) AS ng_hits, coalesce(tw_u, 0) AS tw_u, coalesce(tw_hits, 0) AS tw_hits FROM pr CROSS JOIN langs LEFT JOIN ev USING ({k}, lang)),
    norm AS (SELECT *, max(ng_hits) OVER (PARTITION BY {k}) AS nm, max(tw_hits) OVER (PARTITION BY {k}) AS tm FROM dense),
    parts2 AS (SELECT *, CASE WHEN nm > 0 THEN (ng_u + (nm - ng_hits) * {f_u}) / 1e6 / nm ELSE (ng_u + (nm - ng_hits) * {f_u}) / 1e6 END AS ngs, CASE WHEN tm > 0 THEN (tw_u + (tm - tw_hits) * {t_u}) / 1e6 / tm ELSE 0.0::DOUBLE END AS tws, CASE WHEN num_lookups > 0 THEN tm / num_lookups ELSE 0.0::DOUBLE END AS r FROM norm),
    blend AS (SELECT *, CASE WHEN r < 0.5 THEN r * 0.5 ELSE r * 0.8 END AS f FROM parts2),
    tot0 AS (SELECT *, CASE WHEN f = 0 THEN ngs ELSE ngs * (1 - f) + tws * f END AS t0 FROM blend),
    tot AS (SELECT *, t0 + boost * abs(t0) AS total FROM tot0),
    ranked AS (SELECT {k}, total, t.lang, row_number() OVER (PARTITION BY {k} ORDER BY total DESC, lang_ord) AS r FROM tot t JOIN script_langs s ON s.script = t.pred AND s.lang = t.lang WHERE only_lang IS NULL),
    best AS (SELECT {k}, max(CASE WHEN r = 1 THEN total END) AS t1, max(CASE WHEN r = 2 THEN total END) AS t2, max(CASE WHEN r = 1 THEN lang END) AS lang FROM ranked GROUP BY ALL),
    dec0 AS (SELECT {k}, CASE WHEN only_lang IS NOT NULL THEN only_lang WHEN coalesce(t1 = 0, true) THEN 'unknown' ELSE best.lang END AS detected,
        CASE WHEN only_lang IS NOT NULL THEN 1.0 WHEN coalesce(t1 = 0, true) THEN 0.0 WHEN coalesce(t2, 0) = 0 THEN 0.0 ELSE round(1 - t1 / t2, 6) END AS gap, num_words, num_chars, num_lookups, pred FROM pr LEFT JOIN best USING ({k})),
    {decided}"""


FINAL = "coalesce(detected, 'unknown') AS detected, CAST(coalesce(gap, 1.0) AS DOUBLE) AS gap, coalesce(num_words, 0) AS num_words, coalesce(num_chars, 0) AS num_chars, coalesce(num_lookups, 0) AS num_lookups"


def detect_sql(texts: str, key: str, languages: list[str], select: str, *, ctes: str = "", model: str | None = None, grouped: str | None = None, floor: float = -12.0, tw_floor: float = -12.0, **how) -> str:
    """A whole statement; select ends it and may use dec, tot, words, ev and prof."""
    model = train_ctes("documents") if model is None else model
    head = f"{ctes}," if ctes else ""
    cj = {"cj": how.get("cj", False), "boosts": how.get("boosts")}
    return f"WITH {head}{detect_ctes(texts, key, languages, model=model, grouped=grouped, floor=floor, tw_floor=tw_floor, **how)},{decide_ctes(grouped or key, languages, floor, tw_floor, **cj)} {select}"
