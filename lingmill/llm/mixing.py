"""Mixing sources to target weights by entropy balancing.

The mix takes `share` times all words. Sources, ordered by code point with null last, weigh 5, 2, 1 and again; a source
gets words by its weight, but at most `most` times its own, and what is cut off goes to the others by weight.

Entropy balancing: of all document rates r between 0 and `most`, those nearest to 1 in relative entropy, each document counting
once, that meet the token constraint of every source are r = min(most, exp(dual of the source * size of the document)). The duals
solve a convex problem by Newton iterations, all sources in each, kept inside a bracket; gradient and curvature are sums over the
documents that Spark takes anew in every iteration, from how many documents of a source have a size. It ends when every source is met
to a trillionth, or as nearly as doubles allow, and raises if it isn't. A source with more words than before prefers its long documents, one with fewer its short ones,
as little as the targets allow.

Rates are rounded into whole copies: sizes of a source in rising order get copies by cumulated rates, which keeps the error of a source
within its largest document; a few further rounds add or remove the one copy that brings the source closest to its target. What
is left over a whole copy for every document of a size goes to those with the smallest digests of id and text, up to a threshold
that is looked up in a numbering of narrow rows. So a document's copies follow from its source, size and digest: whole rows
are neither sorted nor shuffled, and neither order nor partitions matter.

Defined results: a null text has size 0; a document of size 0 is taken once; null is a source of its own, the last one; a source
without words has target 0; rows that are equal in source, id and text get the same copies; an empty table gives an empty result; other
columns are carried or left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, small, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A rate in whole parts of this size: sums of them don't depend on their order.
UNIT = 1 << 20
KEY = ["no_source", "source"]
#: Newton iterations after which an unmet target is an error, and how near is met.
STEPS, NEAR = 200, 1e-12


def with_targets(sources: DataFrame, share: float, most: float, weights: tuple = WEIGHTS) -> DataFrame:
    """sources(no_source, source, source_size, n_docs) with `target`: min(most * size, level * weight), summing to share * all sizes."""
    ranked, n = numbered(sources, [F.col(c) for c in KEY], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = table(ranked.withColumns({"_w": weight, "_cap": F.col("source_size") * F.lit(float(most))}).drop("_rank"), "sources")
    total, caps, all_w = ranked.agg(F.sum("source_size"), F.sum("_cap"), F.sum("_w")).first()
    want = min(share * (total or 0), caps or 0.0)
    level = want / all_w if all_w else 0.0
    for _ in range(n + 1):  # Newton on a concave function of straight pieces ends after at most a step for each piece
        got, slope = ranked.agg(F.sum(F.least("_cap", F.col("_w") * level)), F.sum(F.when(F.col("_w") * level < F.col("_cap"), F.col("_w")))).first()
        if not slope or want - got <= 1e-12 * max(want, 1.0):
            break
        level += (want - got) / slope
    return ranked.withColumn("target", F.least("_cap", F.col("_w") * F.lit(level))).drop("_w", "_cap")


def _rate(most: float):
    """The rate of a document of this size, its source's dual being for documents of mean size."""
    tilt = F.exp(F.least(F.col("dual") * F.col("size") * F.col("n_docs") / F.col("source_size"), F.log(F.lit(float(most)))))
    return F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(most)).when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(float(most)), tilt))


def with_duals(sources: DataFrame, sizes: DataFrame, most: float, steps: int = STEPS) -> DataFrame:
    """sources(..., source_size, n_docs, target) with `full` (all at the most) and `dual`, by Newton iterations over
    sizes(no_source, source, size, n) inside a bracket."""
    open_ = F.col("target").isNotNull() & (F.col("target") > 0) & ~F.col("full")
    held = sources.withColumn("full", (F.col("source_size") > 0) & (F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))))
    held = table(held.withColumns({"dual": F.lit(0.0), "_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double"), "_met": ~open_}), "duals")
    exact = lambda x: F.sum(x.cast("decimal(38,15)")).cast("double")
    for _ in range(steps):
        if held.filter(~F.col("_met")).limit(1).count() == 0:
            return held.drop("_lo", "_hi", "_met")
        words = F.col("n") * F.col("size") * F.col("_r")
        scaled = F.col("size") * F.col("n_docs") / F.col("source_size")
        each = sizes.join(F.broadcast(held.filter(~F.col("_met"))) if held.count() <= 200_000 else held.filter(~F.col("_met")), KEY).withColumn("_r", _rate(most))
        sums = each.groupBy(*KEY).agg(exact(words).alias("_g"), exact(F.when(F.col("_r") < most, words * scaled).otherwise(0.0)).alias("_h"))
        now = held.join(sums, KEY, "left").withColumn("_e", F.col("_g") - F.col("target"))
        now = now.withColumns({"_lo": F.when(F.col("_e") < 0, F.col("dual")).otherwise(F.col("_lo")), "_hi": F.when(F.col("_e") > 0, F.col("dual")).otherwise(F.col("_hi"))})
        newton = F.col("dual") - F.col("_e") / F.when(F.col("_h") > 0, F.col("_h"))
        inside = newton.isNotNull() & (F.col("_lo").isNull() | (newton > F.col("_lo"))) & (F.col("_hi").isNull() | (newton < F.col("_hi")))
        both = F.col("_lo").isNotNull() & F.col("_hi").isNotNull()
        away = F.when(F.col("_lo").isNotNull(), F.col("_lo") + 1 + F.abs("_lo")).otherwise(F.col("_hi") - 1 - F.abs("_hi"))
        moved = F.when(inside & (F.abs(newton - F.col("dual")) < 1 + F.abs("dual")), newton).when(both, (F.col("_lo") + F.col("_hi")) / 2).otherwise(away)
        met = (F.abs("_e") <= NEAR * F.col("target")) | (both & ((F.col("_hi") - F.col("_lo")) <= 1e-14 * (1 + F.abs("dual"))))
        done = F.col("_met") | met
        held = table(now.select(*KEY, "source_size", "n_docs", "target", "full", F.when(done, F.col("dual")).otherwise(moved).alias("dual"), "_lo", "_hi", done.alias("_met")), "duals")
    raise RuntimeError(f"targets of some sources are not met after {steps} Newton iterations")


def cells_of(sizes: DataFrame, sources: DataFrame, most: float, rounds: int) -> DataFrame:
    """A row for each source and size: its rate, `base` copies for every document and `extra` documents that get one more."""
    by_size = W.partitionBy(*KEY).orderBy("size")  # a row for each size that a source has
    cells = sizes.join(sources, KEY).withColumn("rate", _rate(most))
    cells = cells.withColumn("_c", F.sum(F.col("n") * F.round(F.col("rate") * UNIT).cast("long")).over(by_size))
    upto = F.expr(f"(_c + {UNIT // 2}) div {UNIT}")
    cells = table(cells.withColumn("_u", upto).withColumn("m", F.col("_u") - F.lag("_u", 1, 0).over(by_size)).drop("_c", "_u"), "cells")
    for _ in range(rounds):  # the one copy more or less that brings a source closest to its target
        now = cells.groupBy(*KEY).agg((F.first("target") - F.sum(F.col("size") * F.col("m"))).alias("_left"))
        each = cells.join(now, KEY).withColumn("_by", F.when(F.col("_left") > 0, 1).otherwise(-1))
        miss = F.abs(F.col("_left") - F.col("_by") * F.col("size"))
        could = F.when(F.col("_by") > 0, F.col("m") < F.col("n") * int(most)).otherwise(F.col("m") > 0)
        best = each.filter(could & (F.col("size") > 0) & (miss < F.abs("_left"))).groupBy(*KEY).agg(F.min(F.struct(miss.alias("miss"), "size", "_by")).alias("_best"))
        cells = table(cells.join(best, KEY, "left").withColumn("m", F.col("m") + F.when(F.col("size") == F.col("_best.size"), F.col("_best._by")).otherwise(0)).drop("_best"), "cells")
    return cells.withColumn("base", F.expr("m div n")).withColumn("extra", F.col("m") - F.col("base") * F.col("n"))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    digest = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return [
        F.col(f"`{id_col}`").alias("doc_id"),
        source.isNull().alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("digest"),
    ]


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """A row for each of docs: id, size, source_size, target, taken (size * copies), copies, rate; with carry its row as struct `row`."""
    if int(most) != most or most < 1:
        raise ValueError("most is a whole number of copies")
    columns = _narrow(docs, id_col, text_col, source_col)
    rows = table(docs.select(*columns), "sizes")
    sizes = table(rows.groupBy(*KEY, "size").agg(F.count("*").alias("n")), "histogram")
    sources = sizes.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_docs"))
    sources = with_duals(with_targets(sources, share, most), sizes, most)
    cells = table(cells_of(sizes, sources, most, rounds), "cells")
    n = cells.count()

    part = small(cells.filter("extra > 0").select(*KEY, "size", "extra"), n)
    ranked, _ = numbered(rows.join(part, [*KEY, "size"]).select(*KEY, "size", "extra", "digest"), [F.col(c) for c in (*KEY, "size", "digest")])
    last = ranked.groupBy(*KEY, "size").agg((F.min("row_no") + F.first("extra") - 1).alias("row_no"))
    last = ranked.select("row_no", F.col("digest").alias("last")).join(small(last, n), "row_no").drop("row_no")
    cells = table(cells.join(last, [*KEY, "size"], "left").select(*KEY, "size", "source_size", "target", "rate", "base", "last"), "cells")

    out = docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if carry else rows
    copies = (F.col("base") + F.when(F.col("digest") <= F.col("last"), 1).otherwise(0)).cast("int")
    done = out.join(small(cells, n), [*KEY, "size"]).withColumn("copies", copies)
    return done.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies", F.round("rate", 6).alias("rate"), *(["row"] if carry else []))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as many times as the mix takes it."""
    taken = mix(docs, carry=True, **how).filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy"))
    return taken.select("row.*")


def oracle(share: float = 1.5, most: int = 2, rounds: int = 3, weights: tuple = WEIGHTS) -> str:
    """The same rows in DuckDB SQL: the targets from the order in which sources reach their most, the duals by bisection."""
    rate = lambda dual, size: f"CASE WHEN {size} = 0 THEN 1.0 ELSE least({most}.0, exp(least(({dual}) * {size} * nd / ss, ln({most}.0)))) END"
    gained = f"list_sum(list_transform(c, lambda x: x.n * x.size * {rate('(s.lo + s.hi) / 2', 'x.size')}))"
    steps = f"list_reduce(list_prepend({{'lo': -2000.0::DOUBLE, 'hi': 2000.0::DOUBLE}}, list_transform(range(140), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE}})), lambda s, e: CASE WHEN {gained} < target THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END)"
    fixes = ""
    for i in range(rounds):
        fixes += f"""
        l{i} AS (SELECT k, any_value(target) - sum(size * m) AS missing FROM m{i} GROUP BY k),
        b{i} AS (SELECT k, arg_min(size, struct_pack(a := abs(missing - sgn * size), b := size)) AS pick, any_value(sgn) AS sgn FROM (SELECT *, CASE WHEN missing > 0 THEN 1 ELSE -1 END AS sgn FROM m{i} JOIN l{i} USING (k))
            WHERE CASE WHEN sgn > 0 THEN m < n * {most} ELSE m > 0 END AND size > 0 AND abs(missing - sgn * size) < abs(missing) GROUP BY k),
        m{i + 1} AS (SELECT m{i}.* EXCLUDE (m), m + CASE WHEN size = pick THEN sgn ELSE 0 END AS m FROM m{i} LEFT JOIN b{i} USING (k)),"""
    digest = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT)"
    return rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, struct_pack(no := source IS NULL, s := coalesce(source, '')) AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, {digest} AS digest FROM documents),
        hist AS (SELECT k, size, count(*) AS n FROM d GROUP BY ALL),
        src AS (SELECT k, CAST(sum(n * size) AS BIGINT) AS ss, CAST(coalesce(sum(n) FILTER (size > 0), 0) AS BIGINT) AS nd, list(struct_pack(size := size, n := n) ORDER BY size) AS c, ({list(map(float, weights))})[(row_number() OVER (ORDER BY k.no, k.s) - 1) % {len(weights)} + 1] AS w FROM hist GROUP BY k),
        sure AS (SELECT *, least({share} * sum(ss) OVER (), sum(ss * {most}.0) OVER ()) AS want, coalesce(sum(ss * {most}.0) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open, row_number() OVER (ORDER BY ss * {most}.0 / w, k.no, k.s) AS o FROM src WINDOW before AS (ORDER BY ss * {most}.0 / w, k.no, k.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        lev AS (SELECT arg_min((want - capped) / open, o) FILTER ((want - capped) / open * w <= ss * {most}.0) AS level FROM sure),
        tgt AS (SELECT src.*, CASE WHEN level IS NULL THEN ss * {most}.0 ELSE least(ss * {most}.0, w * level) END AS target FROM src, lev),
        dual AS (SELECT *, CASE WHEN target <= 0 OR target >= ss * {most}.0 * (1 - 1e-12) THEN NULL ELSE list_transform([{steps}], lambda s: (s.lo + s.hi) / 2)[1] END AS dual FROM tgt),
        rates AS (SELECT k, hist.size, n, ss, target, CASE WHEN hist.size = 0 THEN 1.0 WHEN target <= 0 THEN 0.0 WHEN dual IS NULL THEN {most}.0 ELSE {rate('dual', 'hist.size')} END AS rate FROM hist JOIN dual USING (k)),
        cum AS (SELECT *, (sum(n * CAST(round(rate * {UNIT}) AS BIGINT)) OVER (PARTITION BY k ORDER BY size) + {UNIT // 2}) // {UNIT} AS u FROM rates),
        m0 AS (SELECT k, size, n, ss, target, rate, CAST(u - coalesce(lag(u) OVER (PARTITION BY k ORDER BY size), 0) AS BIGINT) AS m FROM cum),{fixes}
        ranked AS (SELECT d.doc_id, d.size, ss, target, rate, m, n, row_number() OVER (PARTITION BY d.k, d.size ORDER BY digest) AS r FROM d JOIN m{rounds} USING (k, size))
        SELECT doc_id, size, ss AS source_size, round(target, 6) AS target, CAST(size * (m // n + CASE WHEN r <= m % n THEN 1 ELSE 0 END) AS BIGINT) AS taken, CAST(m // n + CASE WHEN r <= m % n THEN 1 ELSE 0 END AS INT) AS copies, round(rate, 6) AS rate FROM ranked"""
