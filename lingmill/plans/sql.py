"""The engine in SQL: functions for a model, and views of the catalogue.

    register(spark, model)
    SELECT doc_id, detect_language(text), detect_result(text).gap FROM documents
    SELECT conv_id, decide_evidence(${lingmill.added}) FROM (SELECT conv_id, language_evidence(text) AS ev FROM turns) GROUP BY conv_id

The last adds up the evidence of all parts of a conversation with Spark's own sums; register() sets ${lingmill.added} to them. The functions score batches of texts in Arrow form with the tables in every worker, so the model must be one that fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions import text as T
from ..operators import scoring
from ..operators.detect import Params
from ..operators.model import Model


def register(spark: SparkSession, model: Model, params: Params | None = None, boosts: dict[str, float] | None = None, suffix: str = "") -> list[str]:
    """Registers functions and views, names ending in suffix; returns the names of the functions.

    detect_language(text): code or unknown. detect_result(text): struct of all results. language_evidence(text): array that adds up
    element by element; decide_evidence(array): the results of a sum. detect_language_with(text, language, boost): with one boost.
    accents_removed(text), strip_markup(text). Views: languages, alphabets, language_groups, model_languages.
    """
    params = params or Params()
    if not params.valid(model.max_ngram):
        raise ValueError(f"{params} doesn't fit a model of n-grams up to {model.max_ngram}")
    if not model.fits:
        raise ValueError("the model is too large for functions; use detect() on a table")
    shared, facts, at = model.sent(params), model.facts, scoring.Layout(model.facts)

    def found(texts: pd.Series, with_: dict | None) -> dict:
        return scoring.decided(scoring.pieces_of(shared).sums(texts.where(texts.notna(), None).tolist()), facts, with_)

    @F.pandas_udf("string")
    def detect_language(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(found(texts, boosts)["detected"])

    @F.pandas_udf(scoring.RESULT)
    def detect_result(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = pd.DataFrame(found(texts, boosts))
            yield rows.assign(gap=rows["gap"].round(6))

    @F.pandas_udf("string")
    def detect_language_with(texts: pd.Series, languages: pd.Series, by: pd.Series) -> pd.Series:
        out = pd.Series([scoring.UNKNOWN] * len(texts), dtype=object)
        for (lang, boost), own in pd.DataFrame({"lang": languages.fillna(""), "by": by.fillna(0.0)}).groupby(["lang", "by"]):
            out.iloc[own.index] = found(texts.iloc[own.index], (boosts or {}) | {catalog.parse_language(lang): boost})["detected"]
        return out

    @F.pandas_udf("array<bigint>")
    def language_evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(scoring.pieces_of(shared).sums(texts.where(texts.notna(), None).tolist())))

    @F.pandas_udf(scoring.RESULT)
    def decide_evidence(ev: pd.Series) -> pd.DataFrame:
        sums = np.array([np.zeros(at.width, dtype=np.int64) if e is None else e for e in ev], dtype=np.int64).reshape(-1, at.width)
        rows = pd.DataFrame(scoring.decided(sums, facts, boosts))
        return rows.assign(gap=rows["gap"].round(6))

    names = []
    for f in (detect_language, detect_result, detect_language_with, language_evidence, decide_evidence):
        names.append(f.__name__ + suffix if hasattr(f, "__name__") else f.func.__name__ + suffix)
        spark.udf.register(names[-1], f)
    spark.udf.register("strip_markup" + suffix, T.remove_markup)
    sums = ", ".join(f"sum(element_at(ev, {i + 1}))" for i in range(at.width))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION accents_removed{suffix}(t STRING) RETURNS STRING RETURN {_accents_sql('t')}")
    names += ["strip_markup" + suffix, "accents_removed" + suffix]
    for name, table in (("languages", catalog.languages(spark)), ("alphabets", catalog.alphabets(spark)), ("language_groups", catalog.groups(spark)), ("model_languages", model.info())):
        table.createOrReplaceTempView(name + suffix)
    spark.conf.set(f"lingmill.added{suffix}", f"array({sums})")  # ${lingmill.added} in a statement: the evidence `ev` of a group, added up
    return names


def _accents_sql(column: str) -> str:
    """remove_accents in SQL."""
    table = T.accent_map()
    one = {k: v for k, v in table.items() if len(v) == 1}
    out = f"translate({column}, '{''.join(one)}', '{''.join(one.values())}')"
    for k, v in table.items():
        if len(v) > 1:
            out = f"replace({out}, '{k}', '{v}')"
    return out
