"""Texts that come in parts: evidence adds up, each part being split into words on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .detect import Params, added, complete, decide, evidence
from .model import Model
from .scoring import Layout


def detect_merged(parts: DataFrame, model: Model, keys: list[str], part: str, params: Params | None = None, boosts: dict | None = None) -> DataFrame:
    """A row for each key, from all its parts."""
    ev = added(evidence(parts, model, [*keys, part], params), keys, model)
    return complete(parts.select(*keys).distinct(), decide(ev, model, keys, boosts), keys)


def detect_running(parts: DataFrame, model: Model, keys: list[str], part: str, params: Params | None = None, boosts: dict | None = None) -> DataFrame:
    """A row for each part: the result from all parts of its key so far, as if asked again after each. A part has one narrow row, whatever
    its languages; parts of a key are summed in their order, so in one task, which spills if they are many."""
    key, width = [*keys, part], Layout(model.facts).width
    steps = parts.select(*key).distinct()
    ev = added(evidence(parts, model, key, params), key, model)
    so_far = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = steps.join(ev, key, "left")
    if width <= 64:
        sums = F.array(*[F.sum(F.coalesce(F.col("ev")[i], F.lit(0).cast("long"))).over(so_far) for i in range(width)])
        return decide(rows.select(*key, sums.alias("ev")), model, key, boosts)
    none = F.array_repeat(F.lit(0).cast("long"), width)
    each = rows.select(*key, F.posexplode(F.coalesce("ev", none)).alias("at", "v"))  # for many languages: by place, so that a key has more tasks
    by_place = W.partitionBy(*keys, "at").orderBy(part).rowsBetween(W.unboundedPreceding, W.currentRow)
    ev = each.select(*key, "at", F.sum("v").over(by_place).alias("v")).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("ev"))
    return decide(ev, model, key, boosts)
