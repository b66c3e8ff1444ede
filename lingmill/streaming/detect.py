"""Detection over streams of text parts.

Evidence is nothing but sums, so a stream needs Spark's own stateful aggregation only. Word scoring needs the static model: the
parts' evidence is worked out in a batch for each trigger, kept as sums by key, and decided from there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.detect import Params, added, decide, evidence
from ..operators.model import Model
from ..sources.files import exists, file_system


def word_counts(parts: DataFrame, keys: list[str], model: Model, text_col: str = "text") -> DataFrame:
    """Streaming words and characters by key and script: built-in stateful sums, for update or complete mode."""
    chunk = parts.select(*keys, F.explode(T.chunks(F.col(text_col), model.alphabets)).alias("c")).withColumn("script", T.script_of(F.col("c"), model.alphabets))
    words = chunk.select(*keys, "script", F.explode(T.detection_words(F.col("c"), F.col("script"))).alias("word"))
    return words.groupBy(*keys, "script").agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("chars"))


class Accumulator:
    """Sums of evidence by key as Parquet in a shared folder, one generation a batch; a batch that is replayed replaces its own
    generation. clear() forgets keys, compact() makes one generation of all so far."""

    def __init__(self, path: str, model: Model, keys: list[str], part: str, params: Params | None = None):
        self.path, self.model, self.keys, self.part, self.params = path, model, keys, part, params

    @property
    def spark(self):
        return self.model.ngrams.sparkSession

    def add(self, batch: DataFrame, epoch: int) -> None:
        """The evidence of a batch, as generation `epoch`. What was compacted already is not added again."""
        if epoch > self._through():
            ev = added(evidence(batch, self.model, [*self.keys, self.part], self.params), self.keys, self.model)
            ev.write.mode("overwrite").parquet(f"{self.path}/evidence/epoch={epoch}")

    def _generations(self, name: str) -> list[int]:
        """Numbers of the finished generations `name=N`."""
        fs, at = file_system(self.spark, f"{self.path}/{name.split('/')[0]}")
        found = fs.listStatus(at) if fs.exists(at) else []
        names = [f.getPath().getName() for f in found]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(name.split("/")[1] + "=([0-9]+)", n)) and exists(self.spark, f"{self.path}/{name.split('/')[0]}/{n}/_SUCCESS"))

    def _through(self) -> int:
        """The last batch that is part of the compacted sums; -1 without any."""
        return max(self._generations("sums/through"), default=-1)

    def clear(self, keys: DataFrame) -> None:
        """What was added so far no longer counts for these keys."""
        last = max([self._through(), *self._generations("evidence/epoch")])
        keys.select(*self.keys).distinct().withColumn("upto", F.lit(last)).write.mode("append").parquet(f"{self.path}/cleared")

    def evidence(self) -> DataFrame | None:
        """keys, ev of all that counts; None before the first batch."""
        through, epochs = self._through(), self._generations("evidence/epoch")
        parts = [self.spark.read.parquet(f"{self.path}/evidence/epoch={e}").withColumn("epoch", F.lit(e)) for e in epochs if e > through]
        if through >= 0:
            parts.append(self.spark.read.parquet(f"{self.path}/sums/through={through}").withColumn("epoch", F.lit(through)))
        if not parts:
            return None
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if exists(self.spark, f"{self.path}/cleared"):
            cleared = self.spark.read.parquet(f"{self.path}/cleared").groupBy(*self.keys).agg(F.max("upto").alias("upto"))
            rows = rows.join(cleared, self.keys, "left").filter(F.col("upto").isNull() | (F.col("epoch") > F.col("upto")))
        return added(rows, self.keys, self.model)

    def compact(self) -> None:
        """One generation instead of all: the sums are written first, and count from when they are whole; then the batches go."""
        epochs, ev = self._generations("evidence/epoch"), self.evidence()
        if ev is None or not epochs:
            return
        before = self._through()
        last = max(before, *epochs)
        if last > before:
            ev.write.mode("overwrite").parquet(f"{self.path}/sums/through={last}")
        for old in [f"evidence/epoch={e}" for e in epochs] + [f"sums/through={before}"] * (0 <= before < last):
            fs, at = file_system(self.spark, f"{self.path}/{old}")
            fs.delete(at, True)

    def result(self, boosts: dict | None = None) -> DataFrame:
        """What all parts so far say: keys, detected, gap, counts. Asking doesn't clear anything. An error before the first batch."""
        ev = self.evidence()
        if ev is None:
            raise FileNotFoundError(f"{self.path} has no batch yet")
        return decide(ev, self.model, self.keys, boosts)

    def start(self, parts: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return parts.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
