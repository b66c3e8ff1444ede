"""A model: lookup tables as DataFrames, with languages, floors and scripts; building, storing, loading, caching."""

from __future__ import annotations

import os
import uuid
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property, reduce
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..sources import files
from . import cj as CJ
from . import train
from .scoring import Facts

#: Floors of the variants, as logarithms; "full" keeps what the tables have down to it.
VARIANTS = {"lite": (-12.0, -12.0), "full": (-15.0, -15.0)}
#: Words that say nothing about a language: parts of addresses, file types, units, and letters of hexadecimal colours.
SKIPWORDS = """
www http https html htm pdf php jpg png txt nbsp
km cm ml cc cl dl ms mhz khz ghz utc
aaa aaaa aaaaa aaaaaa aaaaaaa aaaaaaaa
bbb bbbb bbbbb bbbbbb bbbbbbb bbbbbbbb
ccc cccc ccccc cccccc ccccccc cccccccc
ddd dddd ddddd dddddd ddddddd dddddddd
eee eeee eeeee eeeeee eeeeeee eeeeeeee
fff ffff fffff ffffff fffffff ffffffff
ffffaa ffffbb ffffcc ffffdd ffffee
""".split()
#: Entries (grams and words, counted once for each of their languages) of a model that is sent to every worker; larger ones are joined.
SENT_ENTRIES = 4_000_000


@dataclass
class Model:
    """ngrams(n, gram, langs) and topwords(word, langs), langs: array<struct<lang, u>>; skipwords(word); cj(n, gram, langs) for
    Chinese and Japanese. Lookup tables are as large as the languages, not as the texts."""

    languages: list[str]
    ngrams: DataFrame
    topwords: DataFrame | None
    skipwords: DataFrame | None
    floor_u: int
    tw_floor_u: int
    max_ngram: int = train.MAX_NGRAM
    cj: DataFrame | None = None
    alphabets: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.languages = catalog.ordered(self.languages)
        used = {a for x in self.languages for a in catalog.BY_ISO[x].alphabets}
        self.alphabets = [a for a in catalog.ALPHABETS if a in used]
        self._sent: dict = {}

    def users(self, alphabet: str) -> list[str]:
        return [x for x in self.languages if alphabet in catalog.BY_ISO[x].alphabets]

    @property
    def has_cj(self) -> bool:
        """Chinese and Japanese are told apart by their own table, if there is one and two of them are loaded."""
        return self.cj is not None and sum(x in catalog.GROUPS["cj"] for x in self.languages) >= 2

    @property
    def unique(self) -> dict[str, str]:
        """script -> its only language."""
        return {a: self.users(a)[0] for a in self.alphabets if len(self.users(a)) == 1}

    @property
    def facts(self) -> Facts:
        return Facts(tuple(self.languages), tuple(self.alphabets), self.floor_u, self.tw_floor_u, self.has_cj)

    @property
    def tables(self) -> list[DataFrame]:
        return [t for t in (self.ngrams, self.topwords, self.cj if self.has_cj else None) if t is not None]

    def persist(self) -> Model:
        self.ngrams, self.topwords, self.cj = (None if t is None else t.persist() for t in (self.ngrams, self.topwords, self.cj))
        return self

    def unpersist(self) -> None:
        for shared in self._sent.values():
            shared.unpersist()
        self._sent.clear()
        for t in (self.ngrams, self.topwords, self.cj):
            if t is not None:
                t.unpersist()

    @cached_property
    def entries(self) -> int:
        """Entries of the lookup tables, counted once."""
        sizes = [t.select(F.size("langs").alias("n")) for t in self.tables]
        return reduce(DataFrame.union, sizes).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    @property
    def fits(self) -> bool:
        return self.entries <= SENT_ENTRIES

    def sent(self, params):
        """The tables as a broadcast for scoring where texts are read; only for a model that fits."""
        if params not in self._sent:
            def plain(table: DataFrame | None, key: str, languages: list[str]) -> dict:
                if table is None:
                    return {}
                number = {x: i for i, x in enumerate(languages)}
                got = table.select(key, F.transform("langs", lambda x: x["lang"]).alias("l"), F.transform("langs", lambda x: x["u"]).alias("u")).toArrow()
                return {k: tuple(zip((number[x] for x in langs), us, strict=True)) for k, langs, us in zip(*(got.column(c).to_pylist() for c in (key, "l", "u")), strict=True)}

            skips = set() if self.skipwords is None else {r[0] for r in self.skipwords.collect()}
            tables = {"grams": plain(self.ngrams, "gram", self.languages), "tops": None if self.topwords is None else plain(self.topwords, "word", self.languages), "skips": skips, "cj": plain(self.cj if self.has_cj else None, "gram", [self.languages[i] for i in self.facts.cj])}
            self._sent[params] = self.ngrams.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, self.facts, tables, params))
        return self._sent[params]

    def boosts(self, *given) -> dict[str, float]:
        """Boosts of languages given as one mapping or as language, boost, language, boost ..., by any name; others than the model's don't count."""
        pairs = given[0].items() if len(given) == 1 else zip(given[::2], given[1::2], strict=True)
        named = {catalog.parse_language(x): float(b) for x, b in pairs}
        return {x: b for x, b in named.items() if x in self.languages}

    def info(self) -> DataFrame:
        """A row for each language and script of the model: its order, floors, and whether the script is its alone."""
        rows = [(x, i, a, self.unique.get(a) == x, self.floor_u / 1e6, self.tw_floor_u / 1e6, self.max_ngram) for i, x in enumerate(self.languages) for a in catalog.BY_ISO[x].alphabets]
        return self.ngrams.sparkSession.createDataFrame(rows, "lang string, lang_ord int, alphabet string, only_language boolean, floor double, topword_floor double, max_ngram int")


def needs_ngrams(languages: list[str]) -> list[str]:
    """Languages that share a script with another one of the list: the only ones whose n-grams are ever looked up."""
    users = Counter(a for x in languages for a in catalog.BY_ISO[x].alphabets)
    return [x for x in catalog.ordered(languages) if x not in catalog.GROUPS["cj"] and any(users[a] > 1 for a in catalog.BY_ISO[x].alphabets)]


def _file_floors(table: DataFrame, languages: list[str]) -> dict[str, int]:
    """Floors that the files of the languages state, by language: a row for each."""
    if "file_floor_u" not in table.columns:
        return {}
    kept = table.filter(F.col("lang").isin(languages) & F.col("file_floor_u").isNotNull())
    return {r[0]: r[1] for r in kept.groupBy("lang").agg(F.max("file_floor_u")).collect()}


def _lookup(table: DataFrame, keys: list[str], languages: list[str], floor: float | None) -> tuple[DataFrame, int]:
    """The entries of each key at or above the caller's and their file's floor, raised to the highest of all floors; that one."""
    stated = _file_floors(table, languages)
    floors = [*stated.values(), *([] if not floor else [round(floor * 1e6)])]
    top = max(floors) if floors else 0
    own = F.lit(round(floor * 1e6) if floor else None).cast("long")
    at_least = F.greatest(own, F.col("file_floor_u")) if stated else own
    kept = table.filter(F.col("lang").isin(languages) & F.coalesce(F.col("logprob_u") >= at_least, F.lit(True)))
    u = F.greatest("logprob_u", F.lit(top)) if floors else F.col("logprob_u")
    return kept.groupBy(*keys).agg(F.collect_list(F.struct("lang", u.alias("u"))).alias("langs")), top


def assemble(ngrams: DataFrame, topwords: DataFrame | None, languages: list[str], floor: float | None = -12.0, tw_floor: float | None = -12.0, skipwords: list[str] | DataFrame | None = None, max_ngram: int = train.MAX_NGRAM, cj: DataFrame | None = None) -> Model:
    """A model of long tables (lang, n, gram, logprob_u) and (lang, word, logprob_u), restricted to languages and floors.

    An entry stays if it is at or above floor and above its file's floor (column file_floor_u, if there). The highest of all floors
    holds for all: no entry lies below it, and a miss costs as much. floor None or 0: by the files. tw_floor None: no topwords, 0: by
    the files. skipwords: a list or a table (word); default SKIPWORDS. cj: (lang, n, gram, logprob_u) of Chinese and Japanese.
    """
    spark, languages = ngrams.sparkSession, catalog.ordered(languages)
    skips = skipwords if isinstance(skipwords, DataFrame) else spark.createDataFrame([(w,) for w in (SKIPWORDS if skipwords is None else skipwords)], "word string")
    grams, floor_u = _lookup(ngrams.filter(F.col("n") <= max_ngram), ["n", "gram"], needs_ngrams(languages), floor)
    tops, tw_u = None, round((tw_floor or 0) * 1e6)
    if tw_floor is not None and topwords is not None:
        kept = topwords.filter(train.eligible(F.col("word"))).join(F.broadcast(skips), "word", "left_anti")
        tops, tw_u = _lookup(kept, ["word"], languages, tw_floor)
    if cj is not None:
        cj, _ = _lookup(cj, ["n", "gram"], [x for x in languages if x in catalog.GROUPS["cj"]], CJ.FLOOR_U / 1e6)
    return Model(languages, grams, tops, skips if tops is not None else None, floor_u, tw_u, max_ngram, cj)


def train_tables(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", max_ngram: int = train.MAX_NGRAM, alphabets: list[str] | None = None, skipwords: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """n-gram and topword tables of labelled texts, each language in its own script."""
    words = train.training_words(texts, alphabets, text_col, lang_col, skipwords)
    return train.ngram_model(train.ngram_counts(words, max_ngram)), train.topword_model(words)


def save(ngrams: DataFrame, topwords: DataFrame, path: str, cj: DataFrame | None = None) -> None:
    """The tables as Parquet, in a folder for each language: loading reads only the languages asked for."""
    for name, table in (("ngrams", ngrams), ("topwords", topwords), ("cj", cj)):
        if table is not None:
            table.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/{name}")


def tables_of(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame | None]:
    """n-grams, topwords, Chinese and Japanese grams, and skipwords of a folder, or of the files that begin with a prefix: Parquet as
    save() writes it, else text files. Topwords, skipwords and Chinese and Japanese grams may be absent."""
    if files.exists(spark, f"{path}/ngrams"):
        read = lambda name: spark.read.parquet(f"{path}/{name}") if files.exists(spark, f"{path}/{name}") else None
        return read("ngrams"), read("topwords"), read("cj"), None
    skips = files.resolved(spark, path, "skipwords.txt")
    tops = files.read_topwords(spark, path) if files.resolved(spark, path, "topwords-*.txt*") else None
    return files.read_ngrams(spark, path), tops, None, files.read_skipwords(spark, skips) if skips else None


_loaded: dict = {}
_lock = RLock()
#: Folders with a sub-folder for each variant, in the order in which they are looked at: $LINGMILL_MODELS, then the package's own.
HOMES = [h for h in (os.environ.get("LINGMILL_MODELS"), os.path.join(os.path.dirname(os.path.dirname(__file__)), "models")) if h]


def load(spark: SparkSession, path: str, languages: str = "all", variant: str = "lite", floor: float | None = None, tw_floor: float | None = None) -> Model:
    """A stored model; the same arguments give the same persisted tables. Floors default to the variant's; 0 takes the files' own.
    A language whose n-grams are needed and absent is an error; absent topwords are not."""
    wanted = catalog.ordered(catalog.parse_languages(languages))
    base, tw_base = VARIANTS[variant]
    key = (path, tuple(wanted), floor if floor is not None else base, tw_floor if tw_floor is not None else tw_base)
    with _lock:
        if key not in _loaded or _loaded[key].ngrams.sparkSession is not spark:
            grams, tops, cj, skips = tables_of(spark, path)
            lacks = set(needs_ngrams(wanted)) - {r[0] for r in grams.select("lang").distinct().collect()}
            if lacks:
                raise FileNotFoundError(f"{path} has no n-grams of {', '.join(sorted(lacks))}")
            _loaded[key] = assemble(grams, tops, wanted, key[2], key[3], skips, cj=cj).persist()
        return _loaded[key]


def load_packaged(spark: SparkSession, languages: str = "all", variant: str | None = None, homes: list[str] | None = None) -> Model:
    """A model of one of the HOMES. No variant: the full one if there is one, else lite. lite: made of the full one's tables, at its own
    floors, where only that is there."""
    for name in ("full", "lite") if variant in (None, "full") else ("lite", "full"):
        if variant == "full" and name != "full":
            break
        for home in HOMES if homes is None else homes:
            if files.exists(spark, f"{home}/{name}"):
                return load(spark, f"{home}/{name}", languages, variant or name)
    raise FileNotFoundError(f"no model{f' {variant}' if variant else ''} in {', '.join(HOMES if homes is None else homes)}")


def clear_cache() -> None:
    with _lock:
        for model in _loaded.values():
            model.unpersist()
        _loaded.clear()
