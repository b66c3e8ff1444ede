"""Text files of models, phrases and wiki dumps, read and written as DataFrames; .gz and .bz2 by extension."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog
from ..functions import text as X
from ..operators.train import eligible, log_u


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def resolved(spark: SparkSession, path: str, name: str) -> str | None:
    """Where the files `name` (a glob) of a folder are, or of what begins with a prefix; None if there are none."""
    base = path.rstrip("/")
    fs, at = file_system(spark, base)
    pattern = f"{base}/{name}" if fs.exists(at) and fs.getFileStatus(at).isDirectory() else base + name
    return pattern if fs.globStatus(file_system(spark, pattern)[1]) else None


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """lang (from the file's name `<name>-<code>.txt[.gz]`), value of each line of the files."""
    found = resolved(spark, path, f"{name}-*.txt*")
    if found is None:
        raise FileNotFoundError(f"{path} has no {name} files")
    lang = F.regexp_extract(F.col("_metadata.file_name"), rf"{name}-([a-z-]+)\.txt", 1)
    return spark.read.text(found).select(lang.alias("lang"), "value")


#: The floor that a header states, in millionths; none if it states none.
_FLOOR = r"cast(round(try_cast(regexp_extract(value, 'MinLogProb: (-?[0-9.]+)', 1) as double) * 1e6) as long)"


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """lang, n, gram, logprob_u, file_floor_u of n-gram files: a header `# 1:distinct/total ... MinLogProb: x` (lengths without n-grams may lack), then `gram value`,
    the value being a count, or a logarithm if it begins with a minus. n-grams longer than the header tells are left out."""
    lines = _lines(spark, path, "ngrams")
    heads = lines.filter(F.col("value").rlike("^# [0-9]:")).select("lang", F.expr(_FLOOR).alias("file_floor_u"), F.explode(F.expr(r"regexp_extract_all(value, '([0-9]+):[0-9]+/[0-9]+', 0)")).alias("t"))
    totals = heads.select("lang", "file_floor_u", F.split("t", ":")[0].cast("int").alias("n"), F.split("t", "/")[1].cast("long").alias("total"))
    rows = _entries(lines, "gram").withColumn("n", F.length("gram")).join(F.broadcast(totals), ["lang", "n"])
    return rows.select("lang", "n", "gram", _value().alias("logprob_u"), "file_floor_u")


def read_topwords(spark: SparkSession, path: str) -> DataFrame:
    """lang, word, logprob_u, file_floor_u of topword files: a header `# Count: N MinLogProb: x`, then `word value`."""
    lines = _lines(spark, path, "topwords")
    totals = lines.filter(F.startswith("value", F.lit("# Count:"))).select("lang", F.expr(_FLOOR).alias("file_floor_u"), F.regexp_extract("value", r"# Count: ([0-9]+)", 1).cast("long").alias("total"))
    rows = _entries(lines, "word").join(F.broadcast(totals), "lang").filter(eligible(F.col("word")))
    return rows.select("lang", "word", _value().alias("logprob_u"), "file_floor_u")


def read_ngram_counts(spark: SparkSession, path: str) -> DataFrame:
    """lang, n, gram, cnt, total, logprob_u of n-gram files that hold counts; what holds a logarithm instead is left out."""
    lines = _lines(spark, path, "ngrams")
    heads = lines.filter(F.col("value").rlike("^# [0-9]:")).select("lang", F.explode(F.expr(r"regexp_extract_all(value, '([0-9]+):[0-9]+/[0-9]+', 0)")).alias("t"))
    totals = heads.select("lang", F.split("t", ":")[0].cast("int").alias("n"), F.split("t", "/")[1].cast("long").alias("total"))
    rows = _entries(lines, "gram").withColumn("n", F.length("gram")).join(F.broadcast(totals), ["lang", "n"]).withColumn("cnt", F.col("v").try_cast("long"))
    return rows.filter("cnt > 0").select("lang", "n", "gram", "cnt", "total", log_u(F.col("cnt"), F.col("total")).alias("logprob_u"))


def read_topword_counts(spark: SparkSession, path: str) -> DataFrame:
    """lang, word, cnt, total, logprob_u of topword files; cnt is null where a file has logarithms."""
    lines = _lines(spark, path, "topwords")
    totals = lines.filter(F.startswith("value", F.lit("# Count:"))).select("lang", F.regexp_extract("value", r"# Count: ([0-9]+)", 1).cast("long").alias("total"))
    rows = _entries(lines, "word").join(F.broadcast(totals), "lang")
    cnt = F.when(F.startswith("v", F.lit("-")), None).otherwise(F.col("v").try_cast("long"))
    return rows.select("lang", "word", cnt.alias("cnt"), "total", _value().alias("logprob_u"))


def _entries(lines: DataFrame, name: str) -> DataFrame:
    part = lambda k: F.regexp_extract("value", r"^(.*) ([^ ]+)$", k)
    return lines.filter(~F.startswith("value", F.lit("# ")) & (F.col("value") != "")).select("lang", part(1).alias(name), part(2).alias("v"))


def _value():
    """v, a logarithm or a count of `total`, as a logarithm in millionths."""
    return F.when(F.startswith("v", F.lit("-")), F.round(F.col("v").try_cast("double") * 1e6).cast("long")).otherwise(log_u(F.col("v").try_cast("double"), F.col("total")))


def read_skipwords(spark: SparkSession, path: str) -> DataFrame:
    """word of each line that is neither empty nor a comment."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> '' AND word NOT LIKE '#%'").distinct()


def read_skipword_lists(spark: SparkSession, spec: str) -> DataFrame:
    """word of the files in `path,path/N`: what stands before the first space of each line that is neither empty nor a comment; of
    path/N the first N such lines. A file is read as a whole, as its order counts."""
    out = None
    for entry in filter(None, map(str.strip, spec.split(","))):
        head, _, tail = entry.rpartition("/")
        path, most = (head, int(tail)) if head and tail.isdigit() else (entry, None)
        lines = F.filter(F.split("value", r"\r?\n"), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit(" ")))
        words = F.transform(lines, lambda x: F.substring_index(x, " ", 1))
        words = spark.read.text(path, wholetext=True).select(F.explode(words if most is None else F.slice(words, 1, most)).alias("word"))
        out = words if out is None else out.union(words)
    return spark.createDataFrame([], "word string") if out is None else out.distinct()


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """expected (the file's name `<code>.txt`; zh.txt is for both kinds of Chinese), text of each line that isn't blank."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([a-z-]+)\.txt", 1)
    expected = F.when(name == "zh", "zh-hans").otherwise(name)  # counts as either kind, see evaluate.right
    return spark.read.text(f"{path}/*.txt*").select(expected.alias("expected"), F.col("value").alias("text")).filter(F.trim("text") != "")


def read_wiki(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """text of each <text> element of a dump, empty ones left out; strip: without markup."""
    body = T.StructType([T.StructField("_VALUE", T.StringType())])
    rows = spark.read.format("xml").option("rowTag", "text").schema(body).load(path).select(F.col("_VALUE").alias("text")).filter("text IS NOT NULL AND text <> ''")
    return rows.select(X.remove_markup("text").alias("text")) if strip else rows


def write_wiki(spark: SparkSession, dump: str, path: str, strip: bool = True) -> None:
    """The texts of a dump as text files, a blank line after each."""
    read_wiki(spark, dump, strip).select(F.concat("text", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def read_labelled(spark: SparkSession, spec: str, strip: bool = True, limit: int | None = None) -> DataFrame:
    """lang, text of the dumps in `path:code,path:code`; limit: so many texts over all of them."""
    out = None
    for path, code in (x.rsplit(":", 1) for x in spec.split(",") if x):
        lang = catalog.parse_language(code)
        if lang == catalog.UNKNOWN:
            raise ValueError(f"unknown language: {code}")
        rows = read_wiki(spark, path, strip).select(F.lit(lang).alias("lang"), "text")
        out = rows if out is None else out.union(rows)
    if out is None:
        raise ValueError("no files named")
    return out if limit is None else out.limit(limit)


def write_ngrams(model: DataFrame, path: str, floor: float, compress: bool = False) -> None:
    """ngrams-<lang>.txt[.gz] of each language in a folder: header and n-grams with their counts, by length and then by letter."""
    heads = model.groupBy("lang", "n").agg(F.count("*").alias("d"), F.first("total").alias("t")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n", "d", "t"))).alias("s"))
    line = F.concat(F.lit("# "), F.array_join(F.transform("s", lambda x: F.format_string("%d:%d/%d", x["n"], x["d"], x["t"])), " "), F.lit(f" MinLogProb: {floor:.1f}"))
    rows = heads.select("lang", F.lit(0).alias("n"), F.lit("").alias("gram"), line.alias("value")).union(model.select("lang", "n", "gram", F.concat_ws(" ", "gram", F.col("cnt").cast("string"))))
    _write(rows, ["n", "gram"], path, "ngrams", compress)


def write_topwords(model: DataFrame, path: str, floor: float, logs: bool = False, compress: bool = False) -> None:
    """topwords-<lang>.txt[.gz] of each language in a folder: header and words, the most frequent first, with counts or logarithms of six places."""
    heads = model.groupBy("lang").agg(F.first("total").alias("t")).select("lang", F.lit("").alias("word"), F.concat(F.lit("# Count: "), F.col("t").cast("string"), F.lit(f" MinLogProb: {floor:.1f}")).alias("value"))
    value = F.format_string("%.6f", F.col("logprob_u") / 1e6) if logs else F.col("cnt").cast("string")
    rows = heads.select("lang", F.lit(1).cast("long").alias("u"), "word", "value").union(model.select("lang", F.col("logprob_u").alias("u"), "word", F.concat_ws(" ", "word", value)))
    _write(rows, [F.col("u").desc(), "word"], path, "topwords", compress)  # a logarithm is never above 0, so the header comes first


def _write(rows: DataFrame, order: list, path: str, name: str, compress: bool) -> None:
    """rows(lang, value, ...) as a file for each language. A file is in order, so one task writes it; a language's table is as large as
    the language, not as the texts it comes from."""
    spark, aside, end = rows.sparkSession, f"{path}/_{name}-{uuid.uuid4().hex}", ".txt.gz" if compress else ".txt"
    parts = rows.repartition("lang").sortWithinPartitions("lang", *order).select("lang", "value")
    parts.write.partitionBy("lang").text(aside, compression="gzip" if compress else "none")
    fs, at = file_system(spark, aside)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in fs.globStatus(path_of(f"{aside}/lang=*")) or []:
        (part,) = fs.globStatus(path_of(f"{folder.getPath().toString()}/part-*"))
        to = path_of(f"{path}/{name}-{folder.getPath().getName().removeprefix('lang=')}{end}")
        fs.delete(to, False)
        fs.rename(part.getPath(), to)
    fs.delete(at, True)
