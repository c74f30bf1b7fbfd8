"""Sinks and stored indexes: one Parquet folder per index, dictionaries as Parquet, JSON or text."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indexes import beside, terms_by_frequency, top_terms

FORMATS = ("binary", "json", "text")
#: The column by which an index is looked up; rows are ordered by it, so that row groups can be skipped.
LOOKUP = {"postings": "term", "coordinates": "term", "bigrams": "bigram", "matrix": "term", "dictionary": "term", "rotations": "rotation", "suffixes": "suffix", "trigrams": "trigram", "compressed": "term"}


def save_index(df: DataFrame, path: str, name: str) -> None:
    """Write an index to path/name, range-partitioned and sorted by its lookup column.

    The range also runs over the other columns: a key that holds a third of the rows is cut into several files.
    """
    key = LOOKUP.get(name)
    if key:
        rest = [c for c in df.columns if c != key and not df.schema[c].dataType.simpleString().startswith(("array", "binary"))]
        df = df.repartitionByRange(key, *rest).sortWithinPartitions(key)
    df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def counts() -> list[Column]:
    return [F.format_string(f"{name.split('_')[1]}: %d", name) for name in ("total_terms", "total_words", "total_documents")] + [F.format_string("bytes of text: %d", "collection_bytes")]


def header(stats: DataFrame) -> DataFrame:
    lines = F.array(
        F.lit("Dictionary"),
        *counts(),
        F.lit(""),
        F.lit("Most frequent first:"),
    )
    return stats.select(F.explode(lines).alias("value"))


def term_lines(dictionary: DataFrame) -> DataFrame:
    """`term: tf (docs: df)`, most frequent first."""
    return dictionary.orderBy(F.desc("tf"), "term").select(F.format_string("%s: %d (docs: %d)", "term", "tf", "df").alias("value"))


def packed_report(dictionary: DataFrame, stats: DataFrame, packing: DataFrame, k: int = 1000) -> DataFrame:
    """Lines of the compressed dictionary's report: statistics, packing figures and the k most frequent terms."""
    one = beside(stats, packing)
    lines = F.array(
        F.lit("Front-packed dictionary"),
        *counts(),
        F.lit(""),
        F.format_string("plain: %d bytes; packed: %d bytes", "original_bytes", "packed_bytes"),
        F.format_string("packed to %.2f%%, %d bytes less", F.col("ratio") * 100, F.col("original_bytes") - F.col("packed_bytes")),
        F.lit(""),
        F.lit("Most frequent first:"),
    )
    head = one.select(F.posexplode(lines).alias("n", "value")).select(F.lit(0).alias("part"), F.col("n").cast("long").alias("a"), F.lit("").alias("b"), "value")
    body = top_terms(dictionary, k).select(F.lit(1).alias("part"), (-F.col("tf")).alias("a"), F.col("term").alias("b"), F.format_string("%s: %d", "term", "tf").alias("value"))
    return head.unionByName(body).orderBy("part", "a", "b").select("value")


def save_packed(packed: DataFrame, dictionary: DataFrame, stats: DataFrame, packing: DataFrame, path: str, form: str) -> int:
    """Write path/packed_<form>; the bytes written. binary is Parquet and json has the same rows (stored in base64); text is the report."""
    target = f"{path}/packed_{form}"
    if form == "binary":
        packed.sortWithinPartitions("prefix_start").write.mode("overwrite").parquet(target)
    elif form == "json":
        packed.withColumn("stored", F.base64("stored")).sortWithinPartitions("prefix_start").write.mode("overwrite").json(target)
    elif form == "text":
        packed_report(dictionary, stats, packing).coalesce(1).write.mode("overwrite").text(target)
    else:
        raise ValueError(f"Unknown format {form}")
    return folder_bytes(dictionary.sparkSession, target)


def format_ratio(compared: DataFrame) -> DataFrame:
    """largest, smallest and their ratio, of a comparison of formats."""
    return compared.agg(F.max_by("format", "bytes").alias("largest"), F.min_by("format", "bytes").alias("smallest"), (F.max("bytes") / F.min("bytes")).alias("ratio"))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a path, through the file system that the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return int(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength())


def save_dictionary(dictionary: DataFrame, stats: DataFrame, path: str, form: str) -> int:
    """Write path/dictionary_<form>; the bytes written. binary is Parquet; text has the statistics in front."""
    target = f"{path}/dictionary_{form}"
    if form == "binary":
        dictionary.write.mode("overwrite").parquet(target)
    elif form == "json":
        dictionary.write.mode("overwrite").json(target)
    elif form == "text":
        header(stats).coalesce(1).write.mode("overwrite").text(target + "/part=0")
        term_lines(dictionary).write.mode("overwrite").text(target + "/part=1")
    else:
        raise ValueError(f"Unknown format {form}")
    return folder_bytes(dictionary.sparkSession, target)


def compare_formats(dictionary: DataFrame, stats: DataFrame, path: str, forms: tuple[str, ...] = FORMATS) -> DataFrame:
    """format, bytes, ms: each known format written once, smallest first; unknown formats are skipped."""
    rows = []
    for form in forms:
        if form in FORMATS:
            began = time.perf_counter()
            rows.append((form, save_dictionary(dictionary, stats, path, form), (time.perf_counter() - began) * 1000))
    return dictionary.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[1]), "format string, bytes long, ms double")


def save_terms(dictionary: DataFrame, path: str) -> None:
    """Terms with their frequencies, most frequent first, as text lines."""
    terms_by_frequency(dictionary).select(F.format_string("%s: %d", "term", "tf").alias("value")).write.mode("overwrite").text(path)
