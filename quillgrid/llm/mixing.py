"""Mixing sources to target weights by systematic sampling.

A source with target words `target` and `source_size` words has the rate target / source_size, the
expected copies of each of its documents. Documents of a source stand in a fixed order (by size class,
then a hash of the id), expected copies are summed along it, one offset per source is added, and a
document is emitted once for each whole number that the sum crosses at it. Because the order runs
through the sizes, the words taken stay within about the source's largest document of the target.

Ranks come from counts per cell (source, size class, hash part) and a window inside each cell, so a
source or a size that holds a third of the rows is spread over at least 256 cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, table, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of `text`; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = 3, cycle: int = 3) -> DataFrame:
    """source, source_size -> also target.

    Sources by code point with null last weigh 1, 2, .. cycle, repeating. Targets share the sum of all
    sizes by weight; none exceeds cap times its source's size, and what is cut is shared again among the
    others by weight. One row per source: the windows without partitions run over that small table only.
    """
    ranked = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", (F.col("_n") % cycle + 1).cast("double")).withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    everyone, fullest = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        F.sum("source_size").over(everyone).cast("double").alias("_all"),
        F.sum("_w").over(everyone).alias("_weights"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_cut"),
        F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_gone"),
    )
    full = F.col("_w") * (F.col("_all") - F.col("_cut")) / (F.col("_weights") - F.col("_gone")) > F.col("_cap")
    ranked = ranked.withColumn("_full", full)
    ranked = ranked.withColumn("_cut", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everyone))
    ranked = ranked.withColumn("_gone", F.sum(F.when(F.col("_full"), F.col("_w")).otherwise(0.0)).over(everyone))
    shared = F.col("_w") * (F.col("_all") - F.col("_cut")) / (F.col("_weights") - F.col("_gone"))
    return ranked.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(shared).alias("target"))


def systematic_copies(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", cap: int = 3, seed: str = "mix", size: str | None = None) -> DataFrame:
    """_all (the columns of `df`), _size, _source_size, _target and _copies of every row.

    A null source is a source of its own. Empty and null texts have size 0; where a whole source has
    none, its rate is 0. Equal rows are interchangeable: as many of them are taken, whichever they are.
    An empty table gives an empty result. size names a column with the sizes, where they are known.
    """
    mark = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    rows = packed(df, F.col(f"`{key}`").alias("_key"), (F.col(f"`{size}`") if size else word_count(F.col(f"`{text}`"))).alias("_size"), F.coalesce(F.concat(F.lit("+"), F.col(f"`{source}`")), F.lit("-")).alias("_from"), mark.alias("_mark"))
    digits = F.bin("_size")
    rows = rows.withColumn("_class", F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.rpad(F.substring(digits, 1, 4), 4, "0")))
    rows = rows.withColumn("_part", F.substring("_mark", 1, 2))
    cell = ["_from", "_class", "_part"]
    counted = rows if size else written(rows.select(*cell, "_size"))  # the words are counted once for all that is summed
    cells = counted.groupBy(*cell).agg(F.count("*").alias("_rows"), F.sum("_size").alias("_words"))
    sizes = cells.groupBy("_from").agg(F.sum("_words").alias("source_size"))
    named = sizes.select("_from", F.when(F.col("_from") != "-", F.expr("substr(_from, 2)")).alias("source"), "source_size")
    aims = targets(named.drop("_from"), cap).select(F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-")).alias("_from"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    along = Window.partitionBy("_from").orderBy("_class", "_part")
    cells = cells.withColumn("_before", F.sum("_rows").over(along) - F.col("_rows")).drop("_rows", "_words").join(aims, "_from")
    inside = Window.partitionBy(*cell).orderBy("_size", "_mark", "_key")
    ranked = rows.withColumn("_rank", F.row_number().over(inside).cast("long")).join(cells, cell)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_from"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    upto = F.floor(rate * (F.col("_before") + F.col("_rank")).cast("double") + offset)
    until = F.floor(rate * (F.col("_before") + F.col("_rank") - 1).cast("double") + offset)
    copies = F.least(upto - until, F.lit(cap)).cast("long")
    return ranked.select("_all", "_size", "_source_size", "_target", copies.alias("_copies"))


def mix(df: DataFrame, **options) -> DataFrame:
    """`df` with each row as often as systematic_copies says; the same columns."""
    mixed = systematic_copies(df, **options).where(F.col("_copies") > 0)
    return mixed.select("_all", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_all.*")


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document with its size, its source's size and target, and the words the mix takes of it."""
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = systematic_copies(docs, size="size")
    return mixed.select("_all.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS mark
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, (n % 3 + 1)::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM r),
f AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS weights,
        coalesce(sum(cap) OVER fullest, 0.0) AS cut, coalesce(sum(w) OVER fullest, 0.0) AS gone
      FROM w WINDOW fullest AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, w * (total - cut) / (weights - gone) > cap AS is_full FROM f),
h AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER () AS all_cut,
        sum(CASE WHEN is_full THEN w ELSE 0.0 END) OVER () AS all_gone FROM g),
t AS (SELECT source, source_size,
        CASE WHEN is_full THEN cap ELSE w * (total - all_cut) / (weights - all_gone) END AS target FROM h),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5('mix' || coalesce('+' || d.source, '-')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u,
        row_number() OVER (PARTITION BY d.source ORDER BY
          lpad(length(bin(size))::VARCHAR, 2, '0') || rpad(substr(bin(size), 1, 4), 4, '0'),
          substr(mark, 1, 2), size, mark, doc_id) AS n
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       least(floor(rate * n::DOUBLE + u) - floor(rate * (n - 1)::DOUBLE + u), 3)::BIGINT * size AS taken
FROM k
"""
