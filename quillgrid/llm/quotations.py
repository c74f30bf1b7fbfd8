"""Quotation linking: conversations in reply order, without their quotes. DataFrame functions only.

Each line has a quote level, the number of `>` in front. A message's own text is its lines of level 0; the
lines of a higher level, and all lines of that level together, are quoted passages. Passages are
normalised (letters and digits, lower-cased, single spaces) and hashed, and joined within the conversation
to the earliest message whose own text, or line of it, is that passage. A message replies to the original
of its lowest quote level, the one with most quoted words, the latest of those. Threads follow replies to
their first message by doubling, in a number of rounds that grows with the logarithm of the longest chain.

A conversation, a line or a first message that holds a third of the rows is combined before shuffles
(originals by earliest turn) and ranked in cells of at most 1024 turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

MIN_WORDS = 4
CELL = 1024
QUOTE = r"^(?:\s*>)+ ?"
#: A line that only announces a quote.
ATTRIBUTION = r"(?i)^\s*(on|am|le|el)\b.*\b(wrote|schrieb|écrit|escribió)\b.*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    """Words of a normalised text."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def messages(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text and _quoted (level, passage, n, whole) of every row; a null text is empty."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body")))
    read = df.select("conv_id", "turn", "role", lines.alias("_lines"))
    quotes = F.exists("_lines", lambda x: x["level"] > 0)
    own = F.filter("_lines", lambda x: (x["level"] == 0) & ~(F.col("_quotes") & x["body"].rlike(ATTRIBUTION)))
    read = read.withColumn("_quotes", quotes).withColumn("_own", F.transform(own, lambda x: x["body"]))
    higher = F.filter("_lines", lambda x: x["level"] > 0)
    levels = F.array_distinct(F.transform(higher, lambda x: x["level"]))
    single = F.transform(higher, lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("passage"), F.lit(False).alias("whole")))
    joined = F.transform(levels, lambda k: F.struct(k.alias("level"), normalised(F.array_join(F.transform(F.filter(higher, lambda x: x["level"] == k), lambda x: x["body"]), " ")).alias("passage"), F.lit(True).alias("whole")))
    return read.select("conv_id", "turn", "role", F.regexp_replace(F.array_join("_own", "\n"), r"^\n+|\n+$", "").alias("own_text"), F.col("_own"), F.concat(single, joined).alias("_quoted"))


def reply_links(read: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn for each message that quotes an earlier one of its conversation."""
    quoted = read.where("turn is not null").select("conv_id", "turn", F.explode("_quoted").alias("q")).select("conv_id", "turn", "q.level", "q.passage", "q.whole")
    quoted = quoted.withColumn("n", words(F.col("passage"))).where((F.col("n") >= MIN_WORDS) | (F.col("whole") & (F.col("n") > 0)))
    quoted = quoted.select("conv_id", "turn", "level", "n", F.xxhash64("passage").alias("h"), F.length("passage").alias("size")).distinct()
    own = F.concat(F.transform("_own", lambda x: F.struct(normalised(x).alias("passage"), F.lit(False).alias("whole"))), F.array(F.struct(normalised(F.array_join("_own", " ")).alias("passage"), F.lit(True).alias("whole"))))
    originals = read.where("turn is not null").select("conv_id", "turn", F.explode(own).alias("o")).select("conv_id", "turn", "o.passage", "o.whole")
    originals = originals.withColumn("n", words(F.col("passage"))).where((F.col("n") >= MIN_WORDS) | (F.col("whole") & (F.col("n") > 0)))
    first = originals.groupBy("conv_id", F.xxhash64("passage").alias("h"), F.length("passage").alias("size")).agg(F.min("turn").alias("origin"))
    both = quoted.alias("q").join(first.alias("o"), F.col("q.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("q.h") == F.col("o.h")) & (F.col("q.size") == F.col("o.size")) & (F.col("origin") < F.col("turn")))
    by_origin = both.groupBy("q.conv_id", "turn", "origin").agg(F.min("level").alias("level"), F.sum("n").alias("n"))
    best = by_origin.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "n", "origin")).alias("b"))
    return best.select("conv_id", "turn", F.col("b.origin").alias("parent_turn"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn, depth of each message with a parent."""
    links = durable(links)
    jumps = links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    going = bool(links.head(1))
    while going:
        up = jumps.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root_turn").alias("r"), F.col("depth").alias("d"))
        joined = jumps.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("root_turn") == F.col("t")), "left")
        moved = durable(joined.select("conv_id", "turn", F.coalesce("r", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")))
        going = bool(moved.where("moved").head(1))
        jumps = moved.drop("moved")
    return links.alias("l").join(jumps.alias("j"), F.col("l.conv_id").eqNullSafe(F.col("j.conv_id")) & (F.col("l.turn") == F.col("j.turn"))).select("l.conv_id", "l.turn", "l.parent_turn", "j.root_turn", "j.depth")


def reply_order(read: DataFrame) -> DataFrame:
    """`read` without the columns that start with an underscore, with parent_turn, root_turn, depth and position.

    position counts from 0 within a conversation: threads by their first turn, and by turn within a thread,
    so a message stands after the one it answers. Rows that share a conversation and a turn share their
    links and are ordered by role; equal rows are interchangeable. Messages without a turn come first; they
    answer nothing and nothing answers them.
    """
    kept = [c for c in read.columns if not c.startswith("_")]
    found = threads(reply_links(read))
    at = read.select(*kept).alias("m").join(found.alias("t"), F.col("m.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("m.turn") == F.col("t.turn")), "left")
    rows = at.select("m.*", "t.parent_turn", F.coalesce("t.root_turn", "m.turn").alias("root_turn"), F.coalesce("t.depth", F.lit(0)).cast("long").alias("depth"))
    rows = rows.withColumn("_block", F.floor(F.coalesce("root_turn", F.lit(-1)) / CELL)).withColumn("_part", F.floor(F.coalesce("turn", F.lit(-1)) / CELL)).withColumn("_root", F.coalesce("root_turn", F.lit(-1)))
    cell = ["conv_id", "_block", "_root", "_part"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    blocks = cells.groupBy("conv_id", "_block").agg(F.sum("_n").alias("_n"))
    blocks = blocks.select("conv_id", "_block", (F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_block")) - F.col("_n")).alias("_sum"))
    cells = cells.withColumn("_before", F.sum("_n").over(Window.partitionBy("conv_id", "_block").orderBy("_root", "_part")) - F.col("_n"))
    starts = cells.alias("c").join(blocks.alias("b"), F.col("c.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("c._block") == F.col("b._block"))).select(F.col("c.conv_id").alias("_conv"), "c._block", "c._root", "c._part", (F.col("_sum") + F.col("_before")).alias("_start"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("turn", "role")) - 1)
    same = F.col("r.conv_id").eqNullSafe(F.col("s._conv"))
    for c in cell[1:]:
        same = same & (F.col(f"r.{c}") == F.col(f"s.{c}"))
    return ranked.alias("r").join(starts.alias("s"), same).select(*[f"r.{c}" for c in kept], "parent_turn", "root_turn", "depth", (F.col("_start") + F.col("_rank")).cast("long").alias("position"))


def conversations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every message with its place in the reply order and a digest of its text without quotes."""
    read = messages(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    read = read.withColumn("own_words", words(normalised(F.col("own_text"))).cast("long")).withColumn("n_quoted", F.size(F.filter("_quoted", lambda q: ~q["whole"])).cast("long")).withColumn("own_sha256", F.sha2(F.col("own_text"), 256)).drop("own_text")
    return reply_order(read)


QUOTATIONS_SQL = r"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
line AS (SELECT rid, conv_id, turn, n, length(regexp_replace(regexp_extract(x, '^(?:\s*>)+ ?'), '[^>]', '', 'g')) AS level, regexp_replace(x, '^(?:\s*>)+ ?', '') AS body
  FROM (SELECT rid, conv_id, turn, unnest(lines) AS x, generate_subscripts(lines, 1) AS n FROM raw)),
quoting AS (SELECT rid, max(level) > 0 AS quotes FROM line GROUP BY rid),
own AS (SELECT line.* FROM line JOIN quoting USING (rid) WHERE level = 0 AND NOT (quotes AND regexp_matches(body, '(?i)^\s*(on|am|le|el)\b.*\b(wrote|schrieb|écrit|escribió)\b.*:\s*$'))),
own_text AS (SELECT raw.rid, raw.conv_id, raw.turn, raw.role, regexp_replace(coalesce(t.x, ''), '^\n+|\n+$', '', 'g') AS own_text, coalesce(t.y, '') AS flat
  FROM raw LEFT JOIN (SELECT rid, string_agg(body, chr(10) ORDER BY n) AS x, string_agg(body, ' ' ORDER BY n) AS y FROM own GROUP BY rid) t USING (rid)),
passage AS (
  SELECT conv_id, turn, level, body AS p, false AS whole FROM line WHERE level > 0
  UNION ALL SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY n), true FROM line WHERE level > 0 GROUP BY rid, conv_id, turn, level),
original AS (SELECT conv_id, turn, body AS p, false AS whole FROM own UNION ALL SELECT conv_id, turn, flat, true FROM own_text),
q AS (SELECT DISTINCT conv_id, turn, level, p, n FROM (SELECT conv_id, turn, level, p, whole, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ' ')) END AS n
  FROM (SELECT conv_id, turn, level, whole, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) AS p FROM passage)) WHERE n >= 4 OR (whole AND n > 0)),
o AS (SELECT conv_id, p, min(turn) AS origin FROM (SELECT conv_id, turn, p, whole, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ' ')) END AS n
  FROM (SELECT conv_id, turn, whole, trim(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g')) AS p FROM original)) WHERE n >= 4 OR (whole AND n > 0) GROUP BY conv_id, p),
m AS (SELECT q.conv_id, q.turn, o.origin, min(level) AS level, sum(n) AS n FROM q JOIN o ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.p = o.p AND o.origin < q.turn GROUP BY ALL),
link AS (SELECT conv_id, turn, origin AS parent_turn FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1),
up AS (SELECT conv_id, turn, parent_turn AS anc, 1 AS depth FROM link
  UNION ALL SELECT up.conv_id, up.turn, link.parent_turn, up.depth + 1 FROM up JOIN link ON up.conv_id IS NOT DISTINCT FROM link.conv_id AND up.anc = link.turn),
top AS (SELECT conv_id, turn, anc AS root_turn, depth FROM up QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) = 1)
SELECT t.conv_id, t.turn, t.role,
  CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END::BIGINT AS own_words,
  coalesce(k.n, 0)::BIGINT AS n_quoted, sha256(own_text) AS own_sha256, link.parent_turn, coalesce(top.root_turn, t.turn) AS root_turn, coalesce(top.depth, 0)::BIGINT AS depth,
  (row_number() OVER (PARTITION BY t.conv_id ORDER BY coalesce(top.root_turn, t.turn) NULLS FIRST, t.turn NULLS FIRST, t.role) - 1)::BIGINT AS position
FROM (SELECT *, trim(regexp_replace(lower(own_text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM own_text) t
LEFT JOIN (SELECT rid, count(*) AS n FROM line WHERE level > 0 GROUP BY rid) k USING (rid)
LEFT JOIN link ON link.conv_id IS NOT DISTINCT FROM t.conv_id AND link.turn = t.turn
LEFT JOIN top ON top.conv_id IS NOT DISTINCT FROM t.conv_id AND top.turn = t.turn
"""
