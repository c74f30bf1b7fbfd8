"""Benchmark decontamination: a prefix-filtered containment join of item windows with document words.

Each benchmark item becomes windows of `WINDOW` consecutive words, and a document contains a window where
all of the window's words stand in a row. Windows and documents are sets of shingles (two consecutive
words) with positions. Shingles are ordered by rarity in the whole corpus; since the containment asked for
is 1, the prefix that must be joined is one shingle, the rarest of each window. A place in a document that
has it is a candidate if the window fits into the document around it (its offset is the positional bound,
its length the length bound), and candidates are compared word for word.

The windows of a benchmark up to `BOUND_BYTES` are broadcast. Beyond that, prefix shingles and document
shingles meet in a shuffled join, and documents are joined with their candidates.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, from_text, packed, table

WINDOW = 10
BOUND_BYTES = 16 << 20
#: Bytes of words: digits, letters and all that isn't ASCII; A-Z are lowered, the rest separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

Gate = dict[bytes, dict[bytes | None, list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]]]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def item_windows(words: list, width: int = WINDOW) -> list[tuple]:
    """Windows of an item; one that is shorter is one window, one without words none."""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def shingles(words: list | tuple) -> list[tuple]:
    return [(words[0], None)] if len(words) == 1 else list(zip(words, words[1:], strict=False))


def gate_of(windows: dict[tuple[bytes, ...], set[str]], counts: Counter) -> Gate:
    """first word -> second word -> (offset, window, items) of the windows whose rarest shingle that is."""
    gate: Gate = defaultdict(lambda: defaultdict(list))
    for window, items in windows.items():
        at, (a, b) = min(enumerate(shingles(window)), key=lambda s: (counts[s[1]], s[1][0], s[1][1] or b"", s[0]))
        gate[a][b].append((at, window, tuple(sorted(items))))
    return {a: dict(x) for a, x in gate.items()}


def occurrences(words: list[bytes], gate: Gate) -> Iterator[tuple[int, tuple[bytes, ...], tuple[str, ...]]]:
    """(start, window, items) of every verified occurrence."""
    n = len(words)
    for i in [i for i, w in enumerate(words) if w in gate]:
        seconds = gate[words[i]]
        candidates = seconds.get(None, ())
        if i + 1 < n:
            candidates = [*candidates, *seconds.get(words[i + 1], ())]
        for at, window, items in candidates:
            start = i - at
            if start >= 0 and start + len(window) <= n and tuple(words[start : start + len(window)]) == window:
                yield start, window, items


def covered(spans: list[tuple[int, int]]) -> int:
    """Positions inside any of the (start, end) spans."""
    total, upto = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, upto))
        upto = max(upto, end)
    return total


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def broadcast_scan(docs: DataFrame, windows: dict[tuple[bytes, ...], set[str]], text: str, keep_text: bool = True) -> DataFrame:
    """docs with _n_words, _n_hit and _items, for windows small enough to send to every task."""
    spark = docs.sparkSession
    known = {s for w in windows for s in shingles(w)}
    firsts = {a for a, _ in known}
    shared = spark.sparkContext.broadcast((known, firsts))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, firsts = shared.value
        found: Counter = Counter()
        singles = {a for a, b in known if b is None}
        for b in batches:
            for t in b["t"]:
                words = words_of(t)
                found.update(s for s in zip(words, words[1:], strict=False) if s[0] in firsts and s in known)
                if singles:
                    found.update((w, None) for w in words if w in singles)
        yield pd.DataFrame([(a, s, n) for (a, s), n in found.items()], columns=["a", "s", "n"])

    source = docs.select(F.col(f"`{text}`").cast("binary").alias("t"))
    totals = source.mapInPandas(count, "a binary, s binary, n long").groupBy("a", "s").agg(F.sum("n").alias("n"))
    counts = Counter({(bytes(r["a"]), None if r["s"] is None else bytes(r["s"])): r["n"] for r in totals.collect()})
    gate = spark.sparkContext.broadcast(gate_of(windows, counts))

    def scan(texts: list[bytes | None]) -> Iterator[tuple[int, int, list[str]]]:
        held = gate.value
        for t in texts:
            words, spans, items = words_of(t), [], set()
            for start, window, names in occurrences(words, held):
                spans.append((start, start + len(window)))
                items.update(names)
            yield len(words), covered(spans), sorted(items)

    return from_text(docs, text, "_n_words long, _n_hit long, _items array<string>", scan, keep_text=keep_text)


def word_column(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def shuffled_join(docs: DataFrame, bench: DataFrame, text: str, width: int = WINDOW) -> DataFrame:
    """The same result where the benchmark is too large to broadcast; bench has _item and its text column _t."""
    kept = docs.drop("_n_words", "_n_hit", "_items")
    rows = durable(packed(kept, F.monotonically_increasing_id().alias("_row"), word_column(F.col(f"`{text}`")).alias("_w")))
    n = F.size("_w")
    items = bench.select("_item", word_column(F.col("_t")).alias("_w")).where(n > 0)
    starts = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    windows = items.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, width))).alias("_window"))
    windows = windows.groupBy("_window").agg(F.sort_array(F.collect_set("_item")).alias("_names"))
    windows = durable(windows.withColumn("_id", F.monotonically_increasing_id()))

    def exploded(df: DataFrame, words: str, *keep: str) -> DataFrame:
        last = F.greatest(F.size(words) - 1, F.lit(1))
        each = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.array_join(F.slice(words, i + 1, 2), " "))
        return df.where(F.size(words) > 0).select(*keep, F.size(words).alias("_n"), F.posexplode(each).alias("_at", "_s"))

    single = windows.where(F.size("_window") == 1).select("_id", F.lit(1).alias("_n"), F.lit(0).alias("_at"), F.col("_window")[0].alias("_s"))
    of_windows = exploded(windows, "_window", "_id")
    of_docs = exploded(rows, "_w", "_row")
    by_word = rows.select("_row", F.size("_w").alias("_n"), F.posexplode("_w").alias("_at", "_s"))
    counts = of_docs.join(of_windows.select("_s").distinct(), "_s", "left_semi").groupBy("_s").agg(F.count("*").alias("_c"))
    rank = F.row_number().over(Window.partitionBy("_id").orderBy(F.coalesce("_c", F.lit(0)), "_s", "_at"))
    prefix = of_windows.where("_n > 1").join(counts, "_s", "left").withColumn("_k", rank).where("_k = 1").select("_id", "_s", F.col("_at").alias("_offset"), F.col("_n").alias("_length"))
    words = single.select("_id", "_s", F.col("_at").alias("_offset"), F.col("_n").alias("_length"))
    fits = (F.col("_at") >= F.col("_offset")) & (F.col("_at") - F.col("_offset") + F.col("_length") <= F.col("_n"))
    found = of_docs.where("_n > 1").join(prefix, "_s").where(fits).unionByName(by_word.join(words, "_s").where(fits))
    found = found.select("_row", "_id", (F.col("_at") - F.col("_offset")).alias("_start")).join(windows, "_id")
    listed = found.groupBy("_row").agg(F.collect_list(F.struct("_start", "_window", "_names")).alias("_found"))
    both = rows.join(listed, "_row", "left")
    real = F.filter(F.coalesce("_found", F.array()), lambda c: F.slice("_w", c["_start"] + 1, F.size(c["_window"])) == c["_window"])
    both = both.withColumn("_real", real)
    hit = F.size(F.array_distinct(F.flatten(F.transform("_real", lambda c: F.sequence(c["_start"], c["_start"] + F.size(c["_window"]) - 1)))))
    names = F.sort_array(F.array_distinct(F.flatten(F.transform("_real", lambda c: c["_names"]))))
    return both.select("_all.*", F.size("_w").cast("long").alias("_n_words"), hit.cast("long").alias("_n_hit"), names.alias("_items"))


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, bound: int = BOUND_BYTES, keep_text: bool = True) -> DataFrame:
    """`docs` with _n_words, _n_hit and _items (item ids as sorted strings).

    Null texts and texts without words have no words and no hits; items without words have no windows.
    Items with equal windows are all named; a null item id is the string "null". Repeated rows are judged
    each on their own. An empty benchmark hits nothing. Columns with the new names are replaced. Without keep_text
    the text column is left out.
    """
    named = bench.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("_item"), F.col(f"`{item_text}`").alias("_t"))
    size = named.agg(F.sum(F.octet_length("_t"))).head()[0] or 0
    if size * width > bound:  # each word stands in up to `width` windows
        joined = shuffled_join(docs, named, text, width)
        return joined if keep_text else joined.drop(text)
    windows: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for r in named.select("_item", F.col("_t").cast("binary").alias("_t")).toLocalIterator():
        for window in item_windows(words_of(bytes(r["_t"]) if r["_t"] is not None else None), width):
            windows[window].add(r["_item"])
    return broadcast_scan(docs, dict(windows), text, keep_text)


def clean_documents(docs: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without any benchmark window; the columns of `docs`."""
    scanned = contamination(packed(docs, F.col(f"`{text}`").alias("_text")), bench, "_text", keep_text=False, **options)
    return scanned.where("_n_hit = 0").select("_all.*")


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document with its words, the words hit, and the items found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    items = F.sha2(F.array_join("_items", ","), 256)
    return scanned.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


FOLD_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({FOLD_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({FOLD_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win FROM v),
s AS (SELECT DISTINCT size FROM x),
p AS (SELECT rid, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, s WHERE len(w) >= size),
m AS (SELECT rid, p.i, p.size, x.item FROM p JOIN x ON x.size = p.size AND x.win = array_to_string(list_slice(p.w, p.i, p.i + p.size - 1), ' ')),
h AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT rid, i, size FROM m)) GROUP BY rid),
n AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""
