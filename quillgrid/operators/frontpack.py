"""Front packing of a sorted dictionary: blocks of terms share one stored prefix."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BLOCK = 16


def best_block(terms: list[str], start: int) -> tuple[int, int]:
    """End of the block that saves most bytes from `start`, and its prefix length in characters."""
    best, best_end, best_prefix, prefix = 0, start + 1, 0, terms[start]
    for end in range(start + 2, min(start + MAX_BLOCK, len(terms)) + 1):
        prefix = os.path.commonprefix([prefix, terms[end - 1]])
        if not prefix:
            break
        saved = (end - start - 1) * len(prefix.encode())
        if saved > best:
            best, best_end, best_prefix = saved, end, len(prefix)
    return best_end, best_prefix


def pack_block(terms: list[str], i: int, at: int) -> tuple[list[tuple[str, int, int, int, int, bytes]], int]:
    """Rows of the block of sorted terms that begins at i, stored from `at`, and where the next is stored."""
    end, cut = best_block(terms, i)
    if not cut:
        data = terms[i].encode()
        return [(terms[i], at, len(data), 0, 0, data)], at + len(data)
    prefix, out = terms[i][:cut].encode(), []
    start, at = at, at + len(prefix)
    for k, term in enumerate(terms[i:end]):
        suffix = term[cut:].encode()
        out.append((term, start, len(prefix), at, len(suffix), (prefix if k == 0 else b"") + suffix))
        at += len(suffix)
    return out, at


def pack(terms: list[str]) -> list[tuple[str, int, int, int, int, bytes]]:
    """Per sorted term: term, prefix start and length, suffix start and length (bytes), and the bytes it adds to the blob."""
    out, at = [], 0
    while len(out) < len(terms):
        rows, at = pack_block(terms, len(out), at)
        out += rows
    return out


def pack_sorted(batches: Iterable[list[str]]) -> Iterator[list[tuple[str, int, int, int, int, bytes]]]:
    """`pack` of each first character over batches of sorted terms; no more than a batch and a block are held."""
    held, at, first = [], 0, None
    for batch in chain(batches, [None]):
        held += batch or []
        out, i = [], 0
        while i < len(held) and (batch is None or i + MAX_BLOCK <= len(held)):
            if held[i][:1] != first:
                at, first = 0, held[i][:1]
            rows, at = pack_block(held, i, at)
            out += rows
            i += len(rows)
        held = held[i:]
        yield out


def packed_parts(dictionary: DataFrame) -> DataFrame:
    """`front_pack` with the offsets from the first term of the same first character.

    Terms are sorted by Spark and packed as they come, so a first character with very many terms fills no
    worker's memory.
    """
    schema = "term string, prefix_start long, prefix_len long, suffix_start long, suffix_len long, stored binary"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in pack_sorted(list(part["term"]) for part in parts):
            yield pd.DataFrame(rows, columns=["term", "prefix_start", "prefix_len", "suffix_start", "suffix_len", "stored"])

    return dictionary.select("term").repartition(F.substring("term", 1, 1)).sortWithinPartitions("term").mapInPandas(run, schema)


def front_pack(dictionary: DataFrame) -> DataFrame:
    """term -> term, prefix_start, prefix_len, suffix_start, suffix_len, stored (the bytes it adds).

    A block never spans two first characters, so the terms of each are packed apart and the offsets are
    shifted by the bytes before; the blob is `stored` in term order. suffix_len 0 with suffix_start 0
    means that the term is stored whole.
    """
    packed = packed_parts(dictionary).withColumn("_first", F.substring("term", 1, 1))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    sizes = packed.groupBy("_first").agg(F.sum(F.octet_length("stored")).alias("_bytes"))
    starts = sizes.select("_first", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    whole = (F.col("suffix_start") == 0) & (F.col("suffix_len") == 0)
    shifted = packed.join(F.broadcast(starts), "_first")  # a row per character
    return shifted.select("term", (F.col("prefix_start") + F.col("_start")).alias("prefix_start"), "prefix_len", F.when(whole, 0).otherwise(F.col("suffix_start") + F.col("_start")).cast("long").alias("suffix_start"), "suffix_len", "stored")


def unpack(blob: bytes, prefix_start: int, prefix_len: int, suffix_start: int, suffix_len: int) -> str:
    """A term from the blob and its offsets."""
    return (blob[prefix_start : prefix_start + prefix_len] + blob[suffix_start : suffix_start + suffix_len]).decode()
