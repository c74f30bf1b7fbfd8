"""Consistent hashing with virtual nodes and bounded loads.

The ring is cut into `RING_CELLS` equal arcs. Each shard owns `virtual_nodes` points on it; a key
belongs to the first point clockwise from its arc. A shard takes no more than its capacity: keys
beyond it walk on clockwise to the next shard with room. Only the number of keys per arc reaches the
driver (at most RING_CELLS numbers, plus HOT_SPLIT for each of at most HOT_CELLS hot arcs, whatever
the input), where the walk is settled; the rows themselves are placed by a broadcast table of that
same bounded size.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_length, packed, table

RING_CELLS = 1 << 16
VIRTUAL_NODES = 128
HOT_SPLIT = 64
HOT_CELLS = 1024


def ring_points(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = RING_CELLS) -> list[tuple[int, int]]:
    """(arc, shard) of each virtual node, in ring order. A shard's points don't depend on how many shards there are."""
    points = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big") % cells, shard))
    return sorted(points)


def settle(counts: dict[tuple[int, int], int], shards: int, balance: float = 1.0, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (arc, part, first rank, rank after the last, shard, slot of the first).

    Every shard first takes keys of its own arcs, in ring order, up to its capacity; what is left walks
    clockwise. With balance 1 capacities are the counts n // shards and one more, so that shards differ
    by at most one key; above 1 each capacity is ceil(balance * n / shards), and fewer keys move.
    """
    points = ring_points(shards, virtual_nodes)
    arcs, owners = [a for a, _ in points], [s for _, s in points]
    total = sum(counts.values())
    if balance <= 1:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        room = [-int(-balance * total // shards)] * shards
    filled, pieces, left = [0] * shards, [], []

    def give(key: tuple[int, int], first: int, wanted: int, shard: int) -> int:
        took = min(wanted, room[shard])
        if took:
            pieces.append((*key, first, first + took, shard, filled[shard]))
            filled[shard] += took
            room[shard] -= took
        return took

    for key in sorted(counts):
        at = bisect_left(arcs, key[0]) % len(arcs)
        took = give(key, 0, counts[key], owners[at])
        if took < counts[key]:
            left.append((key, took, at))
    ahead = list(range(1, len(arcs) + 1))  # the next point that may have room; skips full shards for good

    for key, first, at in left:
        passed = []
        while first < counts[key]:
            passed.append(at)
            at = ahead[at] % len(arcs)
            while room[owners[at]] == 0:
                passed.append(at)
                at = ahead[at] % len(arcs)
            first += give(key, first, counts[key] - first, owners[at])
        for p in passed:
            ahead[p] = at if room[owners[at]] else ahead[at]
    return pieces


def bounded_load_shards(df: DataFrame, key: str, shards: int, balance: float = 1.0, virtual_nodes: int = VIRTUAL_NODES, spread: str | None = None) -> DataFrame:
    """`df` with `shard` (int) and `slot` (long, gapless from 0 within the shard).

    key: the column hashed to the ring. Null is a key like any other, and repeated keys share an arc;
    an arc with far more rows than others is split by the hash of `spread` (default: all columns), so
    that no task ranks a large part of the table. Ties are ordered by that hash too: only rows equal in
    key and spread are interchangeable, and they take neighbouring slots. Columns named shard or slot
    are replaced, other columns pass through; an empty table stays empty.
    """
    kept = df.drop("shard", "slot")
    tie = F.xxhash64(F.col(f"`{spread}`")) if spread else F.xxhash64(*[F.col(f"`{c}`") for c in kept.columns])
    at = F.xxhash64(F.col(f"`{key}`").cast("string"))
    rows = packed(kept, F.col(f"`{key}`").alias("_key"), at.alias("_at"), F.shiftrightunsigned(at, 48).cast("int").alias("_arc"), tie.alias("_tie"))
    counts = {r["_arc"]: r["count"] for r in rows.groupBy("_arc").count().collect()}
    limit = max(10_000, 16 * sum(counts.values()) // RING_CELLS)
    hot = sorted((a for a, n in counts.items() if n > limit), key=lambda a: -counts[a])[:HOT_CELLS]
    parts = {(a, 0): n for a, n in counts.items() if a not in set(hot)}
    part = F.lit(0)
    if hot:
        part = F.when(F.col("_arc").isin(hot), F.pmod(F.col("_tie"), F.lit(HOT_SPLIT)).cast("int")).otherwise(0)
        found = rows.where(F.col("_arc").isin(hot)).groupBy("_arc", part.alias("_part")).count().collect()
        parts |= {(r["_arc"], r["_part"]): r["count"] for r in found}
    pieces = df.sparkSession.createDataFrame(settle(parts, shards, balance, virtual_nodes), "_arc int, _part int, _first long, _after long, shard int, _slot long")
    order = Window.partitionBy("_arc", "_part").orderBy("_at", "_key", "_tie")
    ranked = rows.withColumn("_part", part).withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    placed = ranked.join(F.broadcast(pieces), ["_arc", "_part"]).where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_after")))
    return placed.select("_all.*", "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"))


def sharding_query(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """op1: every document with its shard and slot under the law `rows`; null texts have no bytes."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (byte_length(F.col("text")) + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = bounded_load_shards(docs, "doc_id", shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
