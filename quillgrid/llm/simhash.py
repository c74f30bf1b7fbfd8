"""SimHash near-duplicates, found through vantage-point trees.

Distinct fingerprints are partitioned by a vantage-point tree whose upper levels are built from a
bounded sample; its leaves are the shards. A fingerprint is stored in the leaf it falls into, and visits
every later leaf that the triangle inequality can't rule out: at a node with vantage point v and radius
m, both sides are visited if the distance to v is within 3 of m. Each shard goes on splitting in memory
in the same way and compares exactly what is left, so all pairs within 3 bits are found, whatever the
sample was. A shard reports a star per cluster instead of all pairs in it; stars are joined by connected
components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, from_text, packed, table
from .components import connected_components

RADIUS = 3
SHINGLE = 3
SAMPLE = 16_384
LEAF_ROWS = 4_096
BRUTE = 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over XXH64 (seed 42) of word shingles, repeats counted; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """_key, _mark (a hash of the text) and fp (the 64 bits as a signed long) of every row."""

    def run(texts: list[bytes | None]) -> Iterator[tuple[int]]:
        for t in texts:
            fp = fingerprint(t, shingle)
            yield (fp - (1 << 64) if fp >> 63 else fp,)

    needed = df.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_mark"), F.col(f"`{text}`").alias("_text"))
    return from_text(needed, "_text", "fp long", run, keep_text=False)


class Tree:
    """Upper levels of a vantage-point tree. Nodes are (vantage point, radius, inner child, outer child); children below 0 are leaves."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.points, self.radii, self.children, self.leaves = [], [], [], 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(np.asarray(sample, np.uint64), max(0, math.ceil(math.log2(max(1, leaves)))), rng)

    def _grow(self, sample: np.ndarray, levels: int, rng: np.random.Generator) -> int:
        split = None
        if levels and len(sample) > 1:
            for v in sample[rng.integers(0, len(sample), 8)]:  # the widest spread of distances prunes best
                d = np.bitwise_count(sample ^ v)
                m = int(np.median(d))
                if (d <= m).all():
                    m -= 1
                if m >= 0 and (split is None or d.std() > split[3]):
                    split = (v, m, d <= m, d.std())
        if split is None or not split[2].any() or split[2].all():
            self.leaves += 1
            return -self.leaves
        at = len(self.points)
        self.points.append(split[0])
        self.radii.append(split[1])
        self.children.append(None)
        self.children[at] = (self._grow(sample[split[2]], levels - 1, rng), self._grow(sample[~split[2]], levels - 1, rng))
        return at

    def route(self, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it is the row's own leaf) of every leaf a row must visit; only leaves from its own on."""
        rows, leaves, homes = [], [], []
        stack = [(self.root, np.arange(len(fps)), np.ones(len(fps), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node - 1, np.int32))
                homes.append(home)
                continue
            d, m = np.bitwise_count(fps[at] ^ self.points[node]).astype(np.int16), self.radii[node]
            inner, outer = self.children[node]
            near = d <= m + radius if radius else d <= m
            far = d > m - radius
            stack.append((inner, at[near], (home & (d <= m))[near]))
            stack.append((outer, at[far], (home & (d > m))[far]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        row, leaf, home = np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)
        own = np.zeros(len(fps), np.int32)
        own[row[home]] = leaf[home]
        later = leaf >= own[row]
        return row[later], leaf[later], home[later]


class Clusters:
    """Union-find over positions, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def _flat(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.root[a], self.root[b]
        apart = x != y
        if apart.any():
            for i, j in np.unique(np.c_[x[apart], y[apart]], axis=0).tolist():
                i, j = self._find(i), self._find(j)
                if i != j:
                    self.root[max(i, j)] = min(i, j)
            self._flat()


def link(points: np.ndarray, queries: np.ndarray, fps: np.ndarray, clusters: Clusters, radius: int = RADIUS) -> None:
    """Join the clusters of fps[queries] and fps[points] within `radius`, by a tree in memory that prunes and then compares."""
    stack = [(points, queries)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > BRUTE:
            v = fps[p[len(p) // 2]]
            d = np.bitwise_count(fps[p] ^ v).astype(np.int16)
            m = int(np.median(d))
            m -= bool((d <= m).all())
            if (d <= m).any():
                e = np.bitwise_count(fps[q] ^ v).astype(np.int16)
                stack.append((p[d <= m], q[e <= m + radius]))
                stack.append((p[d > m], q[e > m - radius]))
                continue
        step = max(1, 4_000_000 // len(p))
        for k in range(0, len(q), step):
            some = q[k : k + step]
            i, j = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[p][None, :]) <= radius)
            clusters.add(some[i], p[j])


def fingerprint_links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (column fp, n of them) -> edges a, b whose components are those of all pairs within `radius`."""
    every = max(1, -(-n // SAMPLE))
    sample = np.array([r["fp"] for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = fps.sparkSession.sparkContext.broadcast(Tree(sample, -(-n // LEAF_ROWS)))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = b["fp"].to_numpy(np.int64)
            row, leaf, home = tree.value.route(values.view(np.uint64), radius)
            yield pd.DataFrame({"leaf": leaf, "fp": values[row], "home": home})

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        values = shard["fp"].to_numpy(np.int64)
        home = shard["home"].to_numpy(bool)
        clusters = Clusters(len(values))
        link(np.flatnonzero(home), np.arange(len(values)), values.view(np.uint64), clusters, radius)
        moved = np.flatnonzero(clusters.root != np.arange(len(values)))
        return pd.DataFrame({"a": values[moved], "b": values[clusters.root[moved]]})

    visits = fps.select("fp").mapInPandas(visit, "leaf int, fp long, home boolean")
    return visits.groupBy("leaf").applyInPandas(search, "a long, b long")


def near_duplicate_groups(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """_key, _mark, fp and component_id of every row of `df`.

    Fingerprints within `radius` bits are linked; component_id is the smallest key reachable through links.
    Null and empty texts have fingerprint 0 and link like others. A null key is a component_id only where
    all keys of the component are null. Repeated rows each get a row; other columns aren't read; an empty
    table gives an empty result.
    """
    rows = durable(fingerprints(df, key, text))
    distinct = durable(rows.groupBy("fp").agg(F.min("_key").alias("least")))
    edges = fingerprint_links(distinct, distinct.count(), radius)
    roots = durable(connected_components(edges).select(F.col("node").alias("fp"), "root"))
    least = roots.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(least, "root").select("fp", "root", "component")
    of = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("class"), F.coalesce("component", "least").alias("component_id"))
    of = durable(of)  # both sides of the next join are then shuffled for it alone, so that a fingerprint with very many rows can be split
    return rows.join(of, "fp").select("_key", "_mark", "fp", "class", "component_id")


def one_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The row with the smallest key of each near-duplicate group; the columns of `df`.

    A null key counts as the largest. Of rows that repeat the smallest key, the one with the least hash of
    the text stays, then with the least hash of all columns but maps; only rows equal in these are
    interchangeable.
    """
    order = F.struct(F.col("_key").isNull().alias("_null"), "_key", "_mark")
    kept = near_duplicate_groups(df, key, text, radius).groupBy("class").agg(F.min(order).alias("k")).select("k._key", "k._mark").distinct()
    rows = packed(df, F.col(f"`{key}`").alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_at"))
    both = rows.join(kept, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_mark")))
    first = Window.partitionBy("_key", "_mark").orderBy(F.xxhash64(*[F.col("_all").getField(c) for c, kind in df.dtypes if "map<" not in kind]))
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_all.*")


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document with its fingerprint and component."""
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("_key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
