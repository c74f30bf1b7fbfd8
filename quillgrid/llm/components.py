"""Connected components of a graph that doesn't fit on one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Edges (16 bytes each) up to which one task settles the graph; more take rounds of shuffles. Same result.
ONE_TASK = 1 << 19


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").union(least.select("a", F.col("m").alias("b"))).distinct()


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a, b, ascending, and the smallest node that each reaches."""
    nodes = np.unique(np.r_[a, b])
    x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    root = np.arange(len(nodes))
    while True:
        # every root takes the least root next to it, then paths are cut short
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root, before):
            return nodes, nodes[root]


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Edges (a long, b long) -> node, root: the smallest node reachable, for every node that has an edge.

    Up to `one_task` distinct edges are settled in a task. Beyond, large-star and small-star steps alternate
    until the edges are the stars of their roots, which takes a number of rounds that grows with the
    logarithm of the longest chain. Hubs are combined before the shuffle and joined by keys, so no task
    holds all neighbours of a node. Each round is written to the shared folder; an empty graph gives an
    empty result, loops are ignored.
    """
    edges = durable(_directed(edges))
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if state[0] <= one_task:
            return _settled(edges)
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        seen = state
        edges = durable(_small_star(_directed(_large_star(edges))))


def _settled(edges: DataFrame) -> DataFrame:
    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b.to_numpy(np.int64) for b in batches]
        pairs = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
        nodes, roots = roots_of(pairs[:, 0], pairs[:, 1])
        yield pd.DataFrame({"node": nodes, "root": roots})

    return edges.select("a", "b").coalesce(1).mapInPandas(settle, "node long, root long")
