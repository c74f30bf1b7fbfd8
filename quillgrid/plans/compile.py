"""Parsed queries to DataFrames of matching documents.

Each index answers a whole query in one scan and one aggregation by document: the leaves become flags of
a document, and the Boolean expression filters on them. Only a query that also accepts documents with none
of its words (`not x`) is joined to the universe of documents.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import glob_terms
from ..operators.indexes import MATRIX_BLOCK
from .query import STANDARD, Near, Node, Phrase, QueryError, Term, Wildcard, accepts_absent, holds, leaves, phrase_offsets


def moved_back(positions: Column, offset: int) -> Column:
    return F.transform(positions, lambda p: p - offset) if offset else positions


def wanted_words(node: Node) -> list[str]:
    words: list[str] = []
    for leaf in leaves(node):
        words += [leaf.word] if isinstance(leaf, Term) else list(leaf.words) if isinstance(leaf, (Phrase, Near)) else []
    return list(dict.fromkeys(words))


def looked_up(node: Node) -> list[str]:
    """Words whose absence from the dictionary is an error in strict mode; words of longer phrases and of near are not."""
    found = [x.word if isinstance(x, Term) else x.words[0] for x in leaves(node) if isinstance(x, Term) or isinstance(x, Phrase) and len(x.words) == 1]
    return list(dict.fromkeys(found))


def require_terms(node: Node, terms: DataFrame) -> None:
    """Raise for a looked-up word that isn't in `terms`; one filtered read of at most as many rows as the query has words."""
    words = looked_up(node)
    have = {r["term"] for r in terms.where(F.col("term").isin(words)).select("term").distinct().collect()} if words else set()
    for word in words:
        if word not in have:
            raise QueryError(f"Term '{word}' not found")


def matching(flags: DataFrame, node: Node, names: dict, universe: DataFrame) -> DataFrame:
    """doc: rows of `flags` (doc and a Boolean per leaf) for which the query holds."""
    if accepts_absent(node):
        flags = universe.join(flags, "doc", "left")
    return flags.where(holds(node, lambda x: F.coalesce(F.col(names[x]), F.lit(False)))).select("doc")


def term_filter(node: Node, column: Column) -> Column:
    """Rows of an index by term that any leaf needs; plain words become a pushed-down IN."""
    words = wanted_words(node)
    needs = [column.isin(words)] if words else []
    needs += [glob_terms(column, x.pattern) for x in leaves(node) if isinstance(x, Wildcard)]
    return reduce(or_, needs) if needs else F.lit(False)


def search_inverted(node: Node, postings: DataFrame, universe: DataFrame) -> DataFrame:
    """Words and wildcards over (term, doc)."""
    names = {leaf: f"f{i}" for i, leaf in enumerate(leaves(node))}
    term = F.col("term")
    flags = [F.bool_or(term == x.word if isinstance(x, Term) else glob_terms(term, x.pattern)).alias(n) for x, n in names.items()]
    return matching(postings.where(term_filter(node, term)).groupBy("doc").agg(*flags), node, names, universe)


def search_coordinate(node: Node, index: DataFrame, universe: DataFrame, mode: str = STANDARD) -> DataFrame:
    """Words, phrases, near and wildcards over (term, doc, positions), or over tokens (term, doc, pos)."""
    names = {leaf: f"f{i}" for i, leaf in enumerate(leaves(node))}
    words = {w: f"p{i}" for i, w in enumerate(wanted_words(node))}
    term, whole = F.col("term"), "positions" in index.columns
    held = [F.flatten(F.collect_list(F.when(term == w, F.col("positions")))) if whole else F.collect_list(F.when(term == w, F.col("pos"))) for w in words]
    lists = [c.alias(n) for c, n in zip(held, words.values(), strict=True)]
    globs = [F.bool_or(glob_terms(term, x.pattern)).alias(n) for x, n in names.items() if isinstance(x, Wildcard)]
    found = index.where(term_filter(node, term)).groupBy("doc").agg(*lists, *globs)

    def flag(leaf) -> Column:
        at = [F.col(words[w]) for w in ((leaf.word,) if isinstance(leaf, Term) else leaf.words)]
        if isinstance(leaf, Near):
            near = lambda p: reduce(lambda a, b: a & b, [F.exists(q, lambda y: F.abs(y - p) <= leaf.distance) for q in at[1:]])
            return F.exists(at[0], near)
        if not at:
            return F.lit(False)
        shifted = [moved_back(c, o) for c, o in zip(at, phrase_offsets(len(at), mode), strict=True)]
        return F.size(reduce(F.array_intersect, shifted)) > 0

    flags = [flag(x).alias(n) if not isinstance(x, Wildcard) else F.col(n) for x, n in names.items()]
    return matching(found.select("doc", *flags), node, names, universe)


def search_bigram(node: Node, index: DataFrame, universe: DataFrame) -> DataFrame:
    """Phrases over (bigram, doc): documents with every adjacent pair, wherever the pairs stand."""
    names = {leaf: f"f{i}" for i, leaf in enumerate(leaves(node))}
    pairs = {leaf: sorted({f"{a} {b}" for a, b in zip(leaf.words, leaf.words[1:], strict=False)}) for leaf in names}
    gram = F.col("bigram")
    flags = [(F.count_distinct(F.when(gram.isin(p), gram)) == len(p)).alias(names[x]) for x, p in pairs.items()]
    wanted = sorted({g for p in pairs.values() for g in p})
    return matching(index.where(gram.isin(wanted)).groupBy("doc").agg(*flags), node, names, universe)


def search_matrix(node: Node, matrix: DataFrame, ids: DataFrame, universe: DataFrame) -> DataFrame:
    """Words over bit blocks (term, block, bits): AND, OR and NOT are bit operations on 32 documents at a time."""
    words = {x.word: f"b{i}" for i, x in enumerate(leaves(node))}
    term, block = F.col("term"), F.floor(F.col("id") / MATRIX_BLOCK)
    rows = [F.coalesce(F.bit_or(F.when(term == w, F.col("bits"))), F.lit(0)).alias(n) for w, n in words.items()]
    blocks = matrix.where(term.isin(list(words))).groupBy("block").agg(*rows)
    if accepts_absent(node):
        known = ids.join(universe, "doc", "left_semi").select(block.alias("block")).distinct()
        blocks = known.join(blocks, "block", "left")

    class Bits:
        def __init__(self, column: Column):
            self.column = column

        def __and__(self, other):
            return Bits(self.column.bitwiseAND(other.column))

        def __or__(self, other):
            return Bits(self.column.bitwiseOR(other.column))

        def __invert__(self):
            return Bits(F.bitwise_not(self.column))

    answer = holds(node, lambda x: Bits(F.coalesce(F.col(words[x.word]), F.lit(0).cast("long")))).column
    hits = blocks.select("block", answer.alias("bits")).where("bits != 0")
    numbered = ids.join(universe, "doc", "left_semi").withColumn("block", block)
    bit = F.expr(f"shiftright(bits, cast(id % {MATRIX_BLOCK} as int)) & 1")
    return numbered.join(hits, "block").where(bit == 1).select("doc")
