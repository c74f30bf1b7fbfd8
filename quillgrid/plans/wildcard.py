"""Wildcard search: terms from a vocabulary index (filter), matched exactly (refine), then their documents."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import MEDIUM, SIMPLE, STRATEGY, complexity, glob_terms, has_wildcard, legacy_terms, required_trigrams
from .query import LEGACY, STANDARD, QueryError


def like_prefix(text: str) -> str:
    return "".join("\\" + c if c in "%_\\" else c for c in text) + "%"


def expand_by_rotation(rotations: DataFrame, pattern: str) -> DataFrame:
    """Terms for a pattern with one `*`: turned so that the star comes last, it is a prefix scan."""
    head, tail = pattern.split("*")
    return rotations.where(F.col("rotation").like(like_prefix(f"{tail}${head}"))).select("term").distinct()


def expand_by_trigram(trigrams: DataFrame, vocabulary: DataFrame, pattern: str) -> DataFrame:
    """Terms that have all trigrams the pattern requires and match it; without a required trigram all terms are matched."""
    needed = required_trigrams(pattern)
    if not needed or any(len(x.encode()) < 3 for x in needed):
        return vocabulary.select("term").where(glob_terms(F.col("term"), pattern))
    having = trigrams.where(F.col("trigram").isin(needed)).groupBy("term").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(needed))
    short = vocabulary.where(F.octet_length("term") < 3).select("term")
    return having.select("term").union(short).where(glob_terms(F.col("term"), pattern)).distinct()


def expand_by_suffix(suffixes: DataFrame, pattern: str) -> DataFrame:
    """Terms that match, found by suffixes that begin with the pattern's longest literal run."""
    run = max(pattern.replace("?", "*").split("*"), key=len)
    found = suffixes.where(F.col("suffix").like(like_prefix(run))) if run else suffixes
    return found.select("term").distinct().where(glob_terms(F.col("term"), pattern))


def matches(term: Column, pattern: str, mode: str = STANDARD) -> Column:
    """Whether a term is one of the pattern's."""
    return legacy_terms(term, pattern) if mode == LEGACY else glob_terms(term, pattern)


def expand(pattern: str, vocabulary: DataFrame, rotations: DataFrame | None = None, trigrams: DataFrame | None = None, suffixes: DataFrame | None = None, mode: str = STANDARD) -> DataFrame:
    """Terms for a pattern. The access path follows the pattern's complexity; the result does not."""
    kind = complexity(pattern)
    if mode == LEGACY:
        return vocabulary.select("term").where(matches(F.col("term"), pattern, mode))
    if kind == SIMPLE and "*" in pattern and rotations is not None:
        return expand_by_rotation(rotations, pattern)
    if kind == MEDIUM and suffixes is not None:
        return expand_by_suffix(suffixes, pattern)
    if trigrams is not None:
        return expand_by_trigram(trigrams, vocabulary, pattern)
    return vocabulary.select("term").where(glob_terms(F.col("term"), pattern))


def documents_of(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """doc: documents with any of the terms. Catalyst broadcasts the terms only where their size is known to be small."""
    return postings.join(terms, "term", "left_semi").select("doc").distinct()


@dataclass
class WildcardResult:
    query: str
    documents: DataFrame | None
    seconds: float
    strategy: str
    error: str | None = None
    found: int = 0


def search_with_stats(query: str, search) -> WildcardResult:
    """search(query) with its strategy, the number of documents and the time of finding them; a query error is kept, not raised."""
    began = time.perf_counter()
    strategy = STRATEGY[complexity(query) if has_wildcard(query) else None]
    try:
        if not query.strip():
            raise QueryError("Empty query")
        documents = search(query)
        found = documents.count()
        return WildcardResult(query, documents, time.perf_counter() - began, strategy, found=found)
    except QueryError as error:
        return WildcardResult(query, None, time.perf_counter() - began, strategy, str(error))
