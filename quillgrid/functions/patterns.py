"""Wildcard patterns: `*` stands for any run of characters, `?` for one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMPLE, MEDIUM, COMPLEX = "simple", "medium", "complex"
STRATEGY = {SIMPLE: "Permutation Index", MEDIUM: "Hybrid (Multiple Indices)", COMPLEX: "Trigram Index", None: "Inverted Index"}


def has_wildcard(text: str) -> bool:
    return "*" in text or "?" in text


def escaped(literal: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in literal)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression, valid for Java and RE2."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else escaped(c) for c in pattern) + "$"


def complexity(pattern: str) -> str | None:
    """simple: at most one wildcard; medium: two that are under half of the bytes; else complex."""
    wild = sum(c in "*?" for c in pattern)
    if not wild:
        return None
    if wild == 1:
        return SIMPLE
    return MEDIUM if wild == 2 and wild / len(pattern.encode()) < 0.5 else COMPLEX


def required_trigrams(pattern: str) -> list[str]:
    """Trigrams that every match has, front padding `$$` included."""
    runs = re.split(r"[*?]", "$$" + pattern)
    return sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})


def glob_terms(term: Column, pattern: str) -> Column:
    """Whether `term` matches as a whole."""
    return term.rlike(glob_regex(pattern))


def legacy_terms(term: Column, pattern: str) -> Column:
    """What the original index cascade answers for ASCII patterns.

    One `?` or a medium pattern: nothing. One `*` in front or at the end: terms that contain the rest.
    `X*Y`: terms with X somewhere and Y anywhere before or after that place's start. Others: anchored.
    """
    kind = complexity(pattern)
    if kind == MEDIUM or (kind == SIMPLE and "?" in pattern):
        return F.lit(False)
    if kind != SIMPLE:
        return glob_terms(term, pattern)
    head, tail = pattern.split("*")
    if not head or not tail:
        return F.contains(term, F.lit(head + tail))
    places = F.sequence(F.lit(1), F.greatest(F.char_length(term), F.lit(1)))

    def split_at(i: Column) -> Column:
        rest = F.substr(term, i)
        return F.startswith(rest, F.lit(head)) & (F.contains(rest, F.lit(tail)) | F.contains(F.left(term, i - 1), F.lit(tail)))

    return F.exists(places, split_at)
