"""Tokenizers as column expressions: text -> array of lower-cased words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOOK_WORD = r"(?U)\b[а-яёА-ЯЁa-zA-Z]{3,}\b"
WHITE_SPACE = r"\p{IsWhite_Space}+"
NEITHER = r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]"
MIN_BYTES = 3
#: Text with such a run has a plain word: none of its characters is taken out, and each has a byte or more.
PLAIN_RUN = r"[\p{IsAlphabetic}\p{N}]{3}"

Tokenizer = Callable[[Column], Column]


def book_words(text: Column) -> Column:
    """Whole words of at least three Latin or Russian letters; words with any other character are left out."""
    return F.transform(F.regexp_extract_all(text, F.lit(BOOK_WORD), F.lit(0)), F.lower)


def plain_words(text: Column) -> Column:
    """Space-separated words without their non-alphanumeric characters, if at least three bytes remain.

    The whole text is cleaned and lowered in one go; only the length is looked at word by word.
    """
    return F.filter(F.split(F.lower(F.regexp_replace(text, NEITHER, "")), WHITE_SPACE), lambda w: F.octet_length(w) >= MIN_BYTES)


TOKENIZERS: dict[str, Tokenizer] = {"plain": plain_words, "book": book_words}


def resolve(tokenizer: str | Tokenizer) -> Tokenizer:
    """A name in TOKENIZERS, or any function from a text column to an array of words."""
    return tokenizer if callable(tokenizer) else TOKENIZERS[tokenizer]


def has_words(text: Column, tokenizer: str | Tokenizer) -> Column:
    """Whether the text has a word. Most texts show it by their first letters and aren't tokenized for it."""
    some = F.size(resolve(tokenizer)(text)) > 0
    return F.when(text.rlike(PLAIN_RUN), True).otherwise(some) if tokenizer in ("plain", plain_words) else some
