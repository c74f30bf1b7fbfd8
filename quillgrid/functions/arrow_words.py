"""The tokenizers on Arrow text: words of many documents at once by tables of characters, the same as the column expressions.

Texts whose characters are all in KNOWN are cut here. The others, and whatever isn't UTF-8, are left to the
expressions, so that no rule of theirs (final sigma, combining marks, later alphabets) is repeated here.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokenizers import MIN_BYTES, TOKENIZERS, Tokenizer

#: Latin, Cyrillic and quotation marks and dashes, without the letters whose lower case has more bytes.
KNOWN = ((0x00, 0x12F), (0x131, 0x239), (0x23B, 0x23D), (0x23F, 0x24F), (0x400, 0x481), (0x48A, 0x52F), (0x2010, 0x2027))
#: A whole text of such characters; looking for one that isn't takes several times as long.
ALL_KNOWN = r"\A[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in KNOWN) + r"]*+\z"
SPACES = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0}
SLICE_BYTES = 1 << 20
OUT, BREAK, KEEP, SPOIL = range(4)
MIN_LETTERS = 3


def name_of(tokenizer: str | Tokenizer) -> str | None:
    """The name in TOKENIZERS; None for other functions."""
    return next((name for name, f in TOKENIZERS.items() if tokenizer in (name, f)), None)


def left_out(text: Column, tokenizer: str) -> Column:
    """The words of a text with a character that isn't in KNOWN; null for other texts."""
    return F.when(~text.rlike(ALL_KNOWN), TOKENIZERS[tokenizer](text))


def _plain(c: str) -> int:
    return KEEP if c.isalpha() or unicodedata.category(c)[0] == "N" else BREAK if ord(c) in SPACES else OUT


def _book(c: str) -> int:
    if "a" <= c.lower() <= "z" or "а" <= c.lower() <= "я" or c in "ёЁ":
        return KEEP
    return SPOIL if c.isalpha() or unicodedata.category(c) in ("Nd", "Pc") else BREAK


@cache
def tables(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """By code point: what the tokenizer does with the character, and its lower case."""
    kinds, lower = np.zeros(KNOWN[-1][1] + 1, np.uint8), np.arange(KNOWN[-1][1] + 1)
    for a, b in KNOWN:
        for n in range(a, b + 1):
            kinds[n], lower[n] = {"plain": _plain, "book": _book}[tokenizer](chr(n)), ord(chr(n).lower())
    return kinds, lower


def cut(texts: pa.Array, tokenizer: str) -> pa.ListArray:
    """The words of texts whose characters are all in KNOWN; null has none."""
    kinds, lower = tables(tokenizer)
    ended = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " ")  # a text never runs into the next
    _, offsets, data = ended.buffers()
    begins = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(ended.type) else np.int32)[ended.offset : ended.offset + len(ended) + 1]
    raw = np.frombuffer(data, np.uint8)[begins[0] : begins[-1]]
    begins = begins[:-1] - begins[0]
    ascii_kinds, ascii_lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    ascii_kinds[:128], ascii_lower[:128] = kinds[:128], lower[:128]
    kind, low = ascii_kinds[raw], ascii_lower[raw]
    two, three = np.flatnonzero((raw >= 0xC0) & (raw < 0xE0)), np.flatnonzero(raw >= 0xE0)
    if len(two):
        code = (raw[two] & 31).astype(np.int32) << 6 | raw[two + 1] & 63
        kind[two] = kind[two + 1] = kinds[code]
        low[two], low[two + 1] = 0xC0 | lower[code] >> 6, 0x80 | lower[code] & 63
    if len(three):  # without cases
        code = (raw[three] & 15).astype(np.int32) << 12 | (raw[three + 1] & 63).astype(np.int32) << 6 | raw[three + 2] & 63
        kind[three] = kind[three + 1] = kind[three + 2] = kinds[code]
    if tokenizer == "plain":
        stays = kind != OUT
        begins = np.r_[0, np.cumsum(np.add.reduceat(stays, begins, dtype=np.int64))[:-1]]
        kind, low = kind[stays], low[stays]
    inside = kind != BREAK
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if tokenizer == "plain":
        good = sizes >= MIN_BYTES
    elif len(starts):
        letters = np.add.reduceat(inside & (low & 0xC0 != 0x80), starts, dtype=np.int64)
        good = (letters >= MIN_LETTERS) & (np.add.reduceat(kind == SPOIL, starts, dtype=np.int64) == 0)
    else:
        good = np.zeros(0, bool)
    held = low[inside][np.repeat(good, sizes)]
    ends = np.r_[0, np.cumsum(sizes[good])].astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(held)])
    return pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(starts[good], begins), len(words)].astype(np.int32)), words)


def worded(batch: pa.RecordBatch, tokenizer: str) -> Iterator[pa.RecordBatch]:
    """A batch with text and words (those of `left_out`, else null) -> batches without text, with the words of every row."""
    texts, given = batch["text"], batch["words"]
    others = [c for c in batch.schema.names if c not in ("text", "words")]
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        n = max(1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - start)
        rows, left = np.arange(n), given.slice(start, n)
        if left.null_count == n:
            words = cut(texts.slice(start, n), tokenizer)
        else:  # by take, as if_else shifts sliced arrays wrongly
            has = left.is_valid().to_numpy(zero_copy_only=False)
            words = cut(texts.slice(start, n).take(pa.array(rows, mask=has)), tokenizer)
            words = pa.concat_arrays([words, left.cast(words.type)]).take(pa.array(rows + n * has))
        yield pa.RecordBatch.from_arrays([*(batch[c].slice(start, n) for c in others), words], [*others, "words"])
        start += n
