"""Inversion of documents' words in Arrow batches: sums, parts of coded lists, bit blocks and lists of documents by term.

A chunk of whole documents is inverted at once, so what leaves a task is a row per term and chunk, not a
row per word. Chunks have about CHUNK_WORDS words, whatever the sizes of batches and of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.arrow_words import worded

CHUNK_WORDS = 1 << 21


def chunks(batches: Iterable[pa.RecordBatch], unit: int | None = None, most: int = CHUNK_WORDS) -> Iterator[pa.Table]:
    """Rows in order, cut where about `most` words are reached; rows of one `unit` of ids stay together."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        words = np.r_[0, np.cumsum(lengths(table))]
        begins = np.arange(1, table.num_rows) if unit is None else np.flatnonzero(np.diff(table["id"].to_numpy() // unit)) + 1
        start = 0
        while words[-1] - words[start] >= most:
            later = begins[begins > start]
            if not len(later):
                break
            fit = later[words[later] - words[start] <= most]
            end = int(fit[-1] if len(fit) else later[0])
            yield table.slice(start, end - start)
            start = end
        held = table.slice(start)
    if held is not None and held.num_rows:
        yield held


def lengths(table: pa.Table) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(table["words"]), 0).to_numpy()


def coded(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of the chunk, and of each word its term's place and its row."""
    words = table["words"].combine_chunks().flatten().dictionary_encode()
    rows = np.repeat(np.arange(table.num_rows), lengths(table))
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows


def inverted(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms; and of each distinct posting, by term and id: its term's place, the first row of its document, its id."""
    terms, place, row = coded(table)
    ids = table["id"].to_numpy()
    first = np.flatnonzero(np.r_[True, np.diff(ids) != 0])
    doc = np.searchsorted(first, np.arange(len(ids)), "right") - 1
    posting = np.unique(place * len(first) + doc[row])
    at = first[posting % len(first)]
    return terms, posting // len(first), at, ids[at]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column; the first row too."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def sums(table: pa.Table) -> dict:
    terms, place, row = coded(table)
    names = pc.binary_length(table["doc"]).to_numpy().astype(np.float64)
    n = len(terms)
    tf = np.bincount(place, minlength=n)
    place *= table.num_rows  # in place: no more arrays as long as the chunk than needed
    place += row
    del row
    place.sort()
    posting = place[changes(place)]
    del place
    held, at = posting // table.num_rows, posting % table.num_rows
    return {"term": terms, "tf": tf, "df": np.bincount(held, minlength=n), "doc_bytes": np.bincount(held, names[at], n).astype(np.int64)}


def pair_sums(table: pa.Table) -> dict:
    """Each two-word key of the chunk, and the bytes of the names of its documents."""
    terms, place, row = coded(table)
    beside = row[1:] == row[:-1]
    keys, at = np.unique(place[:-1][beside] * len(terms) + place[1:][beside], return_inverse=True)
    posting = np.unique(at * table.num_rows + row[1:][beside])
    names = pc.binary_length(table["doc"]).to_numpy().astype(np.float64)
    held = np.bincount(posting // table.num_rows, names[posting % table.num_rows], len(keys)).astype(np.int64)
    first, second = (terms.take(pa.array(x)) for x in (keys // max(1, len(terms)), keys % max(1, len(terms))))
    return {"bigram": pc.binary_join_element_wise(first, second, " "), "doc_bytes": held}


def vb_bytes(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Variable-byte codes one after another; numbers of size 0 are left out."""
    out, ends = np.zeros(int(sizes.sum()), np.uint8), np.cumsum(sizes)
    for k in range(5):
        has = sizes > k
        out[(ends - sizes)[has] + k] = (numbers[has] >> 7 * k) & 127
    out[ends[sizes > 0] - 1] |= 128
    return out


def runs(table: pa.Table, block: int | None) -> dict:
    """A term's list in each stretch of ids that follow one another (inside a block): first and last id, and the coded differences between."""
    terms, place, at, ids = inverted(table)
    every = table["id"].to_numpy()
    broken = np.r_[False, (np.diff(every) > 1) | (np.diff(every) < 0)]
    if block:
        broken |= np.r_[False, np.diff(every // block) != 0]
    starts = changes(place, np.cumsum(broken)[at])
    delta = np.r_[0, np.diff(ids)]
    size = 1 + sum((delta >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    size[starts] = 0
    offsets = np.r_[0, np.cumsum(size)][np.r_[starts, len(ids)]].astype(np.int32)
    inside = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(vb_bytes(delta, size))])
    ends = np.r_[starts[1:], len(ids)]
    return {"term": terms.take(pa.array(place[starts])), "first": ids[starts], "last": ids[ends - 1], "n": ends - starts, "inside": inside}


def matrix(table: pa.Table, block: int) -> dict:
    terms, place, _, ids = inverted(table)
    starts = changes(place, ids // block)
    bits = np.bitwise_or.reduceat(np.int64(1) << ids % block, starts) if len(starts) else ids
    return {"term": terms.take(pa.array(place[starts])), "block": (ids // block)[starts], "bits": bits}


def lists(table: pa.Table, block: int) -> dict:
    """Names of a term's documents in each block; in order of ids they are sorted."""
    terms, place, at, ids = inverted(table)
    starts = changes(place, ids // block)
    names = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(ids)].astype(np.int32)), table["doc"].combine_chunks().take(pa.array(at)))
    return {"term": terms.take(pa.array(place[starts])), "block": (ids // block)[starts], "documents": names}


def by_chunk(docs: DataFrame, schema: str, invert: Callable[[pa.Table], dict], unit: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """`invert` of each chunk of rows with `words`; with a tokenizer, rows have text and words as `worded` takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = batches if tokenizer is None else (part for batch in batches for part in worded(batch, tokenizer))
        for table in chunks(given, unit):
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in invert(table).items()})

    return docs.mapInArrow(run, schema)
