"""Exact deduplication with counting quotient filters.

Each partition builds filters over the 64-bit fingerprints of its texts. A fingerprint's leading bits are
its slice, the next its quotient, the rest its remainder. A filter holds, for 2**q quotients, two bits each
(whether the quotient is used, and in unary where its run ends), the remainders in order, packed to their
64 - slice - q bits, and counts for those that occur more than once: about 64 - slice - q + 3 bits for a
fingerprint instead of 64 for a sorted list, and nothing is lost. Two filters merge by walking their runs
in order: quotients may differ in width, remainders of a run are merged by size and counts are added.
Filters of a slice are merged two by two, so a task holds one slice whatever the input.

Fingerprints with a count above one send their rows to byte verification, where texts themselves are
grouped; which rows, a join with the repeated fingerprints tells (a broadcast one up to `BOUND_ROWS`). Equal
texts are combined before they are shuffled, so a group that holds a third of all rows travels once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, from_text, table

SLICE_ROWS = 1_000_000
FLUSH_ROWS = 1 << 20
MOST_SLICES = 16
#: Repeated fingerprints that are sent to every task at most.
BOUND_ROWS = 1 << 20


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, side by side."""
    if not width or not len(values):
        return b""
    bits = np.unpackbits(np.asarray(values, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=width)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """`n` values of `width` bits from the value `start` on."""
    out = np.zeros((n, 64), np.uint8)
    if width and n:
        first = start * width
        raw = np.unpackbits(np.frombuffer(data, np.uint8, (first + n * width + 7) // 8 - first // 8, first // 8), bitorder="little")
        out[:, :width] = raw[first % 8 : first % 8 + n * width].reshape(n, width)
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).ravel()


class CountingQuotientFilter:
    """Fingerprints of `bits` bits with counts: quotient bits say where a run stands, packed remainders what is in it.

    used: a bit for each quotient. run_ends: a bit for each remainder, set where its run ends. remainders:
    packed, in order. more: places of remainders that occur more than once, and counts: how often.
    """

    STEP = 1 << 16

    def __init__(self, bits: int, quotient_bits: int, used: np.ndarray, run_ends: np.ndarray, remainders: bytes, more: np.ndarray, counts: np.ndarray):
        self.bits, self.quotient_bits, self.used, self.run_ends, self.remainders, self.more, self.counts = bits, quotient_bits, used, run_ends, remainders, more, counts
        self.width = bits - quotient_bits

    def __len__(self) -> int:
        return len(self.run_ends)

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int = 64) -> CountingQuotientFilter:
        """From fingerprints in any order, each counted once or as often as `counts` says."""
        fingerprints = np.asarray(fingerprints, np.uint64)
        order = np.argsort(fingerprints, kind="stable")
        fingerprints = fingerprints[order]
        first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]][: len(fingerprints)])
        sums = np.diff(np.r_[first, len(order)]) if counts is None else np.add.reduceat(np.asarray(counts, np.int64)[order], first) if len(first) else np.zeros(0, np.int64)
        return cls._of(fingerprints[first], sums, bits)

    @classmethod
    def _of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From distinct fingerprints in order."""
        n = len(fingerprints)
        quotient_bits = min(bits, n.bit_length())
        width = bits - quotient_bits
        quotients = (fingerprints >> np.uint64(width) if width < 64 else np.zeros(n, np.uint64)).astype(np.int64)
        used = np.zeros(1 << quotient_bits, bool)
        used[quotients] = True
        more = np.flatnonzero(counts > 1)
        return cls(bits, quotient_bits, used, np.r_[quotients[1:] != quotients[:-1], True][:n], pack_bits(fingerprints, width), more, counts[more])

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Fingerprints in order with their counts, STEP at a time: the filter is invertible."""
        quotients = np.flatnonzero(self.used)
        run = np.cumsum(self.run_ends) - self.run_ends
        for k in range(0, len(self), self.STEP):
            rest = unpack_bits(self.remainders, self.width, min(self.STEP, len(self) - k), k)
            high = quotients[run[k : k + self.STEP]].astype(np.uint64)
            counts = np.ones(len(rest), np.int64)
            low, upto = np.searchsorted(self.more, [k, k + len(rest)])
            counts[self.more[low:upto] - k] = self.counts[low:upto]
            yield (high << np.uint64(self.width) if self.width < 64 else high) | rest, counts

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The counts of both: two sorted runs are walked side by side, a step at a time."""
        streams, held = [self.parts(), other.parts()], [None, None]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held = [next(s, none) for s in streams]
        while len(held[0][0]) and len(held[1][0]):
            upto = min(held[0][0][-1], held[1][0][-1])  # all of both up to here is at hand
            cuts = [int(np.searchsorted(f, upto, "right")) for f, _ in held]
            out.append(_added(*(x[:c] for (f, n), c in zip(held, cuts, strict=True) for x in (f, n))))
            held = [(f[c:], n[c:]) if c < len(f) else next(s, none) for (f, n), c, s in zip(held, cuts, streams, strict=True)]
        for k in (0, 1):
            if len(held[k][0]):
                out += [held[k], *streams[k]]
        return self._of(*(np.concatenate([x[k] for x in out]) if out else none[k] for k in (0, 1)), self.bits)

    def count(self, fingerprint: int) -> int:
        quotient, rest = fingerprint >> self.width, fingerprint & ((1 << self.width) - 1)
        if quotient >= len(self.used) or not self.used[quotient]:
            return 0
        run, ends = int(self.used[:quotient].sum()), np.flatnonzero(self.run_ends)
        low, high = (int(ends[run - 1]) + 1 if run else 0), int(ends[run]) + 1
        at = low + int(np.searchsorted(held := unpack_bits(self.remainders, self.width, high - low, low), np.uint64(rest)))
        if at == high or int(held[at - low]) != rest:
            return 0
        k = int(np.searchsorted(self.more, at))
        return int(self.counts[k]) if k < len(self.more) and self.more[k] == at else 1

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints with a count above one, and their counts."""
        both = [(f[n > 1], n[n > 1]) for f, n in self.parts()]
        return np.concatenate([np.zeros(0, np.uint64), *(f for f, _ in both)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in both)])

    def dump(self) -> bytes:
        head = np.array([self.bits, self.quotient_bits, len(self), len(self.more)], np.int64)
        return b"".join((head.tobytes(), np.packbits(self.used).tobytes(), np.packbits(self.run_ends).tobytes(), self.more.astype(np.uint32).tobytes(), self.counts.astype(np.int64).tobytes(), self.remainders))

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        bits, quotient_bits, n, more = (int(x) for x in np.frombuffer(data, np.int64, 4))
        at, size = 32, 1 << quotient_bits
        used = np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size).astype(bool)
        at += (size + 7) // 8
        ends = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        at += (n + 7) // 8
        places = np.frombuffer(data, np.uint32, more, at).astype(np.int64)
        counts = np.frombuffer(data[at + 4 * more : at + 12 * more], np.int64)
        return cls(bits, quotient_bits, used, ends, data[at + 12 * more :], places, counts)


def _added(f: np.ndarray, n: np.ndarray, g: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists of distinct fingerprints with counts as one."""
    at = np.searchsorted(f, g)
    both = at < len(f)
    both[both] = f[at[both]] == g[both]
    n = n.copy()
    n[at[both]] += m[both]
    new = ~both
    return np.insert(f, at[new], g[new]), np.insert(n, at[new], m[new])


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, fp (64-bit fingerprint) and sha (SHA-256 of the normalised text's bytes)."""

    def run(texts: list[bytes | None]) -> Iterator[tuple[int, bytes]]:
        for t in texts:
            t = (t or b"").lower()
            yield signed(xxhash.xxh3_64_intdigest(t)), hashlib.sha256(t).digest()

    return from_text(_needed(df, key, text), "_t", "fp long, sha binary", run, keep_text=False)


def signed(fingerprint: int) -> int:
    return fingerprint - (1 << 64) if fingerprint >> 63 else fingerprint


def _needed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"))


def repeated_fingerprints(rows: DataFrame, n_rows: int) -> DataFrame:
    """fp, n: fingerprints of `rows` (column fp) that occur more than once, by merging filters of partitions."""
    slices = max(0, min(MOST_SLICES, (n_rows // SLICE_ROWS).bit_length()))
    width = 64 - slices

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def filters(held: list[np.ndarray]) -> pd.DataFrame:
            fps = np.sort(np.concatenate(held).view(np.uint64))
            cuts = (fps >> np.uint64(width)).astype(np.int64) if slices else np.zeros(len(fps), np.int64)
            edges = np.flatnonzero(np.r_[True, cuts[1:] != cuts[:-1], True])
            inside = fps & np.uint64((1 << width) - 1)
            out = [(int(cuts[a]), CountingQuotientFilter.build(inside[a:b], bits=width).dump()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pd.DataFrame(out, columns=["slice", "filter"])

        held, size = [], 0
        for b in batches:
            held.append(b["fp"].to_numpy(np.int64))
            size += len(b)
            if size >= FLUSH_ROWS:
                yield filters(held)
                held, size = [], 0
        if size:
            yield filters(held)

    def merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks: list[CountingQuotientFilter | None] = []  # the k-th is merged from 2**k filters
        for b in batches:
            for data in b["filter"]:
                one, k = CountingQuotientFilter.load(bytes(data)), 0
                while k < len(ranks) and ranks[k] is not None:
                    one, ranks[k], k = ranks[k].merge(one), None, k + 1
                ranks[k:k + 1] = [one]
        whole = CountingQuotientFilter.build(np.zeros(0, np.uint64), bits=width)
        for f in ranks:
            whole = whole.merge(f) if f is not None else whole
        fps, counts = whole.repeated()
        yield pd.DataFrame({"fp": (fps | (np.uint64(key[0]) << np.uint64(width)) if slices else fps).view(np.int64), "n": counts})

    return rows.select("fp").mapInPandas(build, "slice long, filter binary").groupBy("slice").applyInPandas(merge, "fp long, n long")


def suspects(df: DataFrame, repeated: DataFrame, key: str, text: str, bound: int = BOUND_ROWS) -> DataFrame:
    """_k and t (normalised bytes) of the rows whose fingerprint is among `repeated`.

    Up to `bound` fingerprints (8 bytes each) are sent to every task, so that no other text is moved; more
    are joined by shuffle, with the same result.
    """
    n, shared = repeated.count(), None
    if n <= bound:
        shared = df.sparkSession.sparkContext.broadcast(np.sort(np.array([r["fp"] for r in repeated.toLocalIterator()], np.int64)))

    def run(texts: list[bytes | None]) -> Iterator[tuple[int, bytes | None]]:
        lowered = [(t or b"").lower() for t in texts]
        fps = np.array([signed(xxhash.xxh3_64_intdigest(t)) for t in lowered], np.int64)
        wanted = np.ones(len(fps), bool) if shared is None else np.isin(fps, shared.value)
        for fp, t, w in zip(fps.tolist(), lowered, wanted.tolist(), strict=True):
            yield fp, t if w else None

    read = from_text(_needed(df, key, text), "_t", "fp long, t binary", run, keep_text=False).where("t is not null")
    return (read if shared is not None else read.join(repeated, "fp", "left_semi")).select("_k", "t")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", bound: int = BOUND_ROWS) -> DataFrame:
    """One row per row of `df`: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are, after lower-casing A-Z; null counts as empty. The row
    with the largest key stays (null keys are smaller than any; rows that share the largest key all
    count as kept). Other columns of `df` aren't read; an empty table gives an empty result.
    """
    rows = durable(digests(df, key, text))
    again = suspects(df, durable(repeated_fingerprints(rows, rows.count()).select("fp")), key, text, bound)
    same = again.groupBy("t").agg(F.max("_k").alias("keep"), F.count("*").alias("n")).where("n > 1").select(F.unhex(F.sha2("t", 256)).alias("sha"), "keep", "n")
    joined = rows.join(same, "sha", "left")
    keep = F.when(F.col("n").isNull(), F.col("_k")).otherwise(F.col("keep"))
    return joined.select(F.col("_k").alias(key), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("_k").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document with the row that stays for its text."""
    return exact_groups(table(spark, sf_dir, "documents"))


EXACT_DEDUP_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
