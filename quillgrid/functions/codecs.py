"""Variable-byte coding of ascending ids, as SQL expressions and, for decoding, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_vb(n: int) -> bytes:
    """Seven bits a byte, low bits first; the last byte has its high bit set."""
    if not 0 <= n < 1 << 32:
        raise ValueError(f"{n} isn't an unsigned 32-bit number")
    out = bytearray()
    while n >= 128:
        out.append(n & 127)
        n >>= 7
    out.append(n | 128)
    return bytes(out)


def decode_vb(data: bytes) -> list[int]:
    """The numbers of a variable-byte sequence; a cut last number is left out."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw & 128)
    if not len(ends):
        return []
    raw = raw[: ends[-1] + 1].astype(np.uint64)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & np.uint64(127)) << (place * 7).astype(np.uint64), starts).tolist()


def encode_delta_vb(ids: list[int]) -> bytes:
    """Sorted ids as differences (the first from 0), each variable-byte coded."""
    ids = sorted(ids)
    return b"".join(encode_vb(b - a) for a, b in zip([0, *ids], ids, strict=False))


def decode_delta_vb(data: bytes) -> list[int]:
    return np.cumsum(decode_vb(data)).tolist()


def vb_size(delta: Column) -> Column:
    """Bytes of one coded number."""
    return F.when(delta < 1 << 7, 1).when(delta < 1 << 14, 2).when(delta < 1 << 21, 3).when(delta < 1 << 28, 4).otherwise(5)


def vb_hex(delta: Column) -> Column:
    """One coded number as hex digits: its seven-bit groups as one number of as many bytes, in hex."""

    def groups(k: int) -> Column:
        low = [F.shiftleft(F.shiftright(delta, 7 * i).bitwiseAND(127), 8 * (k - 1 - i)) for i in range(k - 1)]
        return sum(low, F.shiftright(delta, 7 * (k - 1)) + 128)

    whole = F.when(delta < 1 << 7, delta + 128)
    for k in (2, 3, 4):
        whole = whole.when(delta < 1 << 7 * k, groups(k))
    return F.lpad(F.hex(whole.otherwise(groups(5))), 2 * vb_size(delta), "0")


def decoded_numbers(data: Column) -> Column:
    """Binary column of coded numbers -> array of them, in Arrow batches."""

    @F.pandas_udf("array<long>")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else decode_vb(b))

    return decode(data)


def decoded_deltas(data: Column) -> Column:
    """Binary column of coded differences -> array of ids, in Arrow batches."""

    @F.pandas_udf("array<long>")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else decode_delta_vb(b))

    return decode(data)
