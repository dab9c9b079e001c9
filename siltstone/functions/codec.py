"""Integer codecs of posting lists, and checksums.

Parquet already packs postings with delta and dictionary encodings; these are
for exchanging lists in the compact wire form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def encode_varint(values) -> bytes:
    """LEB128 of non-negative integers below 2**64, a whole sequence at a time."""
    if isinstance(values, np.ndarray) and values.dtype.kind == "i":
        bad = bool((values < 0).any())
    else:
        values = list(values)
        bad = any(int(v) < 0 or int(v) >> 64 for v in values)
    if bad:
        raise ValueError("a varint is an unsigned 64-bit integer")
    left = np.array(values, np.uint64)
    size = np.ones(len(left), np.int64)
    for k in range(1, 10):
        size += left >= np.uint64(1 << 7 * k)
    out = np.zeros(int(size.sum()), np.uint8)
    at, more = np.cumsum(size) - size, np.arange(len(left))
    while len(more):
        now = left[more]
        last = now < 128
        out[at[more]] = (now & np.uint64(127)).astype(np.uint8) | np.where(last, 0, 128).astype(np.uint8)
        left[more], at[more] = now >> np.uint64(7), at[more] + 1
        more = more[~last]
    return out.tobytes()


def decode_varint(data: bytes) -> list[int]:
    """All integers of a LEB128 sequence; truncated and overlong ones raise ValueError."""
    return decode_array(data).tolist()


def decode_array(data: bytes) -> np.ndarray:
    """As ``decode_varint``, unsigned and a whole sequence at a time."""
    byte = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(byte < 128)
    start = np.append(0, end + 1)  # the last is where what is left begins
    size = np.diff(start)
    if (size > 10).any() or (byte[end[size == 10]] > 1).any() or len(byte) - start[-1] >= 10:
        raise ValueError("a varint is longer than 64 bits")
    if start[-1] < len(byte):
        raise ValueError("a varint is cut short")
    if not len(end):
        return np.zeros(0, np.uint64)
    shift = (7 * (np.arange(len(byte)) - np.repeat(start[:-1], size))).astype(np.uint64)
    return np.bitwise_or.reduceat((byte & 127).astype(np.uint64) << shift, start[:-1])


@pandas_udf(T.BinaryType())
def varint_encode(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else encode_varint(v))


@pandas_udf(T.ArrayType(T.LongType()))
def varint_decode(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else decode_varint(d))


def varint_size(value: Column) -> Column:
    """Bytes that a non-negative integer takes as a varint."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


@pandas_udf(T.ArrayType(T.LongType()))
def running_sum(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else np.cumsum(np.asarray(v, np.int64)))


def delta_encode(values: Column) -> Column:
    """The first value, then the gaps between neighbours; empty for empty."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def delta_decode(gaps: Column) -> Column:
    """Running sums of gaps; undoes ``delta_encode``."""
    return running_sum(gaps)


def crc32_hex(data: Column) -> Column:
    """CRC-32 of a string or binary, eight hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")
