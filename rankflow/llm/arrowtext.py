"""Whole texts as flat byte arrays inside a task.

A text column of an Arrow batch already is one byte buffer plus offsets.  The operators work on that buffer with
numpy, a bounded piece at a time, so a task's memory follows ``PIECE_BYTES`` (or one very long text), not its
partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

PIECE_BYTES = 1 << 20

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_codes = np.arange(256)
#: bytes of ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after A-Z are lower-cased)
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: rows of short keys up to which a written table is sent to every task (some 20 MB)
SENT_ROWS = 1 << 18


def sent_if_small(keys: DataFrame) -> DataFrame:
    """A written table of short keys, for the small side of a join: broadcast if it has at most SENT_ROWS rows, so that
    texts stay where they are; else left to the planner."""
    return F.broadcast(keys) if keys.count() <= SENT_ROWS else keys


def plus(df: DataFrame, name: str, kind: DataType) -> tuple[DataFrame, StructType]:
    """``df`` without a column ``name``, and its schema with one at the end."""
    df = df.drop(name) if name in df.columns else df
    return df, StructType([*df.schema.fields, StructField(name, kind)])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return (raw[at[0]: at[-1]], at - at[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


def pieces(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = PIECE_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``max_bytes`` of text each (one row at least), as (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = flat(batch.column(text))
        start, n = 0, batch.num_rows
        while start < n:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1)
            yield (batch.slice(start, end - start), data[offsets[start]: offsets[end]],
                   offsets[start: end + 1] - offsets[start])
            start = end


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of bytes in ``member`` that stay within one text: (starts, ends, text number, inside mask)."""
    inside = member[data]
    if not inside.any():
        none = np.empty(0, np.int64)
        return none, none, none, inside
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, inside


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> pa.Array:
    """The words as one Arrow array (their bytes without what separates them)."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts),
                                 [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def number(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Exact identity of values within this array: (number of each, the distinct values)."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def per_text(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count (or sum of whole-number weights) by text number."""
    if weights is None:
        return np.bincount(doc, minlength=n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, doc, weights)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        x ^= x >> np.uint64(shift)
        if by:
            x *= np.uint64(by)
    return x


_BASE = 0x9E3779B97F4A7C15
_KEPT_POWERS = 1 << 22
_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), wrapping; kept for the task up to a bound."""
    have = _powers_of.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= _KEPT_POWERS:
        _powers_of[base] = out
    return out[:n]


class RollingHash:
    """64-bit hashes of arbitrary byte ranges of one array (wrapping polynomial over scrambled bytes, then mixed)."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
        self._up = _powers(_BASE, len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        scaled = table[data]
        scaled *= _powers(pow(_BASE, -1, 1 << 64), len(data))
        np.cumsum(scaled, out=self._sum[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sum[ends] - self._sum[starts]) * self._up[starts]
                   + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def windows(self, low: int, high: int, width: int) -> np.ndarray:
        """``of`` for every range of ``width`` bytes that lies within low and high, in order."""
        x = self._sum[low + width: high + 1] - self._sum[low: high + 1 - width]
        x *= self._up[low: high + 1 - width]
        x += np.uint64(width * 0x632BE59BD9B4E019 % (1 << 64))
        return mix(x)
