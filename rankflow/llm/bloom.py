"""A bounded membership filter that a job may broadcast whatever the size of the set.

The bit array never exceeds ``MAX_BITS`` (64 MB).  It only thins out rows before an exact join, so a set too large for
it costs shuffle, not rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.arrowtext import mix

MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
#: at 12 bits a key one strange key in 43 passes
BITS_A_KEY = 12
_SECOND = np.uint64(0x9E3779B97F4A7C15)


class BitFilter:
    """Two positions a key in a bit array; keys are 64-bit numbers that are already well mixed."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.uint64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = self._at(keys)
        some = np.flatnonzero(out)
        out[some] = self._at(mix(keys[some] ^ _SECOND))
        return out

    def _at(self, keys: np.ndarray) -> np.ndarray:
        bit = keys.astype(np.uint64) & np.uint64(len(self.words) * 64 - 1)
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_filter(rows: DataFrame, columns: str | list[str], n: int,
               key: Callable[..., np.ndarray] | None = None) -> BitFilter:
    """The filter of a column of 64-bit keys, ``n`` of them (to choose its size), or of what ``key`` makes of several
    such columns (as unsigned numbers), in the task that sets the bits: one Python worker a task.  Bits are or-ed by
    Spark; the driver gets at most MAX_BITS / 64 words."""
    bits = MIN_BITS
    while bits < BITS_A_KEY * n and bits < MAX_BITS:
        bits *= 2
    words = np.zeros(bits // 64, np.uint64)
    names, made = [columns] if isinstance(columns, str) else columns, key or (lambda k: k)

    def positions(batches):
        for batch in batches:
            k = made(*(x.to_numpy(zero_copy_only=False).view(np.uint64) for x in batch.columns))
            at = np.unique(np.concatenate([k, mix(k ^ _SECOND)]) & np.uint64(bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))],
                                             names=["word", "bits"])

    found = (rows.select(*(F.col(x).cast("long") for x in names)).mapInArrow(positions, "word long, bits long")
             .groupBy("word").agg(F.bit_or("bits").alias("bits")))
    got = found.toArrow()
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return BitFilter(words)
