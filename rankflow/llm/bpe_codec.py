"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For a byte-level BPE the encoding of every prefix of a pre-token ends in one token, and a sequence of tokens is the
encoding of its bytes exactly if every two neighbours are compatible (the merge rules leave the two side by side).
So the last token of a prefix is the one vocabulary entry that ends there and is compatible with the last token of
the prefix before it.  An automaton over the vocabulary lists the entries that end at each byte; back-pointers from
the last prefix give the ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from rankflow.llm.arrowtext import plus
from rankflow.llm.bpe import KEEP_CHARS, KEEP_ENTRIES, tables

NEVER = 1 << 60


class PrefixEncoder(dict):
    """Ids (int32 bytes) of pre-tokens, remembered up to a bound."""

    def __init__(self, path: str):
        super().__init__()
        self.t = t = tables(path)
        self.automaton = ahocorasick.Automaton()
        for i, raw in enumerate(t.bytes_of):
            if raw and (i in t.parts or len(raw) == 1):
                self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.automaton.make_automaton()
        self.alone = [bool(raw) and t.merged(raw) == [i] for i, raw in enumerate(t.bytes_of)]
        self.right_edge = [self._edge(i, 2) for i in range(len(t.bytes_of))]
        self.left_edge = [self._edge(i, 1) for i in range(len(t.bytes_of))]
        self.compatible_pairs: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces of a token that lie at its border, from the single byte up to the token itself, each with the
        rank of the merge that swallows it."""
        out, swallowed = [], NEVER
        while True:
            out.append((token, swallowed))
            if token not in self.t.parts:
                return out[::-1]
            rank, *pair = self.t.parts[token]
            token, swallowed = pair[side - 1], rank

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge rules turn bytes(a) + bytes(b) into a, b: while both tokens grow, no pair of border
        pieces that stand side by side merges before one of them is swallowed in its own token (on the right, an
        equal rank is later: the leftmost pair goes first)."""
        left, right, merge = self.right_edge[a], self.left_edge[b], self.t.merge
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = left[i], right[j]
            found = merge.get((x, y))
            if found is not None and found[0] < x_gone and found[0] <= y_gone:
                return False
            if x_gone == y_gone == NEVER:
                return True
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1

    def encode(self, raw: bytes) -> list[int]:
        """Last token of every prefix, in one pass; then back along the pointers."""
        last = [-1] * (len(raw) + 1)
        known, alone = self.compatible_pairs, self.alone
        for end, (token, size) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start == 0:
                if alone[token]:
                    last[end] = token
            elif (before := last[start]) >= 0:
                fits = known.get(pair := before << 20 | token)
                if fits is None:
                    if len(known) >= KEEP_ENTRIES:
                        known.clear()
                    fits = known[pair] = self.compatible(before, token)
                if fits:
                    last[end] = token
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= len(self.t.bytes_of[last[at]])
        return ids[::-1]

    def __missing__(self, pre: str) -> bytes:
        ids = np.array(self.encode(pre.encode()), np.int32).tobytes()
        if len(pre) <= KEEP_CHARS:
            if len(self) >= KEEP_ENTRIES:
                self.clear()
            self[pre] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode_text(text: str | None, path: str) -> bytes:
    """Ids of a whole text as the bytes of an int32 array; special strings become their own id."""
    enc = encoder(path)
    out = []
    for part, added in enc.t.segments(text or ""):
        out.extend(map(enc.__getitem__, enc.t.pre_tokens(part)))
        if added is not None:
            out.append(np.int32(enc.t.added[added]).tobytes())
    return b"".join(out)


def _encoded(texts: pa.Array, tokenizer: str) -> pa.ListArray:
    found = [encode_text(x.as_py(), tokenizer) for x in texts]
    at = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _decoded(column: pa.ListArray, tokenizer: str) -> pa.Array:
    pieces = tables(tokenizer).bytes_of
    column = column.fill_null([]) if column.null_count else column
    at = column.offsets.to_numpy()
    raw = [pieces[x] if 0 <= x < len(pieces) else b"" for x in column.values.to_numpy(zero_copy_only=False)[at[0]: at[-1]].tolist()]
    at = at - at[0]
    return pa.array([b"".join(raw[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` plus ``out``, the ids (array of int) of each whole text under the byte-level BPE file ``tokenizer``.

    Row by row, no shuffle.  A null or empty text has no ids; other columns pass as they are (one named ``out`` is
    replaced); an empty table gives an empty table.
    """
    docs, schema = plus(docs, out, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*rows.columns, _encoded(rows.column(text), tokenizer)],
                                                 names=[*rows.schema.names, out])

    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` plus ``out``, the text of each row's ids; bytes that are no UTF-8 become U+FFFD, special tokens
    their string.  A null list or an empty one gives an empty text; an id outside the vocabulary gives nothing."""
    encoded, schema = plus(encoded, out, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*rows.columns, _decoded(rows.column(ids), tokenizer)],
                                                 names=[*rows.schema.names, out])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every column of ``docs`` plus ``ids`` and ``decoded``, encoded and decoded by one Python worker a task."""
    docs, _ = plus(docs, "ids", ArrayType(IntegerType()))
    docs, _ = plus(docs, "decoded", StringType())
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                ids = _encoded(rows.column("text"), tokenizer)
                yield pa.RecordBatch.from_arrays([*rows.columns, ids, _decoded(ids, tokenizer)],
                                                 names=[*rows.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def ids_of(row: bytes) -> list[int]:
    return list(chain(np.frombuffer(row, np.int32).tolist()))
