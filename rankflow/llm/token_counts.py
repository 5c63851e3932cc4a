"""Token counts by the whole-token shortcut.

Once per vocabulary it is proved which strings are a pre-token by themselves and merge to a single token: the merge
rules are run on every entry.  Pre-tokens found in that set count one, and only the others are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rankflow.llm.arrowtext import plus
from rankflow.llm.bpe import KEEP_CHARS, KEEP_ENTRIES, BpeTables, tables


def whole_tokens(t: BpeTables) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    out = set()
    for i, raw in enumerate(t.bytes_of):
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue  # part of a character: never a pre-token of a text
        if text and t.pre_tokens(text) == [text] and t.merged(raw) == [i]:
            out.add(text)
    return frozenset(out)


class _Counts(dict):
    """Tokens of a pre-token; what is not a proven whole token is merged once and remembered."""

    def __init__(self, t: BpeTables):
        super().__init__(dict.fromkeys(whole_tokens(t), 1))
        self.t, self.proven = t, len(self)

    def __missing__(self, pre: str) -> int:
        n = len(self.t.merged(pre.encode()))
        if len(pre) <= KEEP_CHARS:
            if len(self) > self.proven + KEEP_ENTRIES:
                for k in list(self)[self.proven:]:
                    del self[k]
            self[pre] = n
        return n


@lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(tables(path))


def count_tokens(text: str | None, path: str) -> int:
    counts, t = _counts(path), tables(path)
    return sum(sum(map(counts.__getitem__, t.pre_tokens(part))) + (added is not None)
               for part, added in t.segments(text or ""))


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` plus the long column ``out``: tokens of each whole text under the byte-level BPE file ``tokenizer``
    (a path that every executor has), without added begin or end tokens; special strings in a text count as the one
    token that they are.

    Row by row, no shuffle.  A null or empty text has 0 tokens; every other column passes as it is (one named
    ``out`` is replaced); an empty table gives an empty table.
    """
    docs, schema = plus(docs, out, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_tokens(x.as_py(), tokenizer) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())],
                                             names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def document_token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return token_counts(slim, tokenizer).select("doc_id", "n_bytes", "n_tokens",
                                                (F.col("n_tokens") > limit).alias("over_limit"))
