"""Byte-level BPE tables from a public ``tokenizers`` file, shared by token counting and encoding.

The file is read where it is used; a task keeps one set of tables per path.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex

# The published byte-level pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: pre-tokens up to this length are remembered, at most so many at a time
KEEP_CHARS, KEEP_ENTRIES = 64, 400_000


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the
    others take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BpeTables:
    """Vocabulary, merge ranks, merge tree and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        value = {c: b for b, c in enumerate(chars)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in text)
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.byte_id = [vocab[c] for c in chars]
        #: (left id, right id) -> (rank, id of the merged token); of each merged token its parts
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = (rank, whole)
            self.parts.setdefault(whole, (rank, left, right))
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) \
            if self.added else None
        self.pre_tokens = regex.compile(PRE_TOKEN).findall

    def segments(self, text: str):
        """(stretch of ordinary text, added token that ends it or None), as the library cuts texts by default."""
        if self.split_added is None:
            yield text, None
            return
        at = 0
        for m in self.split_added.finditer(text):
            yield text[at: m.start()], m.group()
            at = m.end()
        yield text[at:], None

    def merged(self, raw: bytes) -> list[int]:
        """Ids of one pre-token by the merge rules: lowest rank first, leftmost among equals."""
        ids = [self.byte_id[b] for b in raw]
        return self._merge_long(ids) if len(ids) > 48 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        find, none = self.merge.get, (1 << 60, -1)
        open_pairs = [find(p, none) for p in zip(ids, ids[1:], strict=False)]
        while open_pairs and (best := min(open_pairs)) is not none:
            i = open_pairs.index(best)
            ids[i: i + 2] = [best[1]]
            del open_pairs[i]
            if i:
                open_pairs[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(open_pairs):
                open_pairs[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        merge, n = self.merge, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merge[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merge]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = merge[a, b][1], True, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := (ids[i], ids[after[j]])) in merge:
                    heapq.heappush(heap, (merge[p][0], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in merge:
                heapq.heappush(heap, (merge[p][0], before[i], *p))
        return [x for x, dropped in zip(ids, gone, strict=True) if not dropped]


@lru_cache(maxsize=2)
def tables(path: str) -> BpeTables:
    return BpeTables(path)
