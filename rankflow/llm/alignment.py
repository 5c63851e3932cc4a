"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both sides cut the same bytes (a space, then the text).  Within a batch ``pandas.merge_asof``, keyed by document,
finds for every token start the token of the other side that covers it.  Two tokens overlap exactly if the start of
one lies in the other, so the two directions together give all overlapping pairs.  Where tokens of both sides end at
one byte, a group ends.

Three passes over written tables: align (texts are cut once), count the linked id pairs, and score every document.
Pairs with at least a 2**18th of all links are at most 2**18 and go to every task; all others are joined by pair, and
none of those can be a hot key.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.arrowtext import pieces
from rankflow.llm.bpe import PRE_TOKEN, byte_chars
from rankflow.session import release, spread, work_dir

#: bits of an id of the second tokenizer in a pair code
SHIFT = 24
#: a pair that holds this share of all links, or more, is known to every task
FREQUENT = 1 << 18
#: distinct pairs that a counting task holds before it passes them on
HELD = 1 << 20


class Cutter:
    """One side: ids of texts, and the bytes of every id."""

    def cut(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _tables(self, token_bytes: list[bytes]) -> None:
        self.sizes = np.array([len(b) for b in token_bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.names = {end: np.array([f"{i}{end}" for i in range(len(token_bytes))], object) for end in ",|;"}

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        n = self.sizes[ids]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.raw[np.repeat(self.starts[ids], n) + at]


class ByteBpe(Cutter):
    """A byte-level BPE file of the tokenizers library, of space + text; special strings are plain text.

    Where the ids of the file are its merge order, the same merges run in tiktoken, which is three times as fast; a
    text that tiktoken's pattern gives up on (white space without end), and any other file, goes to the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        value = {c: b for b, c in enumerate(byte_chars())}
        vocab = self.library.get_vocab(with_added_tokens=False)
        special = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        size = 1 + max([*vocab.values(), *special])
        raw = [b""] * size
        for name, i in vocab.items():
            raw[i] = bytes(value[c] for c in name) if i not in special else name.encode()
        self._tables([special[i].encode() if i in special else b for i, b in enumerate(raw)])
        self.fast = self._fast(path, {b: i for i, b in enumerate(raw) if b and i not in special})

    @staticmethod
    def _fast(path: str, ranks: dict[bytes, int]):
        import tiktoken
        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        plain = {k: spec.get(k) for k in ("normalizer",)} == {"normalizer": None} and spec["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"),
            "use_regex": spec["pre_tokenizer"].get("use_regex", True)} and spec["pre_tokenizer"].get("use_regex", True)
        merges = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][a + b] for a, b in merges]
        singles = [i for b, i in ranks.items() if len(b) == 1]
        if not plain or len(singles) != 256 or order != sorted(order) or len(order) + 256 != len(ranks) or max(singles) > order[0]:
            return None
        return tiktoken.Encoding("byte-bpe", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def cut(self, texts):
        out = []
        for x in texts:
            try:
                out.append(self.fast.encode_ordinary(" " + x) if self.fast and len(x) < 1 << 20 else None)
            except BaseException as stop:  # the pattern's engine ends in a panic, which is no Exception
                if isinstance(stop, KeyboardInterrupt | SystemExit):
                    raise
                out.append(None)
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(left, self.library.encode_batch_fast([" " + texts[k] for k in left], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out


class Pieces(Cutter):
    """A sentencepiece file, of the text (the space before it is the model's own)."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self._tables([bytes([int(p[3:-1], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i)
                      else p.replace("▁", " ").encode() for i, p in ((i, m.id_to_piece(i)) for i in range(size))])

    def cut(self, texts):
        return self.model.encode(texts, num_threads=1, add_bos=False, add_eos=False)


@lru_cache(maxsize=4)
def cutter(path: str) -> Cutter:
    return Pieces(path) if path.endswith(".model") else ByteBpe(path)


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of a, token of b) of every overlapping pair, in order.  Starts lie in the bytes of all documents one
    after another, so they are sorted; both sides cover every byte of a document."""
    a = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(start_b))})
    of_a, of_b = pd.merge_asof(a, b, on="at", by="doc"), pd.merge_asof(b, a, on="at", by="doc")
    inner = start_a[of_b["a"].to_numpy(np.int64)] != start_b if len(b) else np.empty(0, bool)  # equal starts are in of_a
    code = np.concatenate([x["a"].to_numpy(np.int64) * max(len(b), 1) + x["b"].to_numpy(np.int64)
                           for x in (of_a, of_b[inner])])
    code.sort(kind="stable")  # two sorted runs
    return np.divmod(code, max(len(b), 1))


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in ids], np.int64)
    out = np.empty(n.sum(), np.int64)
    at = 0
    for x in ids:
        out[at: at + len(x)] = x
        at += len(x)
    return out, n


def align(texts: list[str], first: Cutter, second: Cutter) -> dict[str, list | np.ndarray]:
    """Per text: n_a, n_b, n_groups, n_links, groups (the digest's string), and its distinct linked pairs with their
    numbers (pairs, times).  Texts whose bytes either side does not give back have no tokens."""
    raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    whole = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw], np.int64)
    base = np.cumsum(size) - size
    sides, good = [], size > 0
    full = np.flatnonzero(good)
    for side in (first, second):
        ids, n = _flat(side.cut([texts[i] for i in full]))
        doc = np.repeat(full, n)
        length = np.bincount(doc, side.sizes[ids], len(texts)).astype(np.int64)
        fits = length == size
        sides.append((ids, doc))
        good &= fits
    for k, side in enumerate((first, second)):  # the lengths are right: are the bytes?
        ids, doc = sides[k]
        keep = good[doc]
        ids, doc = ids[keep], doc[keep]
        given = side.joined(ids)
        there = np.repeat(base, np.where(good, size, 0)) + _within(np.where(good, size, 0))
        differs = given != whole[there]
        wrong = np.repeat(np.arange(len(texts)), np.where(good, size, 0))[differs]
        good[wrong] = False
        sides[k] = ids, doc
    cut = []
    for side, (ids, doc) in zip((first, second), sides, strict=True):
        keep = good[doc]
        ids, doc = ids[keep], doc[keep]
        n = side.sizes[ids]
        per = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        begin = np.cumsum(n) - n  # in the bytes of the good documents
        cut.append((ids, doc, per, begin, begin + n))
    (ids_a, doc_a, n_a, start_a, end_a), (ids_b, doc_b, n_b, start_b, end_b) = cut
    link_a, link_b = overlaps(doc_a, start_a, doc_b, start_b)
    code = ids_a[link_a] << SHIFT | ids_b[link_b]
    ends = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
    group_doc = doc_a[np.searchsorted(end_a, ends)]
    in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
    # every group's tokens of a, then those of b
    text = np.empty(len(ids_a) + len(ids_b), object)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    for side, ids, group, place, closing in (
            (first, ids_a, group_a, np.arange(len(ids_a)) + before_b[group_a], "|"),
            (second, ids_b, group_b, np.arange(len(ids_b)) + (before_a + in_a)[group_b], ";")):
        closes = np.ones(len(ids), bool)
        closes[:-1] = group[1:] != group[:-1]
        text[place[~closes]] = side.names[","][ids[~closes]]
        text[place[closes]] = side.names[closing][ids[closes]]
    n_links = np.bincount(doc_a[link_a], minlength=len(texts)).astype(np.int64)
    to, upto = np.cumsum(n_a + n_b), np.cumsum(n_links)
    pairs, times, groups = [], [], []
    for i in range(len(texts)):
        found, n = np.unique(code[upto[i] - n_links[i]: upto[i]], return_counts=True)
        pairs.append(found)
        times.append(n)
        groups.append("".join(text[to[i] - n_a[i] - n_b[i]: to[i]].tolist())[:-1])
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(group_doc, minlength=len(texts)).astype(np.int64),
            "n_links": n_links, "groups": groups, "pairs": pairs, "times": times}


def _within(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _list_of(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.cumsum([0, *(len(x) for x in arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(kind.to_pandas_dtype())))


def aligned(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of every row, and the distinct linked id pairs of its text
    (pair = id of the first << 24 | id of the second) with their numbers.  Row by row, no shuffle."""
    slim = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = cutter(first), cutter(second)
        for rows, _, _ in pieces(batches, "text"):
            got = align([x or "" for x in rows.column("text").to_pylist()], a, b)
            sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"]]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *[pa.array(got[k]) for k in ("n_a", "n_b", "n_groups", "n_links")], pa.array(sha),
                 _list_of(got["pairs"], pa.int64()), _list_of(got["times"], pa.int32())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                "pairs array<long>, times array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best) of all documents' links: best if no pair of the same second id has a higher count."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            pair = np.concatenate([held, batch.column("pairs").flatten().to_numpy(zero_copy_only=False)])
            n = np.concatenate([numbers, batch.column("times").flatten().to_numpy(zero_copy_only=False)])
            held, at = np.unique(pair, return_inverse=True)
            numbers = np.bincount(at, n, len(held)).astype(np.int64)
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(numbers)], names=["pair", "n"])
                held, numbers = held[:0], numbers[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(numbers)], names=["pair", "n"])

    counts = rows.select("pairs", "times").mapInArrow(added, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    second = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    folder = work_dir(rows.sparkSession, "pair-counts")
    counts.withColumn("second", second).write.parquet(folder)
    counts = rows.sparkSession.read.parquet(folder)
    # one row an id of the second vocabulary, whatever the corpus
    highest = counts.groupBy("second").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "second").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs with at least a FREQUENT-th of all links, of which there can't be more than FREQUENT."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    got = counts.where(F.col("count") * F.lit(FREQUENT) >= F.lit(total)).toArrow()
    pair = got["pair"].to_numpy()
    order = np.argsort(pair)
    return pair[order], got["count"].to_numpy()[order], got["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)


def alignment(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    ``first`` is a byte-level BPE file, cut from space + text, ``second`` a sentencepiece file, cut from the text
    (paths that every executor has).  Texts that are null or empty, or that either side changes (its tokens' bytes
    differ), have no tokens: zeros and an empty digest.  Counts are over all rows, repeated ones included; equal
    highest counts are all best.  An empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    folder = work_dir(spark, "alignment")
    aligned(docs, first, second, doc_id, text).withColumn("rid", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    counted = pair_counts(rows)
    known, known_count, known_best = _frequent(counted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document with what the frequent pairs give, and a row each of its other pairs."""
        for batch in batches:
            links = batch.column("pairs")
            per = np.diff(links.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), per)
            pair = links.flatten().to_numpy(zero_copy_only=False)
            n = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            total, best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, doc[hit], n[hit] * known_count[at[hit]])
            np.add.at(best, doc[hit], n[hit] * known_best[at[hit]])
            rid = batch.column("rid").to_numpy()
            rest = np.flatnonzero(~hit)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rid, rid[doc[rest]]])), pa.concat_arrays([none, pa.array(pair[rest])]),
                 pa.concat_arrays([none, pa.array(n[rest])]), pa.concat_arrays([pa.array(total), pa.nulls(len(rest), pa.int64())]),
                 pa.concat_arrays([pa.array(best), pa.nulls(len(rest), pa.int64())])],
                names=["rid", "pair", "n", "count_sum", "n_best"])

    rows.select("rid", "pairs", "times").mapInArrow(score, "rid long, pair long, n long, count_sum long, n_best long") \
        .write.parquet(f"{folder}/scores")
    release(spark)
    scores = spark.read.parquet(f"{folder}/scores")
    rare = scores.where("pair IS NOT NULL").select("rid", "pair", "n").join(counted, "pair").select(
        "rid", (F.col("n") * F.col("count")).alias("count_sum"), (F.col("n") * F.col("best").cast("long")).alias("n_best"))
    sums = scores.where("pair IS NULL").select("rid", "count_sum", "n_best").unionByName(rare).groupBy("rid").agg(
        F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return rows.select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "rid").select(
        F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
