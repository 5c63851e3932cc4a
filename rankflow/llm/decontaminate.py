"""Benchmark decontamination by winnowing.

Training and benchmark texts keep the minimum word-5-gram hash of every sliding window; a shared span of 13 words holds
at least one kept hash that both sides share.  Fingerprints of documents that meet a benchmark fingerprint are extended
to the windows around them, and those windows are compared exactly with the windows of the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.arrowtext import ALNUM, ASCII_LOWER, RollingHash, fresh, mix, pieces, sent_if_small, word_array, words
from rankflow.llm.bloom import BitFilter, bit_filter
from rankflow.session import work_dir

SPAN, GRAM = 13, 5


def families(lengths: list[int], span: int = SPAN, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(window length, k, windows of k-grams to take the minimum of) for the window lengths that occur; items
    shorter than ``span`` words bring their own length."""
    return [(n, min(gram, n), n - min(gram, n) + 1) for n in sorted({min(span, x) for x in lengths if x > 0})]


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of ``width`` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


class Words:
    """Lower-cased words of some texts, their hashes, and the windows over them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = ASCII_LOWER[data]
        self.n = len(offsets) - 1
        self.starts, self.ends, self.doc, self.inside = words(data, offsets, ALNUM)
        self.data = data
        self.hash = RollingHash(data).of(self.starts, self.ends) if len(self.starts) else np.empty(0, np.uint64)
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave the text get the largest value."""
        h = self.hash
        if len(h) < k:
            return np.full(len(h), ~np.uint64(0))
        out = mix(h[: len(h) - k + 1])
        for i in range(1, k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i: len(h) - k + 1 + i])
        out = np.concatenate([out >> np.uint64(1), np.full(k - 1, ~np.uint64(0))])
        out[: len(h) - k + 1][self.doc[: len(h) - k + 1] != self.doc[k - 1:]] = ~np.uint64(0)
        return out

    def winnowed(self, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the k-grams that are the minimum of some window of ``width`` k-grams."""
        g = self.grams(k)
        real = g != ~np.uint64(0)
        if width > 1 and len(g):
            least = _slide(np.concatenate([np.full(width - 1, ~np.uint64(0)), g, np.full(width - 1, ~np.uint64(0))]),
                           width, np.minimum)
            real &= _slide(least, width, np.maximum)[: len(g)] == g
        at = np.flatnonzero(real)
        return at, g[at]

    def windows_near(self, at: np.ndarray, n: int, k: int) -> np.ndarray:
        """Starts of the n-word windows, within one text, that hold the k-gram at one of these positions."""
        near = np.unique((at[:, None] - np.arange(n - k + 1)[None, :]).ravel())
        near = near[(near >= 0) & (near + n <= len(self.doc))]
        return near[self.doc[near] == self.doc[near + n - 1]]

    def keys(self, at: np.ndarray, n: int) -> list[bytes]:
        """128-bit digests of the n words from each of these positions."""
        packed = word_array(self.data, self.starts, self.ends, self.inside).to_pylist() if len(at) else []
        return [xxhash.xxh3_128_digest(b" ".join(packed[i: i + n])) for i in at.tolist()]


def item_fingerprints(items: DataFrame, fams: list[tuple[int, int, int]]) -> DataFrame:
    """Winnowed hashes of benchmark texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in pieces(batches, "text"):
            w = Words(data, offsets)
            for n, k, width in fams:
                at, h = w.winnowed(k, width)
                size = np.diff(w.first)[w.doc[at]]
                yield pa.RecordBatch.from_arrays([pa.array(h[np.minimum(size, SPAN) == n].view(np.int64))], names=["h"])

    return items.select("text").mapInArrow(run, "h long").distinct()


def item_windows(items: DataFrame, fams: list[tuple[int, int, int]]) -> DataFrame:
    """(key, item_id) of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            w = Words(data, offsets)
            size = np.diff(w.first)
            for n, _, _ in fams:
                at = np.flatnonzero(np.minimum(size[w.doc], SPAN) == n)
                at = at[(at + n <= len(w.doc))]
                at = at[w.doc[at] == w.doc[at + n - 1]] if len(at) else at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.keys(at, n), pa.binary()), rows.column("item_id").take(pa.array(w.doc[at]))],
                    names=["key", "item_id"])

    return items.select("item_id", "text").mapInArrow(run, "key binary, item_id string").distinct()


def candidates(docs: DataFrame, fams: list[tuple[int, int, int]], known) -> DataFrame:
    """Every row of (_row, doc_id, text): its word count and its windows around fingerprints that the benchmark may
    share, as parallel arrays of window start, window length and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: BitFilter = known.value
        for rows, data, offsets in pieces(batches, "text"):
            w = Words(data, offsets)
            starts, sizes, keys = [], [], []
            for n, k, width in fams:
                at, h = w.winnowed(k, width)
                near = w.windows_near(at[bits.holds(h)], n, k)
                starts.append(near)
                sizes.append(np.full(len(near), n))
                keys += w.keys(near, n)
            start = np.concatenate(starts) if starts else np.empty(0, np.int64)
            size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
            doc = w.doc[start]
            order = np.argsort(doc, kind="stable")
            at = pa.array(np.searchsorted(doc[order], np.arange(w.n + 1)).astype(np.int32))
            local = (start - w.first[doc])[order]
            found = [pa.array(local.astype(np.int32)), pa.array(size[order].astype(np.int32)),
                     pa.array([keys[i] for i in order.tolist()], pa.binary())]
            struct = pa.StructArray.from_arrays(found, names=["at", "n", "key"])
            yield pa.RecordBatch.from_arrays(
                [rows.column("_row"), rows.column("doc_id"), pa.array(np.diff(w.first)),
                 pa.ListArray.from_arrays(at, struct)], names=["_row", "doc_id", "n_words", "near"])

    schema = f"_row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, " \
             "near array<struct<at: int, n: int, key: binary>>"
    return docs.select("_row", "doc_id", "text").mapInArrow(run, schema)


def _covered(spans):
    """Number of words covered by (start, length) pairs sorted by start."""
    step = F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["at"] + s["n"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(acc["end"], s["at"]))).alias("n")))
    return step["n"]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items (sorted ids) for every row of ``docs``
    (doc_id, text) against ``items`` (item_id, text).

    One output row per input row, repeated rows included.  Null and empty texts have no words and are clean; items
    without words are ignored and with no items every document is clean.  Only fingerprint hits leave their task;
    what a hot passage costs is its windows, and the key side of the join holds each (window, item) once, so the join
    is broadcast or skew-split.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in pieces(batches, "text"):
            w = Words(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(np.diff(w.first), SPAN)))], names=["n"])

    fams = families([r["n"] for r in items.select("text").mapInArrow(lengths, "n long").distinct().collect()])
    folder = work_dir(spark, "contamination")
    item_fingerprints(items, fams).write.parquet(f"{folder}/prints")
    prints = spark.read.parquet(f"{folder}/prints")
    known = spark.sparkContext.broadcast(bit_filter(prints, "h", prints.count()))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    candidates(rows, fams, known).write.parquet(f"{folder}/near")
    near = spark.read.parquet(f"{folder}/near")
    # most documents have no candidate: they need no join
    none = near.where(F.size("near") == 0).select(
        "_row", "doc_id", "n_words", F.array().cast("array<struct<at:int,n:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    hits = (near.where(F.size("near") > 0).select("_row", "doc_id", "n_words", F.explode("near").alias("w"))
            .select("_row", "doc_id", "n_words", "w.at", "w.n", "w.key")
            .join(item_windows(items, fams), "key", "left")
            .groupBy("_row", "doc_id", "n_words")
            .agg(F.array_sort(F.collect_set(F.when(F.col("item_id").isNotNull(), F.struct("at", "n")))).alias("spans"),
                 F.array_sort(F.collect_set("item_id")).alias("items"))).unionByName(none)
    n_hit = _covered(F.col("spans"))
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "items")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``contamination`` finds contaminated; all columns pass as they are."""
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"))
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row)
    folder = work_dir(docs.sparkSession, "contaminated")
    contamination(keyed.select(F.col(key).alias("doc_id"), "text"), items).where("contaminated").select(
        F.col("doc_id").alias(key)).distinct().write.parquet(folder)
    return keyed.join(sent_if_small(docs.sparkSession.read.parquet(folder)), key, "left_anti").select(*docs.columns)
