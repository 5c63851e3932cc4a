"""Language-model scores from a hashed maximum-entropy model.

A token's probability is factored by class: P(class | history) * P(token | class).  The class softmax has hashed word
and skip features and class n-gram features of the history; the most frequent tokens are classes of their own, so for
them it is the whole model.  Inside a class, the maximum-entropy solution with token features alone is the smoothed
share of the class.  Feature weights are trained by distributed gradient updates: each round every task sums the
gradient over its part of the training texts, Spark adds the sums, and the driver holds one weight table of fixed size.

Token counts are a Spark table.  The TOP most frequent tokens travel with the job; counts of all others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.arrowtext import ASCII_LOWER, NOT_SPACE, RollingHash, mix, number, pieces, word_array, words
from rankflow.session import work_dir

#: the most frequent tokens that travel with the job (a bound, whatever the corpus)
TOP = 1 << 17
#: classes: the most frequent tokens by themselves, the others by their last two bytes
HEADS, ENDINGS = 24, 40
CLASSES = HEADS + ENDINGS
#: rows of the weight table: previous word, word before it, and the two pairs of neighbouring classes before a token
PREVIOUS, SKIP, PAIR = 1 << 13, 1 << 12, CLASSES * CLASSES
ROWS = PREVIOUS + SKIP + 2 * PAIR
#: first row and number of rows of each feature
FEATURES = ((0, PREVIOUS), (PREVIOUS, SKIP), (PREVIOUS + SKIP, PAIR), (PREVIOUS + SKIP + PAIR, PAIR))
ROUNDS, STEP, DAMPING, LARGEST = 3, 0.45, 2.0, 4.0
#: the end of a text as a token; no word is empty
END = b""
BATCH = 1 << 12
#: tokens whose gradient is added up together
GROUP = 1 << 14
BLOCKS = 64


def _fold(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0))


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, one after the other, and where each begins (and the last one ends)."""
    cut = np.frombuffer(words.buffers()[1], np.int64)[words.offset:][: len(words) + 1]
    raw = words.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8), cut


class _Ranks:
    """Place of words in ``top``, found by hash and compared byte by byte."""

    def __init__(self, top: pa.Array):
        self.top, self.end = top, pc.index_in(pa.scalar(END, pa.large_binary()), value_set=top).as_py()
        if len(top):
            raw, cut = _bytes_of(top)
            hashed = RollingHash(raw).of(cut[:-1], cut[1:])
            self.order = np.argsort(hashed, kind="stable")
            self.hashed = hashed[self.order]

    def of(self, words: pa.Array, hashed: np.ndarray) -> np.ndarray:
        """The place of each word, -1 if it has none."""
        if not len(self.top):
            return np.full(len(words), -1)
        near = np.minimum(np.searchsorted(self.hashed, hashed), len(self.hashed) - 1)
        same = np.flatnonzero(self.hashed[near] == hashed)
        rank = np.full(len(words), -1)
        rank[same] = self.order[near[same]]
        if not pc.all(pc.equal(self.top.take(pa.array(rank[same])), words.take(pa.array(same)))).as_py():  # words with one hash
            rank = pc.index_in(words, value_set=self.top).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return rank


_ranks_of: list[_Ranks] = []


def _ranks(top: pa.Array) -> _Ranks:
    """Kept for the task, which has one ``top``."""
    if not _ranks_of or _ranks_of[0].top is not top:
        _ranks_of[:] = [_Ranks(top)]
    return _ranks_of[0]


class Tokens:
    """The tokens of some texts in order, each text with its end: identity, hash and class."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, top: pa.Array):
        data, n = ASCII_LOWER[data], len(offsets) - 1
        starts, ends, doc, inside = words(data, offsets, NOT_SPACE)
        per = np.bincount(doc, minlength=n)
        self.counts = per + 1
        size = len(starts) + n
        at = np.arange(len(starts)) + doc
        self.ends = np.cumsum(self.counts) - 1
        self.doc = np.repeat(np.arange(n), self.counts)
        ids, self.distinct = number(word_array(data, starts, ends, inside)) if len(starts) else (
            starts, pa.array([], pa.large_binary()))
        ranks = _ranks(top)
        self.id = np.full(size, -1)
        self.id[at] = ids
        self.rank = np.full(size, -1 if ranks.end is None else ranks.end)
        self.hash = np.zeros(size, np.uint64)
        self.kind = np.full(size, classes(self.rank[self.ends[:1]], np.zeros(1, np.int64))[0] if n else 0)
        if len(starts):  # hash, rank and class depend on the word alone
            raw, cut = _bytes_of(self.distinct)
            hashed = RollingHash(raw).of(cut[:-1], cut[1:])
            rank = ranks.of(self.distinct, hashed)
            self.hash[at], self.rank[at] = hashed[ids], rank[ids]
            last = raw[cut[1:] - 1].astype(np.int64) << 8 | np.where(np.diff(cut) > 1, raw[cut[1:] - 2], 0)
            self.kind[at] = classes(rank, last)[ids]

    def features(self) -> list[np.ndarray]:
        """Row of the weight table for each feature of each token's history; before a text lies its end."""
        first = self.ends - self.counts + 1

        def before(x: np.ndarray, steps: int, blank) -> np.ndarray:
            out = np.empty_like(x)
            out[:steps], out[steps:] = blank, x[: len(x) - steps]
            for i in range(steps - 1):
                out[np.minimum(first + i, self.ends)] = blank
            return out

        end_kind = self.kind[self.ends[0]] if len(self.ends) else 0
        h1, h2 = before(self.hash, 1, 0), before(self.hash, 2, 0)
        k1, k2, k3 = (before(self.kind, i, end_kind) for i in (1, 2, 3))
        return [(h1 & np.uint64(PREVIOUS - 1)).astype(np.int64),
                PREVIOUS + (mix(h2 + np.uint64(1)) & np.uint64(SKIP - 1)).astype(np.int64),
                PREVIOUS + SKIP + k1 * CLASSES + k2, PREVIOUS + SKIP + PAIR + k2 * CLASSES + k3]


def classes(rank: np.ndarray, last: np.ndarray) -> np.ndarray:
    ending = HEADS + (mix(last.astype(np.uint64) + np.uint64(7)) % np.uint64(ENDINGS)).astype(np.int64)
    return np.where((rank >= 0) & (rank < HEADS), rank, ending)


@dataclass
class MaxentModel:
    top: pa.Array
    top_counts: np.ndarray
    total: int
    types: int
    mass: np.ndarray  # smoothed count of each class
    weights: np.ndarray  # ROWS x CLASSES
    bias: np.ndarray

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.types + 1)

    def logits(self, rows: list[np.ndarray], part: slice) -> np.ndarray:
        """One row a token.  Weights are clipped, so the exponentials stay in range."""
        out = np.take(self.weights, rows[0][part], axis=0)
        for r in rows[1:]:
            out += np.take(self.weights, r[part], axis=0)
        out += self.bias
        return out

    def class_log10(self, t: Tokens) -> np.ndarray:
        """log10 P(class | history) of every token, in sparse batches."""
        rows, out, ones = t.features(), np.empty(len(t.kind)), np.ones(CLASSES, np.float32)
        for a in range(0, len(t.kind), BATCH):
            part = slice(a, a + BATCH)
            z = self.logits(rows, part)
            own = z[np.arange(len(z)), t.kind[part]]
            out[part] = own - np.log(np.exp(z, out=z) @ ones)
        return out / math.log(10)

    def gradient(self, t: Tokens, into: np.ndarray, times: np.ndarray) -> None:
        """Adds observed minus expected classes to the row of every feature, and how often each row fires."""
        rows, ones = t.features(), np.ones(CLASSES, np.float32)
        slope = np.zeros((CLASSES, ROWS))
        for a in range(0, len(t.kind), GROUP):
            own = [r[a: a + GROUP] - base for r, (base, _) in zip(rows, FEATURES, strict=True)]
            by_class = np.empty((CLASSES, len(own[0])), np.float32)
            for b in range(0, len(own[0]), BATCH):
                part = slice(a + b, min(a + b + BATCH, a + GROUP))
                p = self.logits(rows, part)
                np.exp(p, out=p)
                p /= -(p @ ones)[:, None]
                p[np.arange(len(p)), t.kind[part]] += 1
                by_class[:, b: b + BATCH] = p.T
            # class by class: sums of one column by row take a single pass, in double precision
            for k in range(CLASSES):
                weights = by_class[k].astype(np.float64)
                for r, (base, size) in zip(own, FEATURES, strict=True):
                    slope[k, base: base + size] += np.bincount(r, weights=weights, minlength=size)
            for r, (base, size) in zip(own, FEATURES, strict=True):
                times[base: base + size] += np.bincount(r, minlength=size)
        into += slope.T


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, the end of a text as the empty word.  Tasks add up before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, texts = [], 0

        def added() -> pa.RecordBatch:
            t = pa.concat_tables(kept).group_by("word").aggregate([("n", "sum")])
            return pa.RecordBatch.from_arrays([t["word"].combine_chunks().cast(pa.binary()), t["n_sum"].combine_chunks()],
                                              names=["word", "n"])

        for _, data, offsets in pieces(batches, text):
            texts += len(offsets) - 1
            low = ASCII_LOWER[data]
            starts, ends, _, inside = words(low, offsets, NOT_SPACE)
            if len(starts):
                ids, distinct = number(word_array(low, starts, ends, inside))
                kept.append(pa.table({"word": distinct, "n": pa.array(np.bincount(ids, minlength=len(distinct)).astype(np.int64))}))
            if len(kept) == 24:
                yield added()
                kept.clear()
        if texts:
            kept.append(pa.table({"word": pa.array([END], pa.large_binary()), "n": pa.array([texts], pa.int64())}))
        if kept:
            yield added()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _class_mass(counts: DataFrame, top: pa.Array) -> np.ndarray:
    """Smoothed count of each class: (c + 0.5) of a head; of an ending class its counts, and half a count for each of
    its types and for what is unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("word").cast(pa.large_binary())
            rank = pc.index_in(word, value_set=top.slice(0, HEADS)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.frombuffer(word.buffers()[1], np.int64)[word.offset: word.offset + len(word) + 1]
            raw = np.frombuffer(word.buffers()[2], np.uint8) if word.buffers()[2] else np.zeros(1, np.uint8)
            size, ends = np.diff(at), np.maximum(at[1:] - 1, 0)
            last = np.where(size > 0, raw[ends].astype(np.int64) << 8 | np.where(size > 1, raw[np.maximum(ends - 1, 0)], 0), 0)
            kind = classes(rank, last)
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(n), pa.array(np.ones(len(n), np.int64))],
                                             names=["kind", "n", "types"])

    mass = np.full(CLASSES, 0.5)
    for r in counts.mapInArrow(run, "kind long, n long, types long").groupBy("kind").agg(
            F.sum("n").alias("n"), F.sum("types").alias("types")).collect():
        mass[r["kind"]] = r["n"] + 0.5 * (r["types"] + (r["kind"] >= HEADS))
    return mass


def _round(texts: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and firing counts over ``texts`` under the model in the broadcast ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: MaxentModel = shared.value
        total, times, some = np.zeros((ROWS, CLASSES), np.float32), np.zeros(ROWS, np.float32), False
        for _, data, offsets in pieces(batches, "text"):
            model.gradient(Tokens(data, offsets, model.top), total, times)
            some = True
        if some:
            parts = np.array_split(np.concatenate([total, times[:, None]], axis=1), BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array([x.tobytes() for x in parts], pa.binary())],
                                             names=["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("part"), strict=True):
                x = np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
                sums[block] = sums[block] + x if block in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                                         names=["block", "part"])

    schema = "block long, part binary"
    got = {r["block"]: np.frombuffer(r["part"]) for r in
           texts.select("text").mapInArrow(run, schema).repartition(BLOCKS, "block").mapInArrow(add, schema).collect()}
    if not got:
        return np.zeros((ROWS, CLASSES)), np.zeros(ROWS)
    both = np.concatenate([got[b] for b in range(BLOCKS)]).reshape(ROWS, CLASSES + 1)
    return both[:, :-1], both[:, -1]


def train(docs: DataFrame, counts: DataFrame, doc_id: str = "doc_id") -> MaxentModel:
    """The model of the training texts ``docs`` (doc_id, text) and their token ``counts``; every training text is in
    the counts and in one gradient round."""
    top = counts.orderBy(F.length("word") > 0, F.desc("n"), "word").limit(TOP).toArrow()  # the end comes first
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words_top = top["word"].combine_chunks().cast(pa.large_binary()) if len(top) else pa.array([], pa.large_binary())
    mass = _class_mass(counts, words_top)
    share = mass / mass.sum()
    model = MaxentModel(words_top, top["n"].to_numpy() if len(top) else np.zeros(0, np.int64), total, types, mass,
                        np.zeros((ROWS, CLASSES), np.float32), np.log(share).astype(np.float32))
    for k in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        slope, times = _round(docs.where((_fold(doc_id) / 5).cast("long") % ROUNDS == k), shared)
        step = STEP / (1 + 0.5 * k) * np.log1p(np.maximum(slope / (times[:, None] * share + DAMPING), -0.9))
        model.weights = np.clip(model.weights + step, -LARGEST, LARGEST).astype(np.float32)
        shared.destroy()
    return model


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Learns from rows whose crc32(doc_id as text) mod 5 is not 1 (a null doc_id learns).  A null or empty text is one
    end token.  base_score is the smoothed unigram log10 probability, score the maximum-entropy model's.  With no
    training rows the counts are zero and the classes equally likely.  One output row per input row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = _fold("doc_id") % 5 == 1
    folder = work_dir(spark, "lm-counts")
    token_counts(docs.where(~held)).write.mode("overwrite").parquet(folder)
    counts = spark.read.parquet(folder)
    model = train(docs.where(~held), counts)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: MaxentModel = shared.value
        log_z = math.log10(m.denominator)
        top_log = np.append(np.log10(m.top_counts + 0.5), 0.0)
        class_log = np.log10(m.mass) - log_z
        for rows, data, offsets in pieces(batches, "text"):
            n = len(offsets) - 1
            t = Tokens(data, offsets, m.top)
            gain = np.bincount(t.doc, weights=m.class_log10(t) - class_log[t.kind], minlength=n)
            base = np.bincount(t.doc, weights=top_log[t.rank], minlength=n) - t.counts * log_z
            known = np.bincount(t.doc, weights=t.rank >= 0, minlength=n).astype(np.int64)
            # what is not among the top tokens: one row for each text and word
            rare = np.flatnonzero((t.rank < 0) & (t.id >= 0))
            base += math.log10(0.5) * (t.rank[t.ends] < 0)  # no training texts: not even the end is known
            pair, times = np.unique(t.doc[rare] * np.int64(len(t.distinct) + 1) + t.id[rare], return_counts=True)
            doc, word = pair // (len(t.distinct) + 1), pair % (len(t.distinct) + 1)
            row = rows.column("_row").to_numpy()
            blank = len(pair)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([row, row[doc]])),
                pa.concat_arrays([pa.array([b" %d" % x for x in row.tolist()], pa.binary()),
                                  t.distinct.take(pa.array(word)).cast(pa.binary())]),
                pa.concat_arrays([rows.column("doc_id"), pa.nulls(blank, rows.column("doc_id").type)]),
                pa.concat_arrays([pa.array(t.counts.astype(np.int64)), pa.array(times.astype(np.int64))]),
                pa.concat_arrays([pa.array(known), pa.nulls(blank, pa.int64())]),
                pa.concat_arrays([pa.array(base), pa.nulls(blank, pa.float64())]),
                pa.concat_arrays([pa.array(gain), pa.nulls(blank, pa.float64())]),
            ], names=["_row", "word", "doc_id", "m", "known", "base", "gain"])

    parts = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text").mapInArrow(
        run, f"_row long, word binary, doc_id {kind.simpleString()}, m long, known long, base double, gain double")
    own = F.col("known").isNotNull()
    rare_n = F.when(~own, F.col("m"))
    joined = parts.join(counts, "word", "left")
    out = joined.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.max(F.when(own, F.col("m"))).alias("n_tokens"),
        (F.max("known") + F.coalesce(F.sum(F.when(F.col("n").isNotNull(), rare_n)), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(rare_n * F.log10(F.coalesce("n", F.lit(0)) + 0.5)), F.lit(0.0))).alias("base_score"),
        F.max("gain").alias("gain"))
    return out.select("doc_id", (_fold("doc_id") % 5 == 1).alias("held_out"), "n_tokens", "n_known",
                      F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score",
                      (F.col("base_score") + F.col("gain")).alias("score"))
