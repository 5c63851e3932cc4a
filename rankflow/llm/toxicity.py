"""Toxicity by compression distance.

Two zstandard dictionaries are trained on bounded samples of labelled texts: one on windows of ordinary texts, one on
toxic texts reduced to the words that recur in them and hardly in ordinary ones (unreduced, the trainer spends the
dictionary on words that both share).  Every window of a text is compressed with the ordinary dictionary and with both;
the bytes that the toxic one saves are the window's distance.  A document's distance is that of its most toxic window,
and held-back labelled texts calibrate distances to probabilities (monotonely, so any threshold on one is a threshold
on the other).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from rankflow.llm.arrowtext import ASCII_LOWER, pieces, plus

#: at most so many labelled texts of each label fit the dictionaries, and so many others calibrate
FIT_TOXIC, FIT_ORDINARY, CALIBRATE = 1000, 1500, 4000
#: a text of more bytes is left out of the samples (it is scored like any other)
SAMPLE_TEXT_BYTES = 40_000
WINDOW, STRIDE = 140, 70
ORDINARY_BYTES, TOXIC_BYTES = 7500, 1024
#: the ordinary dictionary trains on at most so many windows, drawn by hash from all of its texts
TRAIN_WINDOWS = 40_000
#: a word recurs in toxic texts if this share of them holds it, and it is so many times as frequent there
TELL_SHARE, TELL_RATIO = 0.03, 20
TOP = 24

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _held(doc_id: str, folds: int = 4, out: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == out, F.lit(False))


def telling_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Whole words that many toxic texts share and ordinary texts lack."""
    ones, zeros = (Counter(w for text in texts for w in set(_WORD.findall(text))) for texts in (toxic, ordinary))
    least = max(3.0, TELL_SHARE * len(toxic))
    return {w for w, n in ones.items() if n >= least and len(w) > 2
            and n / len(toxic) > TELL_RATIO * (zeros[w] + 1) / (len(ordinary) + TELL_RATIO)}


def toxic_content(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """The content of a dictionary trained on toxic texts, each reduced to its telling words (or their end, where
    there are too few to train)."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    if not toxic or not ordinary:
        return b""
    words = telling_words(toxic, ordinary)
    samples = [b" " + b" ".join(found) + b" " for text in toxic if (found := [w for w in _WORD.findall(text) if w in words])]
    if not samples:
        return b""
    try:
        # the trainer wants some volume
        return zstandard.train_dictionary(TOXIC_BYTES + 256, samples * (1 + 20_000 // sum(map(len, samples))), k=16, d=6).as_bytes()[-TOXIC_BYTES:]
    except zstandard.ZstdError:
        return b"".join(samples)[-TOXIC_BYTES:]


def _windows(text: bytes) -> list[bytes]:
    return [text[i: i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)]


def ordinary_content(texts: list[bytes]) -> bytes:
    """The content of a dictionary trained on ordinary windows (or their end, where there are too few to train)."""
    windows = {x for text in texts for x in _windows(text)}
    samples = sorted(windows, key=lambda x: (xxhash.xxh64_intdigest(x, 3), x))[:TRAIN_WINDOWS]
    try:
        return zstandard.train_dictionary(8192, samples, k=32, d=8).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:
        return b"".join(samples)[-ORDINARY_BYTES:]


@dataclass
class ToxicityModel:
    """Two dictionaries and the probability of a toxic label by distance, 0 to TOP."""

    ordinary: bytes
    toxic: bytes
    by_distance: list[float]

    def compressors(self):
        params = zstandard.ZstdCompressionParameters(
            compression_level=3, min_match=5, strategy=zstandard.STRATEGY_BTOPT, window_log=15, hash_log=13,
            chain_log=13, search_log=5, target_length=64, write_content_size=False, write_checksum=False,
            write_dict_id=False)
        make = lambda raw: zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(
            raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress
        return make(self.ordinary or b" " * 16), make((self.toxic + self.ordinary) or b" " * 16)

    def score(self, most: int, total: int) -> float:
        """The calibrated probability; what lies between two distances is filled by the sum over all windows."""
        at = min(max(most, 0), TOP)
        low, high = self.by_distance[at], self.by_distance[min(at + 1, TOP)]
        return low + (high - low) * (max(total - at, 0) / (max(total - at, 0) + 50.0))


def _saved(data: np.ndarray, offsets: np.ndarray, plain, toxic) -> Iterator[tuple[int, int]]:
    """Of each text the largest distance of a window and the sum of the positive ones."""
    low = ASCII_LOWER[data].tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        saved = [len(plain(w)) - len(toxic(w)) for w in _windows(low[a:b])]
        yield max(saved), sum(x for x in saved if x > 0)


def distances(docs: DataFrame, model: ToxicityModel, out: str = "distance") -> DataFrame:
    """``docs`` plus ``out``, the largest distance of a window of each whole text."""
    docs, schema = plus(docs, out, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors()
        for rows, data, offsets in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x for x, _ in _saved(data, offsets, *both)], pa.int64())],
                                             names=[*rows.schema.names, out])

    return docs.mapInArrow(run, schema)


def calibrated(counts: dict[tuple[int, int], int]) -> list[float]:
    """Probability of label 1 by distance from (distance, label) -> n: pooled where it would fall, so it never does."""
    total = sum(counts.values())
    prior = sum(n for (_, label), n in counts.items() if label) / total if total else 0.0
    blocks: list[list[float]] = []  # ones, all, width
    for at in range(TOP + 1):
        ones, zeros = counts.get((at, 1), 0), counts.get((at, 0), 0)
        blocks.append([ones + 0.5 * prior, ones + zeros + 0.5, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a, b, w = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + w]
    return [a / b for a, b, w in blocks for _ in range(int(w))]


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from labelled rows outside the held-out fold, in bounded samples taken by a hash of doc_id, one text (the
    least) of a doc_id.

    ``labels`` (doc_id, toxic): a document labelled twice counts as toxic if any label says so; null labels and rows
    without a text are ignored.  With no toxic or no ordinary texts the toxic dictionary adds nothing, and scores are
    the calibration sample's prior."""
    marked = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held("doc_id"))
              .groupBy("doc_id").agg(F.max("toxic").alias("label"))
              .withColumn("draw", F.xxhash64("doc_id", F.lit("toxicity"))).withColumn("use", F.pmod("draw", F.lit(3)) > 0))

    def some(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy("draw", "doc_id").limit(n).select("doc_id", "label", "use")

    for_fit = marked.where("use")
    chosen = some(for_fit.where("label = 1"), FIT_TOXIC).union(some(for_fit.where("label = 0"), FIT_ORDINARY)) \
        .union(some(marked.where("not use"), CALIBRATE))
    texts = docs.where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).select("doc_id", "text")
    # at most FIT_TOXIC + FIT_ORDINARY + CALIBRATE keys, and one text of each, however many rows have its doc_id
    sample = (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "use").agg(F.min("text").alias("text")))
    got = sample.where("use").select("label", "text").toArrow().to_pylist()
    by = {k: [r["text"].translate(_LOWER).encode() for r in got if r["label"] == k] for k in (0, 1)}
    model = ToxicityModel(ordinary_content(by[0]), toxic_content(by[1], by[0]), [])
    seen = (distances(sample.where("not use").select("label", "text"), model)
            .groupBy(F.least(F.greatest("distance", F.lit(0)), F.lit(TOP)).alias("at"), "label").count().collect())
    model.by_distance = calibrated({(r["at"], r["label"]): r["count"] for r in seen})
    return model


_LOWER = {c: c + 32 for c in range(65, 91)}


def scored(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """``docs`` plus ``out``, the probability of a toxic label from the whole text alone; a null or empty text gets
    that of distance 0.  Row by row, no shuffle; other columns pass as they are."""
    docs, schema = plus(docs, out, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors()
        for rows, data, offsets in pieces(batches, "text"):
            found = [model.score(*x) for x in _saved(data, offsets, *both)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.float64())],
                                             names=[*rows.schema.names, out])

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = fit(docs, labels)
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", _held("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
