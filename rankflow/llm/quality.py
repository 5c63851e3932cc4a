"""Quality rules with adaptive thresholds.

Per language and source a mergeable quantile sketch of each ratio (counts by steps of 1/1000; sketches merge by adding
counts) gives quantiles, and a document fails where it lies beyond the fence of its group: so many interquartile ranges
above the upper quartile, and for ratios that are zero in most texts as far beyond the 99th percentile as that lies
above the upper quartile.  Cutoffs follow each group instead of being fixed; where a group has no spread at all, a few
steps are left for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankflow.llm.arrowtext import NOT_SPACE, number, pieces, word_array, words
from rankflow.session import work_dir

STEPS = 1000
#: ratio -> (numerator, denominator, whether its own tail sets the fence: most texts have none of it)
RATIOS = {
    "symbols": ("n_symbols", "word_chars", False),
    "dup_lines": ("n_dup_lines", "n_lines", True),
    "repeats": ("n_repeat_words", "n_words", True),
    "capitals": ("n_upper", "word_chars", False),
}
#: the fence lies so many interquartile ranges, or distances of the 99th percentile, above the upper quartile
FENCE, TAIL = 6, 2
#: steps left to a group without spread
LEAST = 25
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def _by_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word by text, and those of them equal to an earlier line of the text."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    doc = np.searchsorted(offsets, breaks, "right") - 1
    doc = np.sort(np.concatenate([np.arange(n), doc]), kind="stable")
    ends = np.empty_like(starts)
    ends[:-1], ends[-1:] = starts[1:], len(data)
    newline = data == 10
    size = np.concatenate([[0], np.cumsum(~newline)])
    filled = np.concatenate([[0], np.cumsum(inside)])
    at = np.concatenate([[0], np.cumsum(size[ends] - size[starts])]).astype(np.int64)
    lines = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(
        np.ascontiguousarray(data[~newline]))])
    real = filled[ends] > filled[starts]
    ids, _ = number(lines)
    both = doc[real] * np.int64(len(starts) + 1) + ids[real]
    n_lines = np.bincount(doc[real], minlength=n)
    distinct = np.bincount(np.unique(both) // (len(starts) + 1), minlength=n)
    return n_lines.astype(np.int64), (n_lines - distinct).astype(np.int64)


def _repeat_words(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words by text that lie in a 3-word window found at least twice in the text."""
    out = np.zeros(n, np.int64)
    if len(ids) < 3:
        return out
    top = np.int64(ids.max() + 1)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    if not len(at):
        return out
    _, pair = np.unique(ids[at] * top + ids[at + 1], return_inverse=True)
    _, triple = np.unique(pair * top + ids[at + 2], return_inverse=True)
    _, window, times = np.unique(doc[at] * np.int64(triple.max() + 1) + triple, return_inverse=True, return_counts=True)
    again = at[times[window] > 1]
    hit = np.zeros(len(ids), bool)
    for i in range(3):
        hit[again + i] = True
    return np.bincount(doc[hit], minlength=n).astype(np.int64)


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts ``COUNTS`` of each whole text.  A null or empty text has zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, text):
            n = len(offsets) - 1
            starts, ends, doc, inside = words(data, offsets, NOT_SPACE)
            ids = number(word_array(data, starts, ends, inside))[0] if len(starts) else starts
            n_lines, dup = _dup_lines(data, offsets, inside)
            found = {"n_words": np.bincount(doc, minlength=n).astype(np.int64),
                     "word_chars": _by_text(inside & ((data & 0xC0) != 0x80), offsets),
                     "n_symbols": _by_text(_SYMBOL[data], offsets), "n_dup_lines": dup,
                     "n_repeat_words": _repeat_words(ids, doc, n), "n_lines": n_lines,
                     "n_upper": _by_text(_UPPER[data], offsets)}
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *(pa.array(found[c]) for c in COUNTS)],
                                             names=[*keep, *COUNTS])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} long" for c in COUNTS]
    return docs.select(*keep, text).mapInArrow(run, ", ".join(kinds))


def step_of(numerator: str, denominator: str) -> Column:
    """The ratio in whole steps; 0 where there is nothing to divide by."""
    return F.expr(f"least(coalesce(({STEPS} * {numerator}) div nullif({denominator}, 0), 0), {STEPS})")


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable sketches: rows of (group, ratio, step, n).  At most STEPS + 1 steps a group and ratio."""
    steps = F.array(*[F.struct(F.lit(name).alias("ratio"), step_of(a, b).alias("step"))
                      for name, (a, b, _) in RATIOS.items()])
    return (measured.select(*by, F.explode(steps).alias("s")).groupBy(*by, "s.ratio", "s.step")
            .agg(F.count("*").alias("n")))


def cutoffs(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: the highest accepted step of each ratio."""
    group = Window.partitionBy(*by, "ratio")
    run = sketch.select("*", F.sum("n").over(group.orderBy("step")).alias("upto"), F.sum("n").over(group).alias("all"))
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), F.col("step"))).alias(f"q{q}")
    found = run.groupBy(*by, "ratio").agg(at(25), at(75), at(99))

    def limit(name: str, tail: bool) -> Column:
        reach = [F.lit(LEAST), FENCE * (F.col("q75") - F.col("q25"))] + [TAIL * (F.col("q99") - F.col("q75"))] * tail
        return F.max(F.when(F.col("ratio") == name, F.col("q75") + F.greatest(*reach))).alias(f"max_{name}")
    return found.groupBy(*by).agg(*[limit(name, tail) for name, (_, _, tail) in RATIOS.items()])


def judge(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of ``docs``.

    base_failed: under 50 words, or more than half of them in repeated 3-word windows.  kept: not base_failed, and no
    ratio above the cutoff that its group's sketches give; sketches cover the documents that pass the base.  Null
    groups are groups of their own.  Counts are written once to the shared work folder and read by both the sketches
    and the join; the join carries numbers only, and its other side has one row a group."""
    spark, by = docs.sparkSession, list(by)
    folder = work_dir(spark, "quality")
    text_counts(docs, [doc_id, *by]).write.mode("overwrite").parquet(folder)
    measured = spark.read.parquet(folder).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    limits = cutoffs(sketches(measured.where(~F.col("base_failed")), by), by)
    named = limits.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in limits.columns if c not in by])
    joined = measured.join(named, [measured[c].eqNullSafe(named[f"_{c}"]) for c in by], "left")
    fits = F.lit(True)
    for name, (a, b, _) in RATIOS.items():
        fits = fits & (step_of(a, b) <= F.coalesce(f"max_{name}", F.lit(STEPS)))
    return joined.select(doc_id, *COUNTS[:5], "base_failed", (~F.col("base_failed") & fits).alias("kept"), *by,
                         *COUNTS[5:], *[f"max_{name}" for name in RATIOS])
