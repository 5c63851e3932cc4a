"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half of a text's shingle hashes.  For radius r, every bit gets a non-zero
vector of r + 1 bits; table v (each non-zero vector) keeps the bits whose vector has odd overlap with v.  The vectors
of r differing bits span at most r dimensions, so some v is orthogonal to all of them: the two fingerprints agree on
everything table v keeps.  Every linked pair meets in a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType

from rankflow.llm.arrowtext import ASCII_LOWER, NOT_SPACE, fresh, pieces, plus, sent_if_small, word_array, words
from rankflow.llm.components import connected_components
from rankflow.session import work_dir

BITS = 64
#: buckets up to this size are compared pair by pair, so a fingerprint meets at most so many others in a table;
#: larger ones go through shared midpoints instead, which is as exact and linear in their size
PAIRWISE = 256


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all ``size``-word shingles of each text, and the number of shingles by text."""
    data = ASCII_LOWER[data]
    starts, ends, doc, inside = words(data, offsets, NOT_SPACE)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    # the words one space apart: where word i starts there, and the shingle from it
    joined = b" ".join(word_array(data, starts, ends, inside).to_pylist())
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=at[1:])
    first = np.cumsum(n_words) - n_words
    begin = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    stop = np.minimum(begin + size, np.repeat(first + n_words, counts))
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], 42) for a, b in zip(at[begin].tolist(), (at[stop] - 1).tolist(), strict=True)]
    return np.array(found, np.uint64), counts


#: one byte's bits as eight byte-wide counters of a 64-bit number
_SPREAD = sum((np.arange(256, dtype=np.uint64) >> np.uint64(i) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from its hashes, which lie text by text.  Eight byte-wide counters are added at
    once, over runs of at most 255 hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    runs = -(-n // 255)
    first = np.cumsum(runs) - runs
    begin = np.repeat(np.cumsum(n) - n, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        ones = np.add.reduceat(_SPREAD[octets[:, j]], begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits = 2 * np.add.reduceat(ones, first, axis=0) > n[:, None]
        out[full] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * j)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` plus ``out``: the 64-bit fingerprint (as a signed long) of each whole text.  A null or empty text has
    fingerprint 0; other columns pass as they are (one named ``out`` is replaced)."""
    docs, schema = plus(docs, out, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, text):
            found = majority(*shingle_hashes(data, offsets, shingle)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found)], names=[*rows.schema.names, out])

    return docs.mapInArrow(run, schema)


def covering_masks(radius: int) -> list[int]:
    """The bits that each table keeps (as signed longs)."""
    vectors = [i % ((1 << radius + 1) - 1) + 1 for i in range(BITS)]
    masks = []
    for v in range(1, 1 << radius + 1):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> BITS - 1 else mask)
    return masks


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def _flips(fp: Column, radius: int) -> Column:
    """All values within ``radius`` // 2 bits of ``fp``, as an array."""
    out = F.array(fp)
    for _ in range(radius // 2):
        out = F.array_distinct(F.flatten(F.transform(
            out, lambda x: F.concat(F.array(x), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: x.bitwiseXOR(
                F.call_function("shiftleft", F.lit(1).cast("long"), i)))))))
    return out


def links(distinct: DataFrame, radius: int, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) such that two of them are connected by edges exactly if
    they are connected by links of at most ``radius`` bits; every edge is such a link.

    No side of a join here or below has a bound that suits the driver, so all are merge joins and none is broadcast.

    Buckets of up to ``pairwise`` fingerprints give their linked pairs.  In larger ones two fingerprints within
    ``radius`` bits share a value within radius // 2 and radius - radius // 2 bits; for an even radius each
    fingerprint names all values within half the radius, and links to the smallest fingerprint that names the same."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for i, m in enumerate(covering_masks(radius))])
    dealt = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = dealt.join(sizes.hint("merge"), ["t", "key"])
    folder = work_dir(distinct.sparkSession, "simhash-shared")
    shared.write.mode("overwrite").parquet(folder)
    shared = distinct.sparkSession.read.parquet(folder)
    small = shared.where(F.col("n") <= pairwise)
    a, b = small.select("t", "key", F.col("fp").alias("a")), small.select("t", "key", F.col("fp").alias("b"))
    edges = a.join(b.hint("merge"), ["t", "key"]).where((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"), radius)) \
        .select("a", "b")
    crowded = shared.where(F.col("n") > pairwise).select("fp").distinct()
    if radius % 2:
        raise ValueError("an even radius is needed")
    named = crowded.select("fp", F.explode(_flips(F.col("fp"), radius)).alias("mid"))
    least = named.groupBy("mid").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    via = named.join(least.hint("merge"), "mid").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return edges.union(via).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, text: str = "text", doc_id: str = "doc_id"
                    ) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``: fingerprints link at ``radius`` or fewer differing bits,
    and component_id is the smallest doc_id reachable, the row's own included.

    Equal fingerprints are one node, so copies cost nothing after the first aggregate, and only distinct fingerprints
    are compared.  Texts without words have fingerprint 0 and link like any other.  Rows with a null doc_id get their
    component's smallest non-null id (null if there is none).  An empty table gives an empty result."""
    spark = docs.sparkSession
    folder = work_dir(spark, "simhash")
    fingerprints(docs.select(doc_id, text), shingle, text).select(doc_id, "fp").write.mode("overwrite").parquet(folder)
    rows = spark.read.parquet(folder)
    nodes = rows.groupBy("fp").agg(F.min(doc_id).alias("_least"))
    comps = connected_components(links(nodes.select("fp"), radius))
    labelled = nodes.join(comps.withColumnRenamed("node", "fp").hint("merge"), "fp", "left") \
        .select("fp", "_least", F.coalesce("component", "fp").alias("_comp"))
    ids = labelled.groupBy("_comp").agg(F.min("_least").alias("component_id"))
    names = labelled.join(ids.hint("merge"), "_comp").select("fp", "component_id")
    return rows.join(names.hint("merge"), "fp").select(doc_id, "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest doc_id (nulls last; among
    rows that share it, one that a hash of the row names).  All columns pass as they are."""
    row = F.xxhash64(*[f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)])
    names, digest = docs.columns, fresh(docs, "row_digest")
    docs = docs.withColumn(digest, row)
    folder = work_dir(docs.sparkSession, "simhash-rows")
    fingerprints(docs.select("doc_id", F.col(digest).alias("_digest"), "text"), shingle).drop("text").write.mode("overwrite").parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    nodes = rows.groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_digest")).alias("first"),
    )
    comps = connected_components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    firsts = (nodes.join(comps.hint("merge"), "fp", "left").groupBy(F.coalesce("component", "fp").alias("component"))
              .agg(F.min("first").alias("first")).select("first.doc_id", "first._digest"))
    # names of rows that go, and of first rows that are there several times
    named = rows.groupBy("doc_id", "_digest").agg(F.count("*").alias("n"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a[digest] == b["_digest"])
    spark, first = docs.sparkSession, firsts.toDF("_id", "_d")
    met = named.join(first.hint("merge"), named["doc_id"].eqNullSafe(first["_id"]) & (named["_digest"] == first["_d"]), "left")
    met.where("_d IS NULL OR n > 1").select("doc_id", "_digest", F.col("_d").isNotNull().alias("first")).write.parquet(f"{folder}-names")
    odd = spark.read.parquet(f"{folder}-names")
    out = docs.join(sent_if_small(odd), same(docs, odd), "left_anti")
    again = odd.where("first")
    if again.take(1):
        out = out.unionByName(docs.join(sent_if_small(again), same(docs, again), "left_semi").dropDuplicates(["doc_id", digest]))
    return out.select(*names)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
