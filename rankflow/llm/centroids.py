"""Centroid clustering (Lloyd's rounds on whole numbers) with norm-of-sum bounds.

Every vector keeps its distance to its own centroid and, for each group of about ten centroids, the distance to the
nearest of the others in it, each with the round in which it was last evaluated.  All centroids of all rounds are kept
(rounds x k x dimensions numbers, whatever the table), so a stored bound is loosened by the norm of the centroid's
total displacement since that round, which is never more than the sum of its moves round by round.  Where the bounds
leave a doubt, the group is scanned again with exact whole-number distances, so the result is Lloyd's.

A round writes its state, row by row, to the shared work folder; only rows that changed their cluster enter the sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, ByteType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from rankflow.session import spread, work_dir

GROUP = 10
#: scaled components are held within +-2**27, so that a squared distance of 64 of them fits a long
BOUND = 1 << 27
#: up to this size of component, distances by floating-point matrix products are exact whole numbers
_EXACT = 1 << 22
#: rows that a task works on at a time
ROWS = 8192
_ABOVE = 1 + 1e-9


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(
        x.cast("double") * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int"))


def usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c`` (int64)."""
    if not len(x) or max(np.abs(x).max(), np.abs(c).max()) < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def own_squared(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - c[cluster]) ** 2).sum(1)


class Bounds:
    """One round of assignment for the rows of a batch.

    ``history`` holds the centroids of every round so far; the last ones are the ones to assign to.  Bounds are
    distances (roots), widened by more than their rounding."""

    def __init__(self, history: list[np.ndarray]):
        self.now, self.c = len(history) - 1, history[-1]
        self.group = np.arange(len(self.c)) // GROUP
        self.groups = int(self.group[-1]) + 1
        moved = np.stack([np.sqrt(((self.c - old).astype(np.float64) ** 2).sum(1)) for old in history]) * _ABOVE
        self.moved = moved  # by round of evaluation and centroid
        self.group_moved = np.stack([moved[:, self.group == g].max(1) for g in range(self.groups)], axis=1)
        self.scanned = 0

    def first(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Everything is scanned: (cluster, upper, its round, lower by group, their rounds)."""
        n = len(x)
        return self.step(x, np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n, np.int8),
                         np.full((n, self.groups), -np.inf), np.zeros((n, self.groups), np.int8))

    def step(self, x, cluster, upper, upper_at, lower, lower_at) -> tuple[np.ndarray, ...]:
        cluster, upper, upper_at, lower, lower_at = (a.copy() for a in (cluster, upper, upper_at, lower, lower_at))
        loose_up = upper + self.moved[upper_at, cluster]
        loose_low = lower - self.group_moved[lower_at, np.arange(self.groups)[None]]
        doubt = np.flatnonzero((loose_low <= loose_up[:, None]).any(1))
        if not len(doubt):
            return cluster, upper, upper_at, lower, lower_at
        before = cluster[doubt]
        own = own_squared(x[doubt], self.c, before)
        upper[doubt], upper_at[doubt] = np.sqrt(own) * _ABOVE, self.now
        failing = loose_low[doubt] <= upper[doubt][:, None]
        best, winner = own.copy(), before.astype(np.int64)
        nearest: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in range(self.groups):
            rows = np.flatnonzero(failing[:, g])
            if not len(rows):
                continue
            members = np.flatnonzero(self.group == g)
            d = squared(x[doubt[rows]], self.c[members])
            self.scanned += d.size
            nearest[g] = rows, d
            k = d.argmin(1)  # the first of equals: the smaller number
            least, number = d[np.arange(len(rows)), k], members[k]
            closer = (least < best[rows]) | ((least == best[rows]) & (number < winner[rows]))
            best[rows[closer]], winner[rows[closer]] = least[closer], number[closer]
        for g, (rows, d) in nearest.items():
            own_column = winner[rows] - g * GROUP
            inside = np.flatnonzero(self.group[winner[rows]] == g)
            d = d.astype(np.float64)
            d[inside, own_column[inside]] = np.inf
            lower[doubt[rows], g], lower_at[doubt[rows], g] = np.sqrt(d.min(1)) / _ABOVE, self.now
        # a centroid that lost a row is one of the others of its group now
        left = np.flatnonzero((winner != before))
        g = self.group[before[left]]
        unscanned = ~failing[left, g]
        rows, g = left[unscanned], g[unscanned]
        lower[doubt[rows], g] = np.minimum(loose_low[doubt[rows], g], np.sqrt(own[rows]) / _ABOVE)
        lower_at[doubt[rows], g] = self.now
        cluster[doubt] = winner
        upper[doubt] = np.sqrt(best) * _ABOVE
        return cluster, upper, upper_at, lower, lower_at


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.size else np.zeros(len(m) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(m.ravel(), kind))


def _assigned(rows: DataFrame, name: str, dims: int, history: list[np.ndarray], last: bool) -> DataFrame:
    """The state after one more assignment; ``rows`` has the state before it, or no state at first."""
    known = "cluster" in rows.columns
    schema = StructType([rows.schema[name], rows.schema["comps"], StructField("cluster", IntegerType()),
                         StructField("before", IntegerType()), StructField("upper", DoubleType()),
                         StructField("upper_at", ByteType()), StructField("lower", ArrayType(DoubleType())),
                         StructField("lower_at", ArrayType(ByteType())), StructField("distance", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x = _matrix(batch.column("comps"), dims, np.int64)
                if known:
                    before = batch.column("cluster").to_numpy()
                    state = bounds.step(x, before, batch.column("upper").to_numpy(), batch.column("upper_at").to_numpy(),
                                        _matrix(batch.column("lower"), bounds.groups, np.float64),
                                        _matrix(batch.column("lower_at"), bounds.groups, np.int8))
                else:
                    before, state = np.full(len(x), -1, np.int32), bounds.first(x)
                cluster, upper, upper_at, lower, lower_at = state
                distance = own_squared(x, bounds.c, cluster) if last else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(name), batch.column("comps"), pa.array(cluster, pa.int32()), pa.array(before, pa.int32()),
                     pa.array(upper), pa.array(upper_at, pa.int8()), _lists(lower, pa.float64()),
                     _lists(lower_at, pa.int8()), pa.array(distance)], names=schema.names)

    columns = [name, "comps"] + (["cluster", "upper", "upper_at", "lower", "lower_at"] if known else [])
    return rows.select(*columns).mapInArrow(run, schema)


def _sum_changes(state: DataFrame, dims: int, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add to the sums and counts of every cluster what came to it and take away what left it.  A task sends at most
    k x (dims + 1) numbers, Spark adds them up, and as many come to the driver."""
    k = len(counts)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column("comps"), dims, np.int64)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            for column, sign in (("cluster", 1), ("before", -1)):
                at = batch.column(column).to_numpy()
                order = np.argsort(at, kind="stable")[(at < 0).sum():]
                if len(order):
                    there, first = np.unique(at[order], return_index=True)
                    total[there] += sign * np.add.reduceat(x[order], first, axis=0)
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)),
                                          pa.array(total[cluster, place])], names=["cluster", "place", "total"])

    changed = state.where("cluster <> before").select("comps", "cluster", "before")
    found = (changed.mapInArrow(partial, "cluster int, place int, total long").groupBy("cluster", "place")
             .agg(F.sum("total").alias("total")).toArrow())
    add = np.zeros((k, dims + 1), np.int64)
    add[found["cluster"].to_numpy(), found["place"].to_numpy()] = found["total"].to_numpy()
    sums += add[:, :dims]
    counts += add[:, dims]


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2",
             vector: str = "embedding", vec_id: str = "vec_id") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every usable vector, final centroids).

    Vectors with exactly ``dims`` components, none null or non-finite, are kept; a component becomes
    floor(``scale`` * x), held within +-2**27.  Centroids start as the ``k`` kept rows with the smallest sha256 of
    ``salt``:id (ids that are null come last, equal ids by their components).  Each of ``rounds`` rounds assigns every
    vector to the nearest centroid (ties: the smaller number) and moves every non-empty centroid to the floor of its
    mean; then vectors are assigned once more.  Fewer than k kept rows give as many centroids; none give no rows.
    Repeated rows count each for itself; other columns are not read."""
    spark = vectors.sparkSession
    folder = work_dir(spark, "centroids")
    kept = vectors.where(usable(F.col(vector), dims)).select(
        F.col(vec_id), whole_numbers(F.col(vector), scale).alias("comps"))
    kept = kept.toDF("_id", "comps")
    spread(kept).write.parquet(f"{folder}/vectors")
    state = spark.read.parquet(f"{folder}/vectors")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("_id").cast("string")), 256)
    first = state.select(digest.alias("digest"), "comps").orderBy(F.col("digest").asc_nulls_last(), "comps").limit(k).collect()
    history = [np.array([r["comps"] for r in first], np.int64).reshape(len(first), dims)]
    if first:
        sums, counts = np.zeros((len(first), dims), np.int64), np.zeros(len(first), np.int64)
        for now in range(rounds + 1):
            _assigned(state, "_id", dims, history, last=now == rounds).write.parquet(f"{folder}/round-{now}")
            state = spark.read.parquet(f"{folder}/round-{now}")
            if now < rounds:
                _sum_changes(state, dims, sums, counts)
                moved = history[-1].copy()
                some = counts > 0
                moved[some] = sums[some] // counts[some][:, None]
                history.append(moved)
    else:
        state = state.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long"))
    return state.select(F.col("_id").alias(vec_id), "cluster", "distance"), history[-1]


def clustering(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector (see ``clusters``);
    of each cluster its share is one row, and so many rows (at most k) are joined to the vectors."""
    assigned, centroids = clusters(vectors, **how)
    spark = vectors.sparkSession
    total = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    most = (1 << 63) - 1
    everything = min(most, sum(total.values()))
    about = [(j, min(most, total[j]), everything, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
             for j, c in enumerate(centroids) if j in total]
    schema = StructType([StructField("cluster", IntegerType()), StructField("cluster_inertia", LongType()),
                         StructField("inertia", LongType()), StructField("centroid_sha256", StringType())])
    names = [c for c in assigned.columns if c not in ("cluster", "distance")]
    return assigned.join(F.broadcast(spark.createDataFrame(about, schema)), "cluster").select(
        *names, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
