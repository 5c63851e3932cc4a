"""Snapshot history: point get, bounded scan, retention, diff, top-k
(O09, O10, O11, O12, O31, O48, O49)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def get_by_key(df: DataFrame, key_col: str, value) -> DataFrame:
    """Point lookup; equality reaches the Parquet scan as a pushed filter."""
    return df.where(F.col(key_col) == F.lit(value))


def scan_limited(df: DataFrame, key_col: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows by key (TakeOrderedAndProject: per-partition
    top-n, then a merge of n rows per partition) with the count returned."""
    w = Window.partitionBy()  # over the <= n rows only
    return df.orderBy(key_col).limit(n).withColumn("returned_count", F.count(F.lit(1)).over(w))


def quarantine(df: DataFrame, attempts_col: str, max_receives: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) by receive count."""
    over = F.col(attempts_col) > F.lit(max_receives)
    return df.where(~over | F.col(attempts_col).isNull()), df.where(over)


def retain_recent(df: DataFrame, ts_col: str, as_of: _dt.datetime, days: int = 14) -> DataFrame:
    """Drop rows older than ``days`` before ``as_of``."""
    return df.where(F.col(ts_col) >= F.lit(as_of - _dt.timedelta(days=days)))


def retain_versions(df: DataFrame, key_col: str, ts_col: str, as_of: _dt.datetime, days: int = 30,
                    version_col: str | None = None) -> DataFrame:
    """Drop versions superseded more than ``days`` before ``as_of``.

    A version is superseded when the next version (by ts, then version id)
    appears.  Equivalent set form: keep every version at or after the latest
    version that precedes the cutoff.  That is one partial aggregate per key
    plus a join, instead of a window that would sort a hot key in one task.
    """
    cutoff = F.lit(as_of - _dt.timedelta(days=days))
    order = F.struct(F.col(ts_col).alias("ts"), F.col(version_col or ts_col).alias("v"))
    anchor = (df.where(F.col(ts_col) < cutoff)
                .groupBy(key_col).agg(F.max(order).alias("_anchor")))
    return (df.join(anchor, on=key_col, how="left")
              .where(F.col("_anchor").isNull() | (order >= F.col("_anchor")))
              .drop("_anchor"))


def dedupe_last(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Last row per key by ``order_col`` (dict-build semantics, null keys form
    one group).  ``max_by`` aggregates partially before the shuffle."""
    cols = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_last"))
    return agg.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in cols])


def snapshot_diff(old: DataFrame, new: DataFrame, id_col: str, pos_col: str,
                  by: list[str] | None = None, order_col: str | None = None,
                  payload: list[str] | None = None) -> DataFrame:
    """New / removed / moved items between two snapshots.

    With ``payload`` columns each change also carries its whole row as the
    struct ``item``: the new side's for new and moved items, the old side's
    for removed ones.

    Each side is reduced to its last row per id, then the sides meet in one
    null-safe full outer join.  ``change`` is new - old, NULL if either
    position is null or 0.  ``by`` keys pair many snapshots at once.
    """
    by = by or []
    order_col = order_col or pos_col
    extra = [order_col] if order_col != pos_col else []
    row = [F.struct(*payload).alias("_item")] if payload else []
    o = dedupe_last(old.select(*by, id_col, pos_col, *extra, *row), by + [id_col], order_col)
    n = dedupe_last(new.select(*by, id_col, pos_col, *extra, *row), by + [id_col], order_col)
    o = o.select(*by, F.col(id_col).alias("_oid"), F.col(pos_col).alias("old_position"), F.lit(True).alias("_in_old"),
                 *([F.col("_item").alias("_o_item")] if payload else []))
    n = n.select(*[F.col(b).alias(f"_n_{b}") for b in by], F.col(id_col).alias("_nid"),
                 F.col(pos_col).alias("new_position"), F.lit(True).alias("_in_new"),
                 *([F.col("_item").alias("_n_item")] if payload else []))
    cond = F.col("_oid").eqNullSafe(F.col("_nid"))
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_n_{b}"))
    j = o.join(n, cond, "full_outer")
    kind = (F.when(F.col("_in_old").isNull(), "new")
             .when(F.col("_in_new").isNull(), "removed")
             .when(~F.col("old_position").eqNullSafe(F.col("new_position")), "moved"))
    truthy = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
    change = F.when(truthy("old_position") & truthy("new_position"),
                    F.col("new_position") - F.col("old_position"))
    out = j.select(*[F.coalesce(F.col(b), F.col(f"_n_{b}")).alias(b) for b in by],
                   F.when(F.col("_in_old").isNull(), F.col("_nid")).otherwise(F.col("_oid")).alias(id_col),
                   kind.alias("change_type"), "old_position", "new_position",
                   F.when(kind == "moved", change).alias("change"),
                   *([F.coalesce("_n_item", "_o_item").alias("item")] if payload else []))
    return out.where(F.col("change_type").isNotNull())


def order_changes(diff: DataFrame, id_col: str) -> DataFrame:
    """Biggest moves first (abs(change) desc, null as 0), ties by id."""
    return diff.orderBy(F.coalesce(F.abs("change"), F.lit(0)).desc(), F.col(id_col))


def diff_summary(diff: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of new / removed / moved per snapshot pair."""
    by = by or []
    return diff.groupBy(*by).agg(
        F.count_if(F.col("change_type") == "new").alias("new_count"),
        F.count_if(F.col("change_type") == "removed").alias("removed_count"),
        F.count_if(F.col("change_type") == "moved").alias("moved_count"))


def pair_header(old: DataFrame, new: DataFrame, by: list[str], created_col: str) -> DataFrame:
    """O49 header: time and track count of both snapshots of each pair."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.max(created_col).alias(f"{name}_created_at"), F.count(F.lit(1)).alias(f"{name}_track_count"))
    return side(old, "old").join(side(new, "new"), by, "full_outer")


def top_k(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows per group.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so each map task forwards at most k rows per group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
