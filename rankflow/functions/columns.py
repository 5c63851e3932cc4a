"""Evaluate derived columns exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, cols: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add ``cols`` through a one-row generator.

    Predicates on generator output are not pushed below the generator, so a
    later ``where`` on these columns runs on the computed values instead of
    being rewritten (with every nested JSON parse re-inlined) into the scan
    filter.  The generator input is an expression, not a column, so no extra
    filter is inferred from it either.
    """
    keep = df.columns if keep is None else keep
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` with ``condition`` evaluated once, in place."""
    return with_columns_once(df, {"_keep": condition}).where(F.col("_keep")).drop("_keep")
