"""Access to the driver tables (``<sf_dir>/<name>.parquet``)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed instant used instead of wall-clock "now" so every run is reproducible.
AS_OF = _dt.datetime(2024, 2, 1, 0, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


#: rows of a table that one task of CPU-heavy per-row work gets
TASK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table; ``spread`` for CPU-heavy per-row work (see session.spread), in tasks of at most some
    ``TASK_ROWS`` rows.  The rows are counted from the files' footers."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread:
        from rankflow.session import spread as _spread
        return _spread(df, -(-df.count() // TASK_ROWS))
    return df


def ts_strings(df: DataFrame) -> DataFrame:
    """Timestamps rendered as 'yyyy-MM-dd HH:mm:ss' strings (engine-neutral)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("timestamp", "timestamp_ntz"):
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
