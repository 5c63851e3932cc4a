"""Exact positions inside groups without one task per group.

``row_number() over (partition by g order by o)`` sends each whole group to
one task.  When one group may hold a third of all rows, number it in pieces:

1. range-partition on (g, o), so a hot group spans many partitions and every
   partition holds a contiguous range of it; write the rows with their piece
   number to the shared work folder once.  The bounds of a range exchange are
   sampled anew by every execution, so a piece number is only a fact about a
   row once it is stored with it;
2. count rows per (piece, g) - a table of at most pieces x groups;
3. offset of each piece = rows of g in earlier pieces (a window over that
   small table), then number rows inside the piece and add the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.session import work_dir


def ordinal_in_group(df: DataFrame, group: list[str], order: list[str | Column], out: str = "position",
                     base: int = 0, partitions: int | None = None) -> DataFrame:
    """``out`` = ``base`` + 0-based rank of the row in its group by ``order``
    (``order`` should be unique within a group, as a row_number order is).

    Writes ``df`` once to the shared work folder; every row comes back, with
    all its columns, whatever the plan of the caller prunes later."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = work_dir(spark, "ordinal")
    (df.repartitionByRange(n, *[F.col(g) for g in group], *[F.col(o) if isinstance(o, str) else o for o in order])
       .withColumn("_piece", F.spark_partition_id()).write.parquet(folder))
    parted = spark.read.parquet(folder)
    counts = parted.groupBy("_piece", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_piece").alias("_o_piece"), *[F.col(g).alias(f"_o_{g}") for g in group],
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    cond = F.col("_piece") == F.col("_o_piece")
    for g in group:                                  # a NULL group is a group too
        cond = cond & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    local = Window.partitionBy("_piece", *group).orderBy(*order)
    return (parted.join(offsets, cond, "left")
                  .withColumn(out, (F.row_number().over(local) - 1 + F.col("_offset") + base).cast("int"))
                  .drop("_piece", "_offset", "_o_piece", *[f"_o_{g}" for g in group]))
