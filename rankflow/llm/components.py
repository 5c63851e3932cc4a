"""Connected components of an edge table by alternating star contractions, in Spark.

Every round writes its edges to the shared work folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.session import work_dir


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every node links its larger neighbours to the smallest of itself and its neighbours.  Small: it links
    itself and its smaller neighbours to the smallest of them.  (Merge joins: a broadcast of the nodes would pass the
    driver.)"""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        out = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        out = (down.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
               .union(least.select("a", F.col("least").alias("b"))))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b): the component is its smallest node.

    Self-loops and repeated edges are harmless; no edges give an empty result.  Raises if it doesn't settle within
    ``rounds`` rounds (the contraction needs about the square of the logarithm of the longest path)."""
    folder = work_dir(edges.sparkSession, "components")
    now = _written(edges.where("a <> b").distinct(), f"{folder}/edges-0")
    seen = None
    for k in range(1, rounds + 1):
        now = _written(_star(_star(now, large=True), large=False), f"{folder}/edges-{k}")
        # the edges are final when a round leaves them as they were
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
