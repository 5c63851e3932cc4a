"""Layouts of keyed tables that are looked up often.

* ``write_point_table``: sorted by key with a bloom filter per row group, so a
  point get (``operators.history.get_by_key``) reads the row groups that may
  hold the key, also for hashed keys that lie everywhere between min and max.
* ``write_bucketed`` / ``open_bucketed``: dealt by hash of the key once, so a
  join on the key shuffles the other side only.  A stable huge table is then
  never moved again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_point_table(df: DataFrame, path: str, key: str, files: int, keys_per_file: int = 1_000_000,
                      mode: str = "overwrite", row_group_bytes: int | None = None) -> None:
    """``df`` in ``files`` key ranges, sorted, with a bloom filter on ``key`` sized for ``keys_per_file`` keys.

    Appended versions overlap in their ranges; their filters still tell which of them may hold a key.  Null keys are
    kept (a point get never finds them)."""
    writer = (df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode(mode)
              .option(f"parquet.bloom.filter.enabled#{key}", "true")
              .option(f"parquet.bloom.filter.expected.ndv#{key}", str(keys_per_file)))
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` as table ``name`` at ``path`` in ``buckets`` files by hash of ``key``, sorted in each, and the table."""
    (df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key)
       .saveAsTable(name))
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """A table of ``write_bucketed`` in another session: the files hold no bucket layout, the catalog does."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({fields}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)
