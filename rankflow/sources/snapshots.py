"""Snapshot documents and keyed-table versions on shared storage
(O01, O02, O03, O04).

Snapshots are written partitioned by ``year/month/day`` so a date-prefix
listing is partition pruning, and listed with the ``binaryFile`` source which
reads only file metadata when ``content`` is not selected.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_FORMAT = "yyyyMMdd-HHmmss"


def _plain_path():
    """The path of the object a row came from, without the escapes of a URI."""
    return F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def parse_snapshots(df: DataFrame, text_col: str = "json") -> DataFrame:
    """O01 (parse half): bad JSON becomes a NULL document, never an error."""
    return df.withColumn("doc", F.try_parse_json(F.col(text_col)))


def read_snapshots(spark: SparkSession, path: str, glob: str = "*.json*") -> DataFrame:
    """Whole-object UTF-8 reads -> (path, json, doc).

    ``wholetext`` keeps one row per object; every object is its own split, so
    the read spreads over all executors.  Unreadable JSON gives ``doc`` NULL.
    """
    raw = (spark.read.option("recursiveFileLookup", "true")
           .option("pathGlobFilter", glob).text(path, wholetext=True))
    return parse_snapshots(raw.select(_plain_path().alias("path"), F.col("value").alias("json")))


def read_objects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """O01 for named objects: (path, json, doc) of those that exist."""
    if not paths:
        return parse_snapshots(spark.createDataFrame([], "path string, json string"))
    raw = spark.read.option("ignoreMissingFiles", "true").text(paths, wholetext=True)
    return parse_snapshots(raw.select(_plain_path().alias("path"), F.col("value").alias("json")))


def write_snapshots(df: DataFrame, path: str, ts_col: str, source: str = "snapshots",
                    mode: str = "append", fmt: str = "json", playlist_type: str | Column | None = None) -> None:
    """Dated snapshot documents under ``year=/month=/day=/snapshot=`` with
    their metadata (source, snapshot id, type, time) as columns; ``fmt`` is
    ``json`` (one object per document: ``maxRecordsPerFile`` is one) or
    ``parquet``.  ``playlist_type`` (by default the source) may be a column.

    The metadata also goes to a manifest under ``_manifest`` (same date folders),
    which a listing joins without opening an object."""
    kind = F.lit(source) if playlist_type is None else F.lit(playlist_type) if isinstance(playlist_type, str) else playlist_type
    ts = F.col(ts_col).cast("timestamp")
    out = (df.withColumn("snapshot_id", F.concat(F.lit(f"{source}-"), F.date_format(ts, SNAPSHOT_FORMAT)))
             .withColumn("playlist_type", kind)
             .withColumn("scraped_at", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
             .withColumn("year", F.date_format(ts, "yyyy"))
             .withColumn("month", F.date_format(ts, "MM"))
             .withColumn("day", F.date_format(ts, "dd"))
             .withColumn("snapshot", F.col("snapshot_id")))
    folders = ["year", "month", "day"]
    if fmt == "json":
        out.write.mode(mode).partitionBy(*folders, "snapshot").option("maxRecordsPerFile", 1).json(path)
    else:
        out.write.mode(mode).partitionBy(*folders, "snapshot").format(fmt).save(path)
    about = out.groupBy(*folders, "snapshot_id").agg(
        F.min("playlist_type").alias("playlist_type"), F.min("scraped_at").alias("scraped_at"), F.count(F.lit(1)).alias("documents"))
    about.withColumn("source", F.lit(source)).write.mode(mode).partitionBy(*folders).parquet(f"{path.rstrip('/')}/{MANIFEST}")


PARTITION_LEVELS = ["year", "month", "day"]
MANIFEST = "_manifest"


def date_prefix_path(date_prefix: str | None) -> str:
    """``YYYY[/MM[/DD]]`` -> ``year=YYYY[/month=MM[/day=DD]]`` (trailing / stripped)."""
    if not date_prefix:
        return ""
    parts = [p for p in date_prefix.rstrip("/").split("/") if p]
    return "/".join(f"{lvl}={p}" for lvl, p in zip(PARTITION_LEVELS, parts))


def list_snapshot_files(spark: SparkSession, path: str, date_prefix: str | None = None,
                        glob: str = "*.json*") -> DataFrame:
    """O03 over storage: objects under ``path[/date_prefix]`` newest first, with
    ``key`` (below ``path``), ``size``, ``last_modified``, ``metadata`` (a map,
    empty for objects that no manifest names) and ``url``.

    A prefix such as ``2024/07`` maps to the partition folder
    ``year=2024/month=07``, so only that folder is listed; all listing pages
    are read.  Neither objects nor their metadata are fetched one by one.
    """
    base, prefix = path.rstrip("/"), date_prefix_path(date_prefix)
    root = f"{base}/{prefix}" if prefix else base
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(root)
             .select(F.col("path").alias("url"), F.col("length").alias("size"),
                     F.col("modificationTime").alias("last_modified")))
    # the folders after the root's own name, whatever scheme the listing shows
    below = F.regexp_extract("url", f"/{re.escape(base.split('/')[-1])}/((?:year=|[^/]+$).*)$", 1)
    files = files.withColumn("key", below).withColumn("_id", F.regexp_extract("url", r"/snapshot=([^/]+)/[^/]+$", 1))
    manifest = f"{base}/{MANIFEST}" + (f"/{prefix}" if prefix else "")
    if _exists(spark, manifest):
        about = (spark.read.option("recursiveFileLookup", "true").parquet(manifest)
                 .groupBy(F.col("snapshot_id").alias("_id")).agg(F.max(F.struct("scraped_at", "playlist_type", "source")).alias("_m")))
        files = files.join(about, "_id", "left")
    else:
        files = files.withColumn("_m", F.lit(None).cast("struct<scraped_at:string,playlist_type:string,source:string>"))
    metadata = F.when(F.col("_m").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(
        F.lit("source"), F.col("_m.source"), F.lit("playlist-type"), F.col("_m.playlist_type"),
        F.lit("scraped-at"), F.col("_m.scraped_at")))
    return files.select("key", "size", "last_modified", metadata.alias("metadata"), "url").orderBy(
        F.col("last_modified").desc(), F.col("key"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_snapshots(listing: DataFrame, key_col: str = "key", ts_col: str = "last_modified",
                   date_prefix: str | None = None, root: str = "") -> DataFrame:
    """O03 over a listing table: keys under ``root + prefix/`` ending in
    ``.json``, newest first.  The prefix has its trailing ``/`` stripped and
    re-added, as the reference does."""
    prefix = root
    if date_prefix:
        prefix = f"{root}{date_prefix.rstrip('/')}/"
    k = F.col(key_col)
    return listing.where(k.startswith(prefix) & k.endswith(".json")).orderBy(F.col(ts_col).desc(), k)


def latest_snapshot(listing: DataFrame, ts_col: str = "last_modified", key_col: str = "key") -> DataFrame:
    """The newest object (TakeOrdered of one row)."""
    return listing.orderBy(F.col(ts_col).desc(), F.col(key_col).desc()).limit(1)
