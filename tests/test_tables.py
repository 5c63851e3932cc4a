"""Layouts of keyed tables, and the listing with its manifest."""

import contextlib
import datetime as dt
import hashlib
import io

from pyspark.sql import functions as F

from rowtools import rows
from rankflow.operators import history, joins
from rankflow.sources import snapshots, tables


def _scanned(df) -> int:
    """Rows that the scan gave on, from the metrics of the plan that ran."""
    assert df._jdf.collectToPython() is not None
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_point_get_of_a_hashed_key_skips_row_groups(spark, tmp_path):
    key = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    df = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("track_id"), F.repeat(F.lit("x"), 200).alias("pad"), "id")
    path = str(tmp_path / "t")
    for part in range(4):  # four versions whose key ranges overlap
        tables.write_point_table(df.where(F.col("id") % 4 == part), path, "track_id", files=2, keys_per_file=1000, mode="append")
    table = spark.read.parquet(path)
    found = history.get_by_key(table, "track_id", key(17))
    assert _scanned(found) <= 600 and [r.id for r in found.collect()] == [17]
    # the bounds of every version's files enclose a key that none has; the filters rule it out
    assert sum(_scanned(history.get_by_key(table, "track_id", key(f"no {i}"))) == 0 for i in range(20)) >= 15
    plain = str(tmp_path / "p")
    df.repartition(8, "id").write.parquet(plain)
    assert _scanned(history.get_by_key(spark.read.parquet(plain), "track_id", key("no 1"))) == 4000


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_bucketed_table_is_not_shuffled(spark, tmp_path):
    known = spark.range(300).select(F.concat(F.lit("k"), F.col("id")).alias("track_id"), F.lit("v").alias("youtube_video_id"),
                                    F.lit(None).cast("string").alias("youtube_url"))
    batch = spark.createDataFrame([("t", "a", f"k{i}") for i in range(290, 310)], "title string, artist string, track_id string")
    bucketed = tables.write_bucketed(known, "known_bucketed", str(tmp_path / "b"), "track_id", 8)
    for op in (joins.new_records, joins.enrich):
        a, b = op(batch, known), op(batch, bucketed)
        assert _plan(a).count("Exchange hashpartitioning") == 2 and _plan(b).count("Exchange hashpartitioning") == 1
        assert rows(a) == rows(b)
    keyed = spark.createDataFrame([("t", "a"), ("u", "b")], "title string, artist string")
    from rankflow.functions.text import content_key
    tracks = keyed.where("title = 't'").select(content_key("artist", "title").alias("track_id"))
    dealt = tables.write_bucketed(tracks, "tracks_bucketed", str(tmp_path / "c"), "track_id", 8)
    a, b = joins.lookup_by_content(keyed, tracks), joins.lookup_by_content(keyed, dealt)
    assert _plan(b).count("Exchange hashpartitioning") == 1 < _plan(a).count("Exchange hashpartitioning")
    assert rows(a, "title", "found") == rows(b, "title", "found") == [("t", True), ("u", False)]
    # another session knows the layout from the catalog entry alone
    spark.sql("DROP TABLE known_bucketed")
    again = tables.open_bucketed(spark, "known_again", str(tmp_path / "b"), known.schema, "track_id", 8)
    assert _plan(joins.new_records(batch, again)).count("Exchange hashpartitioning") == 1 and again.count() == 300


def test_listing_has_metadata_size_and_url(spark, tmp_path):
    path = str(tmp_path / "out")
    at = [dt.datetime(2024, 7, 1, 6), dt.datetime(2024, 7, 1, 18), dt.datetime(2024, 8, 8, 6)]
    df = spark.createDataFrame([(f"s{i}", "top-100" if i else "top-10", t) for i, t in enumerate(at)], "name string, kind string, created_at timestamp")
    snapshots.write_snapshots(df, path, "created_at", source="scraper", playlist_type=F.col("kind"))
    found = snapshots.list_snapshot_files(spark, path).collect()
    assert len(found) == 3 and [r.last_modified for r in found] == sorted((r.last_modified for r in found), reverse=True)
    about = {r.key.rsplit("/", 1)[0]: r for r in found}
    first = about["year=2024/month=07/day=01/snapshot=scraper-20240701-060000"]
    assert first.metadata == {"source": "scraper", "playlist-type": "top-10", "scraped-at": "2024-07-01T06:00:00"}
    assert first.url.endswith(f"{path}/{first.key}") and first.size == len(open(f"{path}/{first.key}", "rb").read())
    assert {r.metadata["playlist-type"] for r in snapshots.list_snapshot_files(spark, path, "2024/07").collect()} == {"top-10", "top-100"}
    assert snapshots.list_snapshot_files(spark, path, "2024/08/08/").count() == 1
    # objects that another writer put there are listed too, without metadata
    (tmp_path / "out/year=2024/month=08/extra.json").write_text("{}")
    extra = [r for r in snapshots.list_snapshot_files(spark, path, "2024/08").collect() if r.key.endswith("extra.json")]
    assert [r.metadata for r in extra] == [{}]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.json").write_text("{}")
    assert [r.key for r in snapshots.list_snapshot_files(spark, str(tmp_path / "plain")).collect()] == ["a.json"]
