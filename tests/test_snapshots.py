"""Snapshot objects: one per document, read whole."""

import datetime as dt
import json

from pyspark.sql import functions as F

from rowtools import rows
from rankflow.operators import records
from rankflow.sources import envelopes, snapshots


def test_indented_objects_are_read_whole(spark, tmp_path):
    for i in range(3):
        folder = tmp_path / f"2024/0{i + 1}"
        folder.mkdir(parents=True)
        doc = {"name": f"c{i}", "tracks": [{"title": f"t{i}{j}", "artist": "a", "rank": j + 1} for j in range(4)]}
        (folder / f"top {i}+%.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "2024/01/broken.json").write_text("{")
    docs = snapshots.read_snapshots(spark, str(tmp_path), "*.json")
    assert docs.count() == 4 and docs.where("doc is null").count() == 1
    found = records.normalize_records(records.locate_records(docs.drop("doc"), "json"))
    assert rows(found, "title") == sorted((f"t{i}{j}",) for i in range(3) for j in range(4))
    named = [r.path for r in docs.where("path like '%top%'").select("path").collect()]
    assert snapshots.read_objects(spark, named).count() == 3 and snapshots.read_objects(spark, []).count() == 0


def test_round_trip_of_several_snapshots_a_day(spark, tmp_path):
    at = [dt.datetime(2024, 7, 1, 6), dt.datetime(2024, 7, 1, 18), dt.datetime(2024, 7, 8, 6)]
    df = spark.createDataFrame([(f"s{i}", [(f"t{i}", "a"), (f"u{i}", "a")], t) for i, t in enumerate(at)],
                               "name string, tracks array<struct<title: string, artist: string>>, created_at timestamp").coalesce(1)
    snapshots.write_snapshots(df, str(tmp_path / "out"), "created_at", source="chart")
    docs = snapshots.read_snapshots(spark, str(tmp_path / "out"))
    assert docs.count() == 3
    ids = docs.select(F.get_json_object("json", "$.snapshot_id").alias("i"), F.get_json_object("json", "$.playlist_type").alias("k"),
                      F.get_json_object("json", "$.scraped_at").alias("at"))
    assert rows(ids, "i", "k", "at") == [("chart-20240701-060000", "chart", "2024-07-01T06:00:00"),
                                         ("chart-20240701-180000", "chart", "2024-07-01T18:00:00"),
                                         ("chart-20240708-060000", "chart", "2024-07-08T06:00:00")]
    found = records.normalize_records(records.locate_records(docs.drop("doc"), "json"))
    assert found.count() == 6
    assert snapshots.list_snapshot_files(spark, str(tmp_path / "out"), "2024/07/01").count() == 2


def test_keys_with_odd_escapes_are_kept(spark):
    bodies = [json.dumps({"Records": [{"eventSource": "aws:s3", "s3": {"bucket": {"name": "b"}, "object": {"key": k}}}]})
              for k in ("charts/100%.json", "a+b%2Bc%zz.json", "%C3%A9%")]
    df = spark.createDataFrame([("aws:sqs", b) for b in bodies], "eventSource string, body string")
    assert rows(envelopes.decode_notifications(df), "key", "outcome") == [
        ("a b+c%zz.json", "processed"), ("charts/100%.json", "processed"), ("é%", "processed")]
