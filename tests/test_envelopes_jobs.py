"""O05 - O08, O35, O43 - O46 on inline envelopes."""

import datetime as dt
import json

from rowtools import rows
from rankflow.operators import jobs
from rankflow.sources import envelopes

AS_OF = dt.datetime(2024, 2, 1)


def _s3(key="a%2Fb+c.json", es="aws:s3", bucket=True, obj=True):
    r = {"eventSource": es, "eventName": "ObjectCreated:Put", "s3": {}}
    if bucket:
        r["s3"]["bucket"] = {"name": "bk"}
    if obj:
        r["s3"]["object"] = {"key": key}
    return r


def test_decode_notifications(spark):
    recs = [
        (1, "aws:sqs", json.dumps({"Records": [_s3(), _s3(es="aws:sns"), _s3(obj=False), 7]})),
        (2, "aws:sns", json.dumps({"Records": [_s3()]})),
        (3, "aws:sqs", "{bad"),
        (4, "aws:sqs", "[1, 2]"),
        (5, "aws:sqs", json.dumps({"Records": []})),
    ]
    df = spark.createDataFrame(recs, "id int, eventSource string, body string")
    out = envelopes.decode_notifications(df)
    got = rows(out, "id", "event_pos", "outcome", "bucket", "key")
    assert got == [(1, 0, "processed", "bk", "a/b c.json"), (1, 1, "skipped", None, None),
                   (1, 2, "skipped", None, None), (1, 3, "failed", None, None),
                   (2, 0, "skipped", None, None), (3, 0, "skipped", None, None), (4, 0, "failed", None, None)]
    summary = envelopes.outcome_summary(out).first()
    assert (summary.processed, summary.skipped, summary.failed) == (1, 4, 2)


def _msg(track, job="j1"):
    return json.dumps({"Message": json.dumps({"track": track, "job_id": job, "source_file": "f"})})


def test_decode_and_classify(spark):
    bodies = [
        (1, _msg({"title": " T ", "artist": "A", "track_id": "k"})),
        (2, _msg({"title": "T", "artist": "B"})),
        (3, _msg({"title": "", "artist": "A"})),
        (4, _msg({})),                                   # empty track -> no row
        (5, json.dumps({"Type": "x"})),                  # no Message -> no row
        (6, "nope"),                                     # undecodable -> error
        (7, _msg({"title": None, "artist": "A"})),       # explicit null -> error
        (8, _msg({"title": "T", "artist": "A"}, job=None)),
    ]
    df = spark.createDataFrame(bodies, "id int, body string")
    dec = envelopes.decode_messages(df)
    hits = {1: "success", 2: "not_found", 8: "success"}
    from pyspark.sql import functions as F
    dec = dec.withColumn("lookup_status", F.when(F.col("id") == 1, "success").when(F.col("id") == 2, "not_found")
                         .when(F.col("id") == 8, "success"))
    out = jobs.classify_outcomes(dec)
    got = rows(out, "id", "status", "job_id", "title")
    assert got == [(1, "success", "j1", "T"), (2, "not_found", "j1", "T"), (3, "failed", "j1", ""),
                   (6, "error", None, None), (7, "error", "j1", None), (8, "success", None, "T")]
    assert hits
    prog = rows(jobs.job_progress(out), "job_id", "processed_count")
    assert prog == [("j1", 2)]                           # failed/error do not count; null job ignored
    kept, dead = jobs.split_dead_letters(out, AS_OF)
    assert rows(dead, "id", "failure_reason") == [(2, "No YouTube results found for: T - B")]


def test_jobs_and_completion(spark):
    new = spark.createDataFrame([("f1",), ("f1",), ("f2",)], "source_file string")
    j = jobs.create_jobs(new, "source_file", AS_OF)
    assert rows(j, "source_file", "expected_count", "status") == [("f1", 2, "RUNNING"), ("f2", 1, "RUNNING")]
    extra = spark.createDataFrame([("z", "", 0, 0, "RUNNING", AS_OF, AS_OF, AS_OF)], j.schema)
    j = j.unionByName(extra)
    ids = {r.source_file: r.job_id for r in j.collect()}
    prog = spark.createDataFrame([(ids["f1"], 3), (ids["f2"], 0), ("z", 0)], "job_id string, processed_count long")
    done = jobs.completed_jobs(j, prog, AS_OF, bucket="b")
    got = rows(done, "source_file", "processed_count", "s3_key", "status")
    assert got == [("f1", 3, "f1", "completed")]        # over-counted completes once; expected 0 never


def test_build_messages(spark):
    df = spark.createDataFrame([("x" * 120, "A", "k", "f", "j"), ("T", "A", None, "f", None)],
                               "title string, artist string, track_id string, src string, job string")
    out = envelopes.build_messages(df, "src", "job", AS_OF, track_cols=["title", "artist", "track_id"]).collect()
    assert len(out[0].subject) == 100 and out[1].attributes["job_id"] == "unknown"
    assert out[1].attributes["track_id"] == "unknown"
    msg = json.loads(out[0].message)
    assert msg["action"] == "process_new_track" and msg["timestamp"] == AS_OF.isoformat()
