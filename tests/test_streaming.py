"""O46 and O50 - O53 across several micro-batches equal the batch operators."""

import datetime as dt
import json
import os
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rowtools import rows
from rankflow.operators import jobs, merge
from rankflow.sources import envelopes
from rankflow.streaming import (
    COMPLETION_SCHEMA, PROGRESS_SCHEMA, OutcomeCounts, batches_of, completion_stream, current_table, dead_letter_stream,
    file_stream, ingest_stream, job_table, job_totals, lookup_stream, notification_stream, playlist_stream, progress_stream,
    read_named, stored_objects,
)

AS_OF = dt.datetime(2024, 2, 1)
SCHEMA = "event_id long, ts timestamp, job_id string, title string, artist string, found boolean"


def _messages(spark, batch_rows):
    df = spark.createDataFrame(batch_rows, SCHEMA)
    body = F.to_json(F.struct(F.to_json(F.struct(
        F.struct("title", "artist", F.col("event_id").cast("string").alias("track_id")).alias("track"),
        F.col("job_id"))).alias("Message")))
    return df.select("event_id", "ts", "found", body.alias("body"))


def _classify(df):
    dec = envelopes.decode_messages(df)
    dec = dec.withColumn("lookup_status", F.when(F.col("found"), "success").otherwise("not_found"))
    return (jobs.classify_outcomes(dec)
            .withColumn("track_id", F.concat(F.col("title"), F.lit("|"), F.col("artist")))
            .withColumn("youtube_video_id", F.concat(F.lit("yt-"), F.col("event_id").cast("string")))
            .withColumn("youtube_url", F.lit("u")))


def _write_batches(spark, folder, batches):
    """One flat Parquet file per micro-batch (a tiny fixture)."""
    for i, b in enumerate(batches):
        pq.write_table(_messages(spark, b).toArrow(), os.path.join(folder, f"part{i}.parquet"), coerce_timestamps="us")


TRACKS = ("track_id string, title string, artist string, youtube_video_id string, youtube_url string, source string, "
          "created_at timestamp, updated_at timestamp")
JOBS = "job_id string, source_file string, expected_count long, created_at timestamp"


def _done(q):
    q.awaitTermination()
    assert q.exception() is None
    return q


def _put_rows(spark, folder, name, rows_, schema):
    os.makedirs(folder, exist_ok=True)
    pq.write_table(spark.createDataFrame(rows_, schema).toArrow(), os.path.join(folder, f"{name}.parquet"), coerce_timestamps="us")


class Pipe:
    """Messages in files, one a micro-batch, through the chained streams; ``run`` goes on where it stopped."""

    def __init__(self, spark, jobs_rows=()):
        self.spark, self.root = spark, tempfile.mkdtemp(prefix="rankflow-stream-")
        self.src, self.jobs = os.path.join(self.root, "in"), os.path.join(self.root, "jobs")
        os.makedirs(self.src)
        os.makedirs(self.jobs)
        if jobs_rows:
            _put_rows(spark, self.jobs, "j0", list(jobs_rows), JOBS)
        self.n = 0

    def arrive(self, *batches):
        for b in batches:
            pq.write_table(_messages(self.spark, b).toArrow(), os.path.join(self.src, f"part{self.n:03}.parquet"), coerce_timestamps="us")
            self.n += 1

    def outcomes(self):
        schema = _messages(self.spark, [(1, AS_OF, "j", "t", "a", True)]).schema
        return _classify(file_stream(self.spark, self.src, schema, glob="*.parquet", max_files=1))

    def at(self, name):
        return os.path.join(self.root, name)

    def progress(self):
        jobs_in = file_stream(self.spark, self.jobs, JOBS, glob="*.parquet", max_files=None)
        q = _done(progress_stream(self.outcomes(), jobs_in, self.at("progress"), self.at("ck-p"), "event_id"))
        _done(completion_stream(batches_of(self.spark, self.at("progress"), PROGRESS_SCHEMA, 1), self.at("completions"),
                                self.at("ck-c"), AS_OF, bucket="charts"))
        return q

    def totals(self):
        return rows(job_totals(self.spark, self.at("progress")), "job_id", "processed_count")

    def completed(self):
        return rows(self.spark.read.parquet(self.at("completions")), "job_id")


def test_multi_batch_lookup_and_progress(spark):
    t0 = dt.datetime(2024, 1, 1)
    b1 = [(1, t0, "j1", "a", "x", True), (2, t0, "j1", "b", "x", False), (3, t0, "j2", "c", "y", True)]
    b2 = [(2, t0, "j1", "b", "x", False),            # redelivery of message 2
          (4, t0, "j2", "c", "y", True), (5, t0, "j2", "d", "y", True)]
    b3 = [(6, t0, "j1", "a", "x", True), (7, t0, "j3", "e", "z", False)]
    pipe = Pipe(spark, [("j1", "f1", 3, AS_OF), ("j2", "f2", 3, AS_OF), ("j3", "f3", 1, AS_OF)])
    pipe.arrive(b1, b2, b3)
    base_rows = [("a|x", "a", "x", None, None, "beatport", AS_OF, AS_OF), ("d|y", "d", "y", "old", None, "beatport", AS_OF, AS_OF),
                 ("q|q", "q", "q", None, None, "beatport", AS_OF, AS_OF)]
    _put_rows(spark, pipe.at("base"), "b0", base_rows, TRACKS)
    base = file_stream(spark, pipe.at("base"), TRACKS, glob="*.parquet", max_files=None)
    q = _done(lookup_stream(pipe.outcomes(), base, pipe.at("tracks"), pipe.at("ck1"), AS_OF, order_col="event_id"))
    assert len(q.recentProgress) >= 3
    all_rows = _classify(_messages(spark, b1 + b2 + b3)).dropDuplicates(["event_id"])
    expected = merge.upsert_if_missing(spark.createDataFrame(base_rows, TRACKS), all_rows.where("status = 'success'"), as_of=AS_OF,
                                       order_col="event_id", insert_cols={"title": "title", "artist": "artist"}).drop("action")
    got = current_table(spark, pipe.at("tracks"))
    assert rows(got, *TRACKS.replace(" string", "").replace(" timestamp", "").split(", ")) == rows(expected)
    _done(dead_letter_stream(pipe.outcomes(), pipe.at("dlq"), pipe.at("ck2"), AS_OF, "event_id"))
    assert rows(spark.read.parquet(pipe.at("dlq")), "event_id") == [(2,), (7,)]  # the redelivered miss goes there once
    pipe.progress()
    assert pipe.totals() == [("j1", 3), ("j2", 3), ("j3", 1)]
    assert pipe.completed() == [("j1",), ("j2",), ("j3",)]     # each exactly once


def test_first_hit_decides_over_batches_and_base_rows_may_come_later(spark):
    t0 = dt.datetime(2024, 1, 1)
    pipe = Pipe(spark)
    pipe.arrive([(9, t0, "j1", "a", "x", True)], [(1, t0, "j1", "a", "x", True), (2, t0, "j1", "b", "x", True)])
    _put_rows(spark, pipe.at("base"), "b0", [("z|z", "z", "z", None, None, "beatport", AS_OF, AS_OF)], TRACKS)

    def run():
        base = file_stream(spark, pipe.at("base"), TRACKS, glob="*.parquet", max_files=None)
        _done(lookup_stream(pipe.outcomes(), base, pipe.at("tracks"), pipe.at("ck1"), AS_OF, order_col="event_id"))
        return {r.track_id: (r.youtube_video_id, r.source) for r in current_table(spark, pipe.at("tracks")).collect()}
    assert run() == {"a|x": ("yt-9", "ytmusic"), "b|x": ("yt-2", "ytmusic"), "z|z": (None, "beatport")}
    # another writer adds rows: one without a video, which the known hit fills, and one with its own
    _put_rows(spark, pipe.at("base"), "b1", [("a|x", "A", "X", None, None, "beatport", AS_OF, AS_OF),
                                             ("c|x", "c", "x", "own", None, "beatport", AS_OF, AS_OF)], TRACKS)
    pipe.arrive([(3, t0, "j1", "c", "x", True), (4, t0, "j1", "z", "z", True)])
    assert run() == {"a|x": ("yt-9", "beatport"), "b|x": ("yt-2", "ytmusic"), "c|x": ("own", "beatport"), "z|z": ("yt-4", "beatport")}


def test_late_messages_and_redeliveries_days_apart(spark):
    """Rows days out of order and redelivered days later count once, and none is dropped."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    pipe = Pipe(spark, [("j1", "f1", 5, AS_OF)])
    pipe.arrive([(1, day(9), "j1", "a", "x", True), (2, day(9), "j1", "b", "x", False)],
                [(3, day(0), "j1", "c", "x", True), (1, day(9), "j1", "a", "x", True), (None, day(0), "j1", "n", "x", False)],
                [(4, day(3), "j1", "d", "x", False), (2, day(9), "j1", "b", "x", False), (6, day(12), "j2", "e", "x", True)])
    pipe.progress()
    assert pipe.totals() == [("j1", 5), ("j2", 1)]
    assert pipe.completed() == [("j1",)]
    # a job created after its outcomes came completes when it comes; a redelivery after a restart is still known
    _put_rows(spark, pipe.jobs, "j1", [("j2", "f2", 1, AS_OF)], JOBS)
    pipe.arrive([(7, day(13), "j1", "g", "x", True), (1, day(9), "j1", "a", "x", True)])
    pipe.progress()
    assert pipe.totals() == [("j1", 6), ("j2", 1)]
    assert pipe.completed() == [("j1",), ("j2",)]
    _done(dead_letter_stream(pipe.outcomes(), pipe.at("dlq"), pipe.at("ck2"), AS_OF, id_col="event_id"))
    assert rows(spark.read.parquet(pipe.at("dlq")), "event_id") == [(2,), (4,), (None,)]


def test_cost_of_a_batch_does_not_follow_the_history(spark):
    """50 small batches: state grows by each batch's ids, and no batch takes longer for what came before."""
    t0 = dt.datetime(2024, 1, 1)
    pipe = Pipe(spark, [("j1", "f1", 200, AS_OF)])
    pipe.arrive(*[[(10 * i + k, t0, "j1", f"t{i}", "x", True) for k in range(4)] + [(1, t0, "j1", "t", "x", True)] for i in range(50)])
    jobs_in = file_stream(spark, pipe.jobs, JOBS, glob="*.parquet", max_files=None)
    q = _done(progress_stream(pipe.outcomes(), jobs_in, pipe.at("progress"), pipe.at("ck-p"), "event_id"))
    steps = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(steps) == 50 and pipe.totals() == [("j1", 200)]
    took = [p["durationMs"]["addBatch"] for p in steps]
    first, last = sorted(took[5:20])[7], sorted(took[35:50])[7]
    assert last < 1.6 * first + 50, took
    ids = [max(o["numRowsTotal"] for o in p["stateOperators"]) for p in steps]
    assert ids[-1] == 200 and all(o["numRowsUpdated"] <= 5 for p in steps for o in p["stateOperators"])


def test_notifications_to_messages_with_a_growing_known_table(spark):
    """Notifications name indented objects; one source over two batches is one
    job; a track that became known in between is not reported again."""
    root = tempfile.mkdtemp(prefix="rankflow-ingest-")
    store, src = os.path.join(root, "store"), os.path.join(root, "in")
    os.makedirs(os.path.join(store, "charts", "2024"))
    os.makedirs(src)

    def put(name, titles):
        with open(os.path.join(store, "charts", "2024", name), "w") as fh:
            json.dump({"tracks": [{"title": t, "artist": "x", "rank": i + 1} for i, t in enumerate(titles)]}, fh, indent=2)

    def notify(i, name):
        _put_rows(spark, src, f"n{i}", [("aws:sqs", _notification("charts", f"2024/{name}"))], "eventSource string, body string")

    put("a.json", ["one", "two"])
    put("b%.json", ["three", "one"])
    notify(0, "a.json")
    notify(1, "b%25.json")
    notify(3, "gone.json")
    known, out = os.path.join(root, "known"), os.path.join(root, "out")
    from rankflow.functions.text import content_key
    keys = lambda *t: spark.createDataFrame([("x", x) for x in t], "artist string, title string").select(
        content_key("artist", "title").alias("track_id"))
    keys("two").write.parquet(known)

    def run():
        stream = file_stream(spark, src, "eventSource string, body string", glob="*.parquet", max_files=1)
        _done(ingest_stream(stream, known, out, os.path.join(root, "ck"), AS_OF, objects_root=store))
    run()
    keys("one").write.mode("append").parquet(known)
    put("a.json", ["one", "four", "two"])
    notify(2, "a.json")
    run()
    got = rows(spark.read.parquet(f"{out}/records"), "source_file", "title")
    assert got == [("2024/a.json", "four"), ("2024/a.json", "one"), ("2024/b%.json", "one"), ("2024/b%.json", "three")]
    assert rows(job_table(spark, f"{out}/jobs"), "source_file", "expected_count") == [("2024/a.json", 2), ("2024/b%.json", 2)]
    sent = spark.read.parquet(f"{out}/messages").collect()
    assert len(sent) == 4 and {r.attributes["track_title"] for r in sent} == {"one", "three", "four"}
    assert all(json.loads(r.message)["job_id"] == r.attributes["job_id"] and "genre" in json.loads(r.message)["track"] for r in sent)


def _notification(bucket, key):
    return json.dumps({"Records": [{"eventSource": "aws:s3", "eventName": "ObjectCreated:Put",
                                    "s3": {"bucket": {"name": bucket}, "object": {"key": key}}}]})


def test_many_names_stay_off_the_driver(spark, monkeypatch):
    """100,000 notifications in one batch: names are a DataFrame all the way, and repeated ones are read once."""
    root = tempfile.mkdtemp(prefix="rankflow-names-")
    os.makedirs(os.path.join(root, "charts"))
    for i in range(20):
        with open(os.path.join(root, "charts", f"o{i}.json"), "w") as fh:
            fh.write(json.dumps({"tracks": [{"title": f"t{i}", "artist": "x"}]}))
    names = spark.range(100_000).select(F.lit("charts").alias("bucket"), F.concat(F.lit("o"), F.col("id") % 40, F.lit(".json")).alias("key"))
    with monkeypatch.context() as m:
        for method in ("collect", "toPandas", "toArrow", "toLocalIterator", "first", "take", "head"):
            m.setattr(type(names), method, lambda *a, **k: (_ for _ in ()).throw(AssertionError("rows came to the driver")))
        read_named(names, root).write.parquet(f"{root}/out")
    got = rows(spark.read.parquet(f"{root}/out"), "key", "json")
    assert got == sorted((f"o{i}.json", json.dumps({"tracks": [{"title": f"t{i}", "artist": "x"}]})) for i in range(20))
    assert read_named(names.where("id < 0"), root).count() == 0


def test_outcomes_are_counted_by_micro_batch(spark):
    root = tempfile.mkdtemp(prefix="rankflow-counts-")
    src = os.path.join(root, "in")
    good, bad = _notification("b", "k.json"), "{"
    batches = [[("aws:sqs", good), ("aws:sqs", bad)], [("aws:sns", good), ("aws:sqs", "[1]"), ("aws:sqs", good)], [("aws:sqs", "{}")]]
    for i, b in enumerate(batches):
        _put_rows(spark, src, f"n{i}", b, "eventSource string, body string")
    counts = OutcomeCounts()
    spark.streams.addListener(counts)
    try:
        stream = file_stream(spark, src, "eventSource string, body string", glob="*.parquet", max_files=1)
        _done(notification_stream(stream, counts, f"{root}/out", f"{root}/ck"))
        counts.wait(3)
    finally:
        spark.streams.removeListener(counts)
    got = [(r.processed, r.skipped, r.failed) for r in counts.frame(spark).orderBy("batch_id").collect()]
    want = [tuple(envelopes.outcome_summary(envelopes.decode_notifications(
        spark.createDataFrame(b, "eventSource string, body string"))).first()) for b in batches]
    assert got == want == [(1, 1, 0), (1, 1, 1), (0, 0, 0)]


def test_playlist_of_each_completed_job_is_made_once(spark):
    """Completions delivered twice, in two batches, and a restart; jobs without an object, tracks or videos say why."""
    root = tempfile.mkdtemp(prefix="rankflow-playlists-")
    store, src, made = (os.path.join(root, x) for x in ("store", "in", "made"))
    os.makedirs(os.path.join(store, "charts"))
    track = lambda t, i: {"title": t, "artist": "x", "track_id": i}
    docs = {"a.json": {"tracks": [track("one", "k1"), track("", "k2"), track("two", "k2"), track("one", "k1"), track("no", "k9"),
                                  track("none", "k3"), track("blank", " "), "text", {"title": 5, "artist": "x", "track_id": "k1"}]},
            "b.json": {"tracks": []}, "c.json": {"tracks": [track("none", "k3")]}, "d.json": {"other": 1}}
    for name, doc in docs.items():
        with open(os.path.join(store, "charts", name), "w") as fh:
            json.dump(doc, fh)
    with open(os.path.join(store, "charts", "bad.json"), "w") as fh:
        fh.write("{not json")
    spark.createDataFrame([("k1", "v1", None), ("k2", "v2", "u2"), ("k3", None, None)],
                          "track_id string, youtube_video_id string, youtube_url string").write.parquet(f"{root}/tracks")
    done = lambda job, key: (job, key, 1, 1, AS_OF, "completed", AS_OF, "charts" if key else None, key)
    _put_rows(spark, src, "c0", [done("ja", "a.json"), done("ja", "a.json"), done("jb", "b.json"), done("jc", "c.json")], COMPLETION_SCHEMA)
    _put_rows(spark, src, "c1", [done("ja", "a.json"), done("jd", "d.json"), done("je", "bad.json"), done("jf", "gone.json"),
                                 done("jg", None), done("jh", "a.json")], COMPLETION_SCHEMA)

    def run():
        stream = file_stream(spark, src, COMPLETION_SCHEMA, glob="*.parquet", max_files=1)
        _done(playlist_stream(stream, stored_objects(store), f"{root}/tracks", made, f"{root}/ck", AS_OF))
    run()
    _put_rows(spark, src, "c2", [done("jc", "c.json"), done("jh", "a.json")], COMPLETION_SCHEMA)
    run()
    lists = {r.job_id: r for r in spark.read.parquet(f"{made}/playlists").collect()}
    assert spark.read.parquet(f"{made}/playlists").count() == len(lists) == 8
    assert {j: r.error for j, r in lists.items()} == {
        "ja": None, "jh": None, "jb": "No tracks found in playlist data", "jc": "No tracks with YouTube video IDs found in database",
        "jd": "No tracks found in playlist data", "je": "Failed to download playlist data from S3",
        "jf": "Failed to download playlist data from S3", "jg": "Missing s3_bucket or s3_key in job completion event"}
    a = lists["ja"]
    assert (a.total_tracks_in_source, a.tracks_with_video_ids, a.videos_added_successfully, a.skipped_tracks) == (9, 3, 3, 6)
    assert a.playlist_name == "Beatport Top 100 (2024-02-01)" and a.playlist_url and lists["jc"].playlist_url is None
    assert a.description == "Automatically created playlist from job ja completed on 2024-02-01 00:00. Source: a.json"
    items = spark.read.parquet(f"{made}/items").where("job_id = 'ja'").orderBy("rec_pos").collect()
    assert [(r.position, r.video_id, r.video_url) for r in items if r.status == "enriched"] == [
        (0, "v1", "https://www.youtube.com/watch?v=v1"), (1, "v2", "u2"), (2, "v1", "https://www.youtube.com/watch?v=v1")]
    assert [r.reason for r in items if r.status != "enriched"] == [
        "missing title or artist", "track not found in database", "youtube_video_id missing in database", "missing track_id",
        "missing title or artist", "missing title or artist"]
