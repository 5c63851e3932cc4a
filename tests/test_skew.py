"""Operators on data where one key holds a third of all rows, vs brute force."""

import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rowtools import rows
from rankflow.operators import history, jobs, joins, merge

AS_OF = dt.datetime(2024, 2, 1)
RND = random.Random(3)


def _keys(n):
    """A third of the rows on key 'hot', the rest spread."""
    return ["hot" if i % 3 == 0 else f"k{RND.randint(0, 200)}" for i in range(n)]


def test_new_records_and_jobs_with_hot_key(spark):
    ks = _keys(3000)
    batch = spark.createDataFrame([(k, "t", "a", f"f{i % 4}") for i, k in enumerate(ks)],
                                  "track_id string, title string, artist string, source_file string")
    known = spark.createDataFrame([(f"k{i}",) for i in range(0, 200, 2)], "track_id string")
    new = joins.new_records(batch, known)
    known_set = {f"k{i}" for i in range(0, 200, 2)}
    expected = [k for k in ks if k not in known_set]
    assert new.count() == len(expected)
    j = {r.source_file: r.expected_count for r in jobs.create_jobs(new, "source_file", AS_OF).collect()}
    exp_j = Counter(f"f{i % 4}" for i, k in enumerate(ks) if k not in known_set)
    assert j == dict(exp_j)


def test_progress_with_hot_job(spark):
    data = [("hot" if i % 3 else f"j{i % 50}", ["success", "not_found", "failed", "error"][i % 4]) for i in range(4000)]
    df = spark.createDataFrame(data, "job_id string, status string")
    got = dict(rows(jobs.job_progress(df), "job_id", "processed_count"))
    exp = Counter(j for j, s in data if s in ("success", "not_found"))
    exp.update({j: 0 for j, _ in data if j not in exp})
    assert got == dict(exp)


def test_retain_versions_with_hot_key(spark):
    base = dt.datetime(2023, 10, 1)
    data = [("hot" if i % 3 == 0 else f"k{i % 37}", base + dt.timedelta(hours=7 * i), i) for i in range(1500)]
    df = spark.createDataFrame(data, "k string, ts timestamp, v int")
    as_of = dt.datetime(2024, 1, 15)
    cutoff = as_of - dt.timedelta(days=30)
    by = defaultdict(list)
    for k, ts, v in data:
        by[k].append((ts, v))
    keep = set()
    for k, vs in by.items():
        vs.sort()
        for i, (ts, v) in enumerate(vs):
            nxt = vs[i + 1][0] if i + 1 < len(vs) else None
            if nxt is None or nxt >= cutoff:
                keep.add(v)
    got = {r.v for r in history.retain_versions(df, "k", "ts", as_of, 30, version_col="v").collect()}
    assert got == keep


def test_top_k_and_diff_with_hot_group(spark):
    data = [("hot" if i % 3 else f"g{i % 9}", f"id{i}", RND.randint(0, 10_000)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, id string, score int")
    got = rows(history.top_k(df, ["g"], [F.col("score").desc(), F.col("id")], 3), "g", "id")
    by = defaultdict(list)
    for g, i, s in data:
        by[g].append((-s, i))
    exp = sorted(((g, i) for g, v in by.items() for _, i in sorted(v)[:3]), key=repr)
    assert got == exp
    old = spark.createDataFrame([(f"id{i}" if i % 3 else None, i) for i in range(900)], "id string, pos int")
    new = spark.createDataFrame([(f"id{i}" if i % 3 else None, 900 - i) for i in range(300, 1200)], "id string, pos int")
    d = {r.change_type: r.n for r in history.snapshot_diff(old, new, "id", "pos").groupBy("change_type")
         .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert d == {"new": 200, "removed": 200, "moved": 401}   # null ids form one key


def test_upsert_with_hot_hit_key(spark):
    base = spark.createDataFrame([(f"k{i}", None if i % 2 else "v") for i in range(100)],
                                 "track_id string, youtube_video_id string")
    hits = spark.createDataFrame([("k1" if i % 3 == 0 else f"k{RND.randint(0, 150)}", f"n{i:05d}") for i in range(3000)],
                                 "track_id string, youtube_video_id string")
    out = {r.track_id: (r.youtube_video_id, r.action)
           for r in merge.upsert_if_missing(base, hits, fill={"youtube_video_id": "youtube_video_id"},
                                            as_of=AS_OF).collect()}
    assert out["k1"] == ("n00000", "updated")          # first hit by order decides
    assert all(a in ("updated", "unchanged", "inserted", "untouched") for _, a in out.values())


def test_positions_with_payload_and_hot_group(spark, tmp_path):
    """400,000 rows, a third in one group, read from Parquet with payload columns: exactly row_number."""
    from pyspark.sql import Window
    from rankflow.operators.ordinal import ordinal_in_group
    src = (spark.range(400_000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000))
           .withColumn("o", F.xxhash64("id")).withColumn("payload", F.concat(F.lit("p"), F.col("id").cast("string")))
           .withColumn("g", F.when(F.col("g") == 7, F.lit(None)).otherwise(F.col("g"))))
    src.write.parquet(str(tmp_path / "rows"))
    rows_ = spark.read.parquet(str(tmp_path / "rows"))
    got = ordinal_in_group(rows_, ["g"], ["o"], partitions=13)
    want = rows_.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    both = got.select("id", "position", "payload").join(want.select("id", "want", F.col("payload").alias("p")), "id")
    assert got.count() == 400_000 and both.count() == 400_000
    assert both.where("position <> want or payload <> p").count() == 0
