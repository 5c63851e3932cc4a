"""O36 - O39, O41 keyed merges."""

import datetime as dt

from rowtools import rows
from rankflow.operators import merge

AS_OF = dt.datetime(2024, 2, 1)
OLD = dt.datetime(2024, 1, 1)
SCHEMA = "track_id string, title string, artist string, youtube_video_id string, youtube_url string, " \
         "source string, created_at timestamp, updated_at timestamp"


def _base(spark):
    return spark.createDataFrame([("k1", "t1", "a1", None, None, "beatport", OLD, OLD),
                                  ("k2", "t2", "a2", "", None, "beatport", OLD, OLD),
                                  ("k3", "t3", "a3", "v3", "u3", "beatport", OLD, OLD)], SCHEMA)


def test_upsert_three_way_and_idempotent(spark):
    hits = spark.createDataFrame([("k1", "n1", "x1", "t1", "a1"), ("k2", "n2", "x2", "t2", "a2"),
                                  ("k9", "n9", "x9", "t9", "a9"), ("k9", "n8", "x8", "t9", "a9")],
                                 "track_id string, youtube_video_id string, youtube_url string, title string, artist string")
    out = merge.upsert_if_missing(_base(spark), hits, as_of=AS_OF, insert_cols={"title": "title", "artist": "artist"})
    got = rows(out, "track_id", "youtube_video_id", "action", "source")
    assert got == [("k1", "n1", "updated", "beatport"), ("k2", "", "unchanged", "beatport"),
                   ("k3", "v3", "untouched", "beatport"), ("k9", "n8", "inserted", "ytmusic")]
    again = merge.upsert_if_missing(out.drop("action"), hits, as_of=AS_OF,
                                    insert_cols={"title": "title", "artist": "artist"})
    assert rows(again.drop("action")) == rows(out.drop("action"))


def test_patch_present_null_and_unknown_key(spark):
    base = _base(spark)
    upd = spark.createDataFrame([("k1", None, "T1", ["youtube_url", "title"]), ("k7", "x", "y", ["title"])],
                                "track_id string, youtube_url string, title string, present array<string>")
    out = merge.patch(base.withColumn("youtube_url", base.youtube_url), upd, "track_id", as_of=AS_OF)
    r = {x.track_id: x for x in out.collect()}
    assert r["k1"].title == "T1" and r["k1"].youtube_url is None and r["k1"].updated_at == AS_OF
    assert r["k3"].action == "unchanged" and "k7" not in r
    rep = rows(merge.patch_report(base, upd, "track_id"), "track_id", "status")
    assert rep == [("k1", "updated"), ("k7", "not_found")]


def test_fill_all_counts_matches(spark):
    base = spark.createDataFrame([(1, "t", "a", None), (2, "t", "a", "v"), (3, "t", "b", "")],
                                 "k int, title string, artist string, vid string")
    upd = spark.createDataFrame([("t", "a", "n"), ("t", "b", "m")], "title string, artist string, new string")
    got = rows(merge.fill_all(base, upd, ["title", "artist"], {"vid": "new"}), "k", "vid", "matched", "filled")
    assert got == [(1, "n", True, True), (2, "v", True, False), (3, "m", True, True)]


def test_fill_by_content(spark):
    from rankflow.functions.text import content_key
    base = _base(spark).withColumn("track_id", content_key("artist", "title"))
    hits = spark.createDataFrame([("T2", "A2", "x", "y", "v-2", "u-2"), ("t3", "a3", "x", "y", "v-3", "u-3"),
                                  ("new", "one", "New!", "One", "v-n", "u-n")],
                                 "title string, artist string, match_title string, match_artist string, "
                                 "youtube_video_id string, youtube_url string")
    out = merge.fill_by_content(base, hits, AS_OF)
    got = rows(out, "title", "youtube_video_id", "action")
    assert got == [("New!", "v-n", "inserted"), ("t1", None, "untouched"), ("t2", "v-2", "updated"),
                   ("t3", "v3", "kept")]


def test_insert_with_defaults(spark):
    df = spark.createDataFrame([("T", "A", "", None)], "title string, artist string, album string, source string")
    r = merge.insert_with_defaults(df, AS_OF).first()
    assert r.source == "beatport" and r.album is None and r.created_at == r.updated_at == AS_OF
    assert len(r.track_id) == 64


def test_patch_duplicate_patches_last_wins(spark):
    base = _base(spark)
    upd = spark.createDataFrame([("k1", "A", ["title"], 1), ("k1", "B", ["title"], 2)],
                                "track_id string, title string, present array<string>, seq int")
    out = merge.patch(base, upd, "track_id", as_of=AS_OF, order_col="seq")
    assert out.count() == 3 and out.where("track_id = 'k1'").first().title == "B"


def test_upsert_ignores_keyless_hits(spark):
    hits = spark.createDataFrame([(None, "n"), ("", "m")], "track_id string, youtube_video_id string")
    out = merge.upsert_if_missing(_base(spark), hits, fill={"youtube_video_id": "youtube_video_id"}, as_of=AS_OF)
    assert out.count() == 3 and out.where("action = 'inserted'").count() == 0


def test_patches_of_one_key_apply_one_after_another(spark):
    base = spark.createDataFrame([("k1", "t", 1.0, "g0"), ("k2", "t", 2.0, "g0")], "track_id string, title string, rating double, genre string")
    upd = spark.createDataFrame([("k1", 1, None, 5.0, None, ["rating"]), ("k1", 2, None, None, "g1", ["genre"]),
                                 ("k1", 3, None, None, None, ["title"]), ("k1", 0, "x", 9.0, "z", ["title", "rating", "genre"])],
                                "track_id string, seq int, title string, rating double, genre string, present array<string>")
    out = merge.patch(base, upd, "track_id", as_of=AS_OF, order_col="seq")
    assert rows(out, "track_id", "title", "rating", "genre", "action") == [
        ("k1", None, 5.0, "g1", "updated"), ("k2", "t", 2.0, "g0", "unchanged")]


def test_repeated_keys_need_an_order(spark):
    import pytest
    base = spark.createDataFrame([("k1", "t")], "track_id string, title string")
    upd = spark.createDataFrame([("k1", "a", ["title"]), ("k1", "b", ["title"])], "track_id string, title string, present array<string>")
    with pytest.raises(Exception, match="order_col"):
        merge.patch(base, upd, "track_id", as_of=AS_OF).collect()
