"""O29 - O34 and O31 quirks."""

from hypothesis import given, settings, strategies as st

from rowtools import rows
from rankflow.operators import history, joins


def test_new_records_keeps_batch_duplicates(spark):
    batch = spark.createDataFrame(
        [("a", "x", "k1"), ("a", "x", "k1"), ("b", "y", "k2"), ("", "y", "k3"), ("c", "  ", "k4"),
         ("d", "z", None), ("e", "w", "")], "title string, artist string, track_id string")
    known = spark.createDataFrame([("k2",)], "track_id string")
    assert rows(joins.new_records(batch, known), "track_id") == [("k1",), ("k1",)]


def test_enrich_reasons_and_order(spark):
    src = spark.createDataFrame(
        [(0, "t", "a", "k1"), (1, "", "a", "k1"), (2, "t", "a", " "), (3, "t", "a", "zz"),
         (4, "t", "a", "k2"), (5, "t", "a", "k3"), (6, "t", "a", "k4")],
        "pos int, title string, artist string, track_id string")
    tbl = spark.createDataFrame([("k1", "v1", None), ("k2", None, None), ("k3", "", None), ("k4", "v4", "u4")],
                                "track_id string, youtube_video_id string, youtube_url string")
    got = rows(joins.enrich(src, tbl), "pos", "status", "reason", "video_url")
    assert got == [
        (0, "enriched", None, "https://www.youtube.com/watch?v=v1"),
        (1, "skipped", "missing title or artist", None),
        (2, "skipped", "missing track_id", None),
        (3, "skipped", "track not found in database", None),
        (4, "skipped", "youtube_video_id missing in database", None),
        (5, "skipped", "youtube_video_id missing in database", None),
        (6, "enriched", None, "u4"),
    ]


def test_snapshot_diff_quirks(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("b", 5, 2), (None, 3, 3), ("c", 0, 4), ("d", 4, 5)],
                                "id string, pos int, ord int")
    new = spark.createDataFrame([("a", 1, 0), ("b", 3, 1), (None, 9, 2), ("c", 2, 3), ("e", 1, 4)],
                                "id string, pos int, ord int")
    d = history.snapshot_diff(old, new, "id", "pos", order_col="ord")
    got = rows(d, "id", "change_type", "old_position", "new_position", "change")
    assert got == sorted([
        (None, "moved", 3, 9, 6),          # all null ids collapse to one key
        ("b", "moved", 5, 3, -2),          # last duplicate wins
        ("c", "moved", 0, 2, None),        # position 0 -> change is null
        ("d", "removed", 4, None, None),
        ("e", "new", None, 1, None),
    ], key=repr)
    first = history.order_changes(d, "id").first()
    assert first.id is None                # biggest abs(change) first


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(1, 9)), max_size=6),
       st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(1, 9)), max_size=6))
def test_property_diff_swap_symmetry(spark, a, b):
    A = spark.createDataFrame([(x, p, i) for i, (x, p) in enumerate(a)], "id string, pos int, o int")
    B = spark.createDataFrame([(x, p, i) for i, (x, p) in enumerate(b)], "id string, pos int, o int")
    ab = {(r.id, r.change_type) for r in history.snapshot_diff(A, B, "id", "pos", order_col="o").collect()}
    ba = {(r.id, r.change_type) for r in history.snapshot_diff(B, A, "id", "pos", order_col="o").collect()}
    flip = {"new": "removed", "removed": "new", "moved": "moved"}
    assert ab == {(i, flip[t]) for i, t in ba}


def test_lookup_exact_first_hit(spark):
    tbl = spark.createDataFrame([(3, "t", "a"), (1, "t", "a"), (2, "t", "b")], "k int, title string, artist string")
    probe = spark.createDataFrame([("t", "a"), ("t", "c"), ("T", "a")], "title string, artist string")
    got = rows(joins.lookup_exact(probe, tbl, ["title", "artist"], "k"), "title", "artist", "match_key")
    assert got == [("T", "a", None), ("t", "a", 1), ("t", "c", None)]


def test_lookup_by_content_normalises(spark):
    from rankflow.functions.text import content_key
    tbl = spark.createDataFrame([("Fantasy Original Mix", "RSquared")], "t string, a string") \
        .select(content_key("a", "t").alias("track_id"))
    probe = spark.createDataFrame([("FANTASY original mix!", " rsquared"), ("Other", "x")], "title string, artist string")
    assert rows(joins.lookup_by_content(probe, tbl), "title", "found") == [("FANTASY original mix!", True), ("Other", False)]


def test_match_top1_overlap_and_ties(spark):
    q = spark.createDataFrame([(1, "red blue"), (2, "green"), (3, "zzz")], "qid int, text string")
    c = spark.createDataFrame([(10, "red blue red"), (11, "blue red green"), (5, "green"), (7, "green")],
                              "cid int, text string")
    got = rows(joins.match_top1(q, c, "qid", "text", "cid", "text"), "qid", "match_id", "overlap", "status")
    assert got == [(1, 10, 2, "success"), (2, 5, 1, "success"), (3, None, None, "not_found")]


def _brute_top1(q, c):
    out = {}
    for qid, qt in q:
        qs = set(t for t in qt.lower().split() if t)
        best = None
        for cid, ct in c:
            ov = len(qs & set(ct.lower().split()))
            if ov and (best is None or (-ov, cid) < (-best[1], best[0])):
                best = (cid, ov)
        out[qid] = best
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d e f g h".split()), min_size=1, max_size=5), min_size=1, max_size=5),
       st.lists(st.lists(st.sampled_from("a b c d e f g h".split()), min_size=1, max_size=6), min_size=1, max_size=12),
       st.integers(0, 4), st.integers(0, 6), st.sampled_from([0, 1 << 20]))
def test_property_match_top1_exact_whatever_the_work_is_split(spark, qs, cs, seed_tokens, seed_df, broadcast_tokens):
    q = [(i, " ".join(t)) for i, t in enumerate(qs)]
    c = [(100 - i, " ".join(t)) for i, t in enumerate(cs)]
    Q = spark.createDataFrame(q, "qid int, text string")
    C = spark.createDataFrame(c, "cid int, text string")
    got = {r.qid: (r.match_id, r.overlap) if r.match_id is not None else None
           for r in joins.match_top1(
               Q, C, "qid", "text", "cid", "text", seed_tokens, seed_df, broadcast_tokens).collect()}
    assert got == _brute_top1(q, c)


def test_match_top1_never_joins_the_most_frequent_token(spark):
    """One token in all entries: it only counts, in either way of joining, and entries with it alone score 1."""
    import numpy as np
    rng = np.random.default_rng(1)
    c = [(i, "the " + " ".join(f"w{x}" for x in rng.zipf(1.5, 6) if x < 400)) for i in range(600)]
    q = [(i, "the " + " ".join(f"w{x}" for x in rng.integers(1, 60, 5))) for i in range(20)] + [(99, "the"), (98, None), (97, ""), (96, "zz")]
    Q, C = spark.createDataFrame(q, "qid int, text string"), spark.createDataFrame([*c, (700, None)], "cid int, text string")
    want = _brute_top1([(i, t or "") for i, t in q], c)
    for limit in (0, 1 << 20):
        got = {r.qid: (r.match_id, r.overlap) if r.match_id is not None else None
               for r in joins.match_top1(Q, C, "qid", "text", "cid", "text", broadcast_tokens=limit).collect()}
        assert got == want
    assert want[99] == (0, 1) and want[96] is None


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["t", "", " "]), st.sampled_from(["a", ""]),
                          st.sampled_from(["k1", "k2", "k3", "", None])), max_size=12),
       st.lists(st.sampled_from(["k1", "k2", "k9"]), max_size=3))
def test_property_new_plus_matched_is_valid_input(spark, batch, known):
    b = spark.createDataFrame(batch, "title string, artist string, track_id string")
    k = spark.createDataFrame([(x,) for x in known], "track_id string")
    new = rows(joins.new_records(b, k), "title", "artist", "track_id")
    valid = [r for r in batch if r[0].strip() and r[1].strip() and r[2]]
    matched = [r for r in valid if r[2] in set(known)]
    assert sorted(new + matched, key=repr) == sorted(valid, key=repr)


def test_large_lookup_is_restricted_to_probe_keys(spark):
    known = spark.createDataFrame([(f"k{i}",) for i in range(200)], "track_id string")
    batch = spark.createDataFrame([("t", "a", "k3"), ("t", "a", "k500"), ("t", "a", "k7"), ("t", "a", "k500")],
                                  "title string, artist string, track_id string")
    got = rows(joins.new_records(batch, known), "track_id")   # table above the bound
    assert got == [("k500",), ("k500",)]
    tbl = known.withColumn("youtube_video_id", known.track_id).withColumn("youtube_url", known.track_id)
    enr = rows(joins.enrich(batch.withColumn("pos", batch.track_id), tbl),
               "track_id", "status")
    assert enr == [("k3", "enriched"), ("k500", "skipped"), ("k500", "skipped"), ("k7", "enriched")]
