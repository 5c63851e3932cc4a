"""O09 - O21, O27, O28, O40, O42, O47, O48."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from rowtools import rows
from rankflow.operators import history, playlist
from rankflow.sources import pages

ROW = ('<div data-testid="tracks-table-row">'
       '<a href="/track/x/123">Hey</a><a href="/track/fantasy/20648420">Fantasy Original Mix</a>'
       '<a href="/artist/r/1">RSquared</a><a href="/artist/q/2">Q</a><a href="/artist/w/3">Wim &amp; Co</a>'
       '<a href="/label/l/1">RWorks</a><a href="/label/l/2">Other</a><a href="/genre/g/1"></a>'
       '<span>1280 BPM</span><span>Bb Minor</span></div>')
ROW2 = ('<div data-testid="tracks-table-row"><span>Key</span><span>12345</span><span>12A</span>'
        '<p>Fallback Title</p><a href="/artist/z/9">Zed</a><span>128 bpm</span></div>')


def test_extract_fields(spark):
    df = spark.createDataFrame([(1, ROW + ROW2), (2, "<html>none</html>")], "page int, html string")
    split = pages.split_rows(df, "html", pages.ExtractRules().row_pattern)
    assert rows(split, "page", "row_count", "position") == [(1, 2, 1), (1, 2, 2), (2, 0, None)]
    out = {r.position: r for r in pages.extract_fields(split.where("row_count > 0"), pages.ExtractRules()).collect()}
    a = out[1]
    assert a.title == "Fantasy Original Mix" and a.beatport_id == "20648420"
    assert a.url == "https://www.beatport.com/track/fantasy/20648420"
    assert a.artist == "RSquared, Wim & Co"          # 1-char names dropped
    assert a.label == "RWorks" and a.genre is None      # first link only, empty -> null
    assert a.bpm is None and a.key == "Bb Minor"        # 1280 -> 280 -> out of range
    b = out[2]
    assert b.title == "Fallback Title" and b.artist == "Zed" and b.bpm == 128


def test_number_with_unit_quirks(spark):
    df = spark.createDataFrame([("1280 BPM",), ("79 BPM",), ("House128 bpm",), ("none",), ("200BPM 90 BPM",)], "t string")
    got = [r[0] for r in df.select(pages.number_with_unit("t")).collect()]
    assert got == [None, None, 128, None, 200]
    keys = [r[0] for r in spark.createDataFrame([("c# major",), ("Hmajor",)], "t string")
            .select(pages.pattern_extract("t")).collect()]
    assert keys == ["c# major", None]


def test_retain_versions_matches_lead(spark):
    data = [(1, dt.datetime(2024, 1, d), v) for v, d in enumerate([1, 5, 5, 20, 28])] + \
           [(2, dt.datetime(2023, 12, 1), 9), (3, dt.datetime(2024, 1, 30), 10)]
    df = spark.createDataFrame(data, "k int, ts timestamp, v int")
    as_of = dt.datetime(2024, 2, 10)
    got = rows(history.retain_versions(df, "k", "ts", as_of, 30, version_col="v"), "v")
    w = Window.partitionBy("k").orderBy("ts", "v")
    cutoff = as_of - dt.timedelta(days=30)
    brute = df.withColumn("sup", F.lead("ts").over(w)).where(F.col("sup").isNull() | (F.col("sup") >= F.lit(cutoff)))
    assert got == rows(brute, "v")


def test_quarantine_scan_top_k(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(20)], "id int, attempts int")
    kept, q = history.quarantine(df, "attempts", 3)
    assert kept.count() + q.count() == 20 and q.where("attempts <= 3").count() == 0
    s = history.scan_limited(df, "id", 7).collect()
    assert [r.id for r in s] == list(range(7)) and {r.returned_count for r in s} == {7}
    top = history.top_k(df, ["attempts"], [F.col("id").desc()], 2)
    assert rows(top, "attempts", "id")[:2] == [(0, 10), (0, 15)]


def test_route_validate_playlists(spark):
    reqs = spark.createDataFrame([
        (1, '{"source":"music-search.orchestrator","detail-type":"Job Completed","detail":{"s3_bucket":"b"}}'),
        (2, '{"s3_bucket":"b","s3_key":"k"}'), (3, '{"playlist_name":"p","video_ids":[]}'),
        (4, '{"video_ids":["a"]}'), (5, '{"Records":[]}'), (6, '{"title":"t","author":"a"}')], "id int, request string")
    out = rows(playlist.validate(playlist.route(reqs)), "id", "route", "error", "lookup_route", "lookup_error")
    assert out == [
        (1, "job_completed", "Missing s3_bucket or s3_key in job completion event", "direct", "Missing title or author"),
        (2, "location", None, "direct", "Missing title or author"),
        (3, "direct_ids", "video_ids array is required and cannot be empty", "direct", "Missing title or author"),
        (4, "direct_ids", "playlist_name is required", "direct", "Missing title or author"),
        (5, "direct_ids", "playlist_name is required", "batch", None),
        (6, "direct_ids", "playlist_name is required", "direct", None)]
    items = spark.createDataFrame([("p", 2, "v2"), ("p", 1, "v1"), ("p", 3, "v1"), ("q", 1, "v9")],
                                  "pl string, src int, vid string")
    st = spark.createDataFrame([("p", 1, "quota")], "pl string, src int, add_error string")
    got = rows(playlist.playlist_items(items, ["pl"], ["src"], "vid", st, ["pl", "src"]),
               "pl", "src", "position", "added", "failed_position")
    assert got == [("p", 1, 0, False, 1), ("p", 2, 1, True, None), ("p", 3, 2, True, None), ("q", 1, 0, True, None)]
    reqs2 = spark.createDataFrame([("n", ["a", "b"]), ("", ["c"]), ("m", [])], "name string, ids array<string>")
    it, summ = playlist.playlist_from_ids(reqs2, "name", "ids", dt.datetime(2024, 2, 1))
    assert rows(it, "name", "position", "video_id") == [("n", 0, "a"), ("n", 1, "b")]
    assert rows(summ, "name", "error", "total_videos_requested") == [
        ("", "playlist_name is required", None), ("m", "video_ids array is required and cannot be empty", None),
        ("n", None, 2)]


def test_ordinal_in_group_with_hot_group(spark):
    from rankflow.operators.ordinal import ordinal_in_group
    data = [("hot", i) for i in range(3000)] + [(f"g{i % 7}", i) for i in range(700)] + [(None, i) for i in range(40)]
    df = spark.createDataFrame(data, "g string, o int")
    got = ordinal_in_group(df, ["g"], ["o"], "pos", partitions=6)
    w = Window.partitionBy("g").orderBy("o")
    brute = df.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    assert rows(got, "g", "o", "pos") == rows(brute, "g", "o", "pos")


def test_extract_rows_keeps_empty_pages(spark):
    df = spark.createDataFrame([(1, ROW), (2, "<p>no rows</p>")], "page int, html string")
    got = rows(pages.extract_rows(df, "html"), "page", "row_count", "position", "title")
    assert got == [(1, 1, 1, "Fantasy Original Mix"), (2, 0, None, None)]


OPEN = '<div class="r" data-testid="tracks-table-row" id=x>'


def _fields(spark, html):
    df = spark.createDataFrame([(1, html)], "page int, html string")
    return {r.position: r for r in pages.extract_rows(df, "html").collect()}


def test_rows_inside_containers_and_alone(spark):
    one = OPEN + '<div><a href="/track/a/1">Song One</a></div><a href="/artist/x/1">Ann</a></div>'
    two = "<DIV data-testid='tracks-table-row'><div><div><a href='/track/b/2'>Song Two</a></div></div></DIV>"
    got = _fields(spark, f"<html><div id=main><div>{one}<div>between</div>{two}</div><p>After the rows</p></div></html>")
    assert [(p, r.title, r.beatport_id) for p, r in sorted(got.items())] == [(1, "Song One", "1"), (2, "Song Two", "2")]
    assert got[1].artist == "Ann" and got[2].artist is None
    alone = _fields(spark, f"<section>{one}</section>")
    assert alone[1].row_count == 1 and alone[1].title == "Song One"
    cut = _fields(spark, OPEN + '<a href="/track/a/1">Never closed')
    assert cut[1].row_count == 1


def test_links_over_lines_quotes_and_references(spark):
    row = OPEN + """<a class=t
       href='/track/x/77'>Multi
       <b>Line</b> &#39;Mix&#x27; &eacute;&#233;</a>
       <a href=/artist/q/1>Q&amp;A</a><a href="/artist/r/2?a=1&amp;b=2">R &lt;3</a><a href="/label/l/3">Lab</a><a href="/genre/g/4">Gen</a></div>"""
    r = _fields(spark, row)[1]
    assert r.title.split() == ["Multi", "Line", "'Mix'", "&eacute;é"] and r.beatport_id == "77"
    assert (r.artist, r.label, r.genre) == ("Q&A, R <3", "Lab", "Gen")


def test_title_fallback_takes_the_full_text_of_nested_elements(spark):
    r = _fields(spark, OPEN + "<p>Deep <b>Purple Night</b></p><span>128 something</span></div>")[1]
    assert r.title == "Deep Purple Night"
    r = _fields(spark, OPEN + "<div><span>Key</span> <span>Inner <i>Words</i></span></div></div>")[1]
    assert r.title == "Key Inner Words"
    r = _fields(spark, OPEN + "<span>Key</span><p>12345678</p><div>&#72;ello World</div></div>")[1]
    assert r.title == "Hello World"


def test_changes_carry_their_rows_and_pairs_their_headers(spark):
    old = spark.createDataFrame([("a", 1, "A"), ("b", 2, "B"), ("c", 3, "C")], "id string, pos int, title string")
    new = spark.createDataFrame([("b", 1, "B2"), ("c", 3, "C"), ("d", 2, "D")], "id string, pos int, title string")
    got = {r.id: (r.change_type, r["item"].title) for r in history.snapshot_diff(old, new, "id", "pos", payload=["id", "title"]).collect()}
    assert got == {"a": ("removed", "A"), "b": ("moved", "B2"), "d": ("new", "D")}
    side = lambda df, at: df.withColumn("pair", F.lit(1)).withColumn("at", F.lit(at))
    head = history.pair_header(side(old, "x"), side(new.where("pos > 1"), "y"), ["pair"], "at")
    assert rows(head) == [(1, "x", 3, "y", 2)]


def test_location_rules(spark):
    req = spark.createDataFrame([("none",), ("dry",), ("ok",)], "k string")
    enr = spark.createDataFrame([("dry", "skipped"), ("ok", "skipped"), ("ok", "enriched")], "k string, status string")
    assert rows(playlist.validate_location(enr, req, "k"), "k", "error") == [
        ("dry", "No tracks with YouTube video IDs found in database"), ("none", "No tracks found in playlist data"), ("ok", None)]


def _texts_by_parser(fragment):
    """Texts of span, div and p in document order, by the standard library's parser and a stack."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.found, self.hidden = [], [], 0

        def handle_starttag(self, tag, attrs):
            if tag in pages.VOID_ELEMENTS:
                return
            node = [tag, []]
            if tag in pages.BLOCKS:
                self.found.append(node)
            self.stack.append(node)

        def handle_startendtag(self, tag, attrs):
            if tag in pages.BLOCKS:
                self.found.append([tag, []])

        def handle_endtag(self, tag):
            at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
            if at is not None:
                del self.stack[at:]

        def handle_data(self, data):
            if not any(n[0] in ("script", "style", "template") for n in self.stack):
                for n in self.stack:
                    n[1].append(data)

    p = P()
    p.feed(fragment)
    p.close()
    return [t for t in ("".join(n[1]).strip() for n in p.found) if t]


def test_block_texts_follow_the_stack_of_open_elements(spark):
    cases = ["<span>short</span><div><div>Inner one title</div> outer</div>", "<div>ab<span>Second</span><p>x<p>y</div>tail",
             "<p>unclosed paragraph <span>text", '<span title="a > b" data-x=\'</div>\'>Quoted</span>', "<div><br>with br<img src=x/></div>",
             "<div/><span>After empty</span>", "<script>var a='<div>no</div>';</script><span>Shown</span>",
             "<!-- <span>comment</span> --><SPAN>Upper</Span>", "</div><span>a</span></p><span>b &amp; c &#233;</span>", "", "no tags",
             "<a><span>in the link</a> tail</span><p>other</p>", "<ul><li><div>one<li><div>two</ul>three", "5 <span>x</span> 6",
             "<div>" * 40 + "deep" + "</div>" * 20 + "half", "<div><span>a<div>b</span>c</div>d</div>e"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, h string")
    got = {r.i: [t for t in r.x if t] for r in df.select("i", pages.block_texts(F.col("h")).alias("x")).collect()}
    assert got == {i: _texts_by_parser(c) for i, c in enumerate(cases)}


def test_title_fallback_of_nested_elements(spark):
    row = ('<div data-testid="tracks-table-row"><div><span>Key</span><div>12A</div></div>'
           '<div><div>Deep </div><span>Nested <b>Title</b></span></div><a href="/artist/z/9">Zed</a></div>')
    out = pages.extract_rows(spark.createDataFrame([(1, row), (2, None)], "page int, html string"), "html")
    got = {r.page: (r.row_count, r.title) for r in out.collect()}
    assert got == {1: (1, "Key12A"), 2: (0, None)}


def test_block_texts_of_a_long_fragment_take_time_in_proportion(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("<span>ab</span><b>x</b>" * n,)], "h string")
        t = time.time()
        assert df.select(F.size(pages.block_texts(F.col("h")))).first()[0] == n
        return time.time() - t
    seconds(100)
    assert seconds(8000) < 12 * max(seconds(2000), 0.15)
