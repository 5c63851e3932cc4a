"""Every operator bound to the driver tables.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Each binding reads whole tables (no id subsets or row caps); a limit appears
only where it is the operator (top-100 chart, top-k, bounded scan, latest).
Timestamps leave as strings and doubles are rounded so both engines agree.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankflow.functions.text import content_key
from rankflow.operators import history, joins, jobs, merge, playlist, records
from rankflow.plans import sqltext as S
from rankflow.plans.tables import AS_OF, TASK_ROWS, table, ts_strings
from rankflow.sources import envelopes, pages

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------- O24 content key
@register("content_key_documents", f"""
SELECT doc_id, {S.key('source', 'text')} AS track_key FROM documents
""")
def content_key_documents(spark, d):
    docs = table(spark, d, "documents", spread=True)
    return docs.select("doc_id", content_key("source", "text").alias("track_key"))


@register("content_key_parts", f"""
SELECT p_partkey, {S.key('p_brand', 'p_name')} AS track_key FROM part
""")
def content_key_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", content_key("p_brand", "p_name").alias("track_key"))


# ---------------------------------------------------------------- O29 / O35 ingest slice
NEW_LINES_SQL = """
SELECT l.* FROM lineitem l
WHERE coalesce(l.l_returnflag, '') <> '' AND coalesce(l.l_linestatus, '') <> ''
  AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_size <= 25 AND p.p_partkey = l.l_partkey)
"""


def _new_lines(spark, d) -> DataFrame:
    known = table(spark, d, "part").where(F.col("p_size") <= 25)
    batch = table(spark, d, "lineitem")
    return joins.new_records(batch, known, key="l_partkey", required=("l_returnflag", "l_linestatus"),
                             known_key="p_partkey")


@register("new_records", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM ({NEW_LINES_SQL})
""")
def new_records(spark, d):
    return _new_lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey")


@register("new_records_bucketed", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM ({NEW_LINES_SQL})
""")
def new_records_bucketed(spark, d):
    known = table(spark, d, "part").where(F.col("p_size") <= 25).select("p_partkey")
    return joins.new_records(table(spark, d, "lineitem"), _bucketed(spark, known, "p_partkey"), key="l_partkey",
                             required=("l_returnflag", "l_linestatus"), known_key="p_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey")


def _bucketed(spark, rows: DataFrame, key: str, buckets: int = 16) -> DataFrame:
    """``rows`` as a table dealt by its key, as a stable table is kept."""
    from rankflow.session import work_dir
    from rankflow.sources.tables import write_bucketed
    path = work_dir(spark, "bucketed")
    return write_bucketed(rows, "t_" + path.rsplit("-", 1)[-1], path, key, buckets)


def _source_file(ts_col: str):
    return F.concat(F.lit("lineitem/"), F.date_format(F.col(ts_col), "yyyy/MM"), F.lit(".json"))


SOURCE_FILE_SQL = "'lineitem/' || strftime(l_shipdate, '%Y/%m') || '.json'"


@register("create_jobs", f"""
SELECT sha256(source_file) AS job_id, source_file, count(*) AS expected_count, 0 AS processed_count,
       'RUNNING' AS status, '2024-02-01 00:00:00' AS started_at, '2024-02-01 00:00:00' AS created_at,
       '2024-02-01 00:00:00' AS updated_at
FROM (SELECT {SOURCE_FILE_SQL} AS source_file FROM ({NEW_LINES_SQL})) GROUP BY source_file
""")
def create_jobs(spark, d):
    new = _new_lines(spark, d).withColumn("source_file", _source_file("l_shipdate"))
    return ts_strings(jobs.create_jobs(new, "source_file", AS_OF))


@register("build_messages", f"""
SELECT l_orderkey, l_linenumber,
  CAST(to_json({{'track': {{'l_partkey': l_partkey, 'l_returnflag': l_returnflag, 'l_linestatus': l_linestatus}},
            'source_file': {SOURCE_FILE_SQL}, 'job_id': sha256({SOURCE_FILE_SQL}),
            'timestamp': '2024-02-01T00:00:00', 'action': 'process_new_track'}}) AS VARCHAR) AS message,
  'New track: Unknown - Unknown' AS subject
FROM ({NEW_LINES_SQL})
""")
def build_messages(spark, d):
    new = (_new_lines(spark, d).withColumn("source_file", _source_file("l_shipdate"))
           .withColumn("job_id", F.sha2(F.col("source_file"), 256)))
    msgs = envelopes.build_messages(new.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
                                               "l_linestatus", "source_file", "job_id"),
                                    "source_file", "job_id", AS_OF,
                                    track_cols=["l_partkey", "l_returnflag", "l_linestatus"])
    return msgs.select("l_orderkey", "l_linenumber", "message", "subject")


# ---------------------------------------------------------------- O30 enrichment
ENRICH_SRC_SQL = """
SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'A') AS title, l_linestatus AS artist,
       CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS track_id FROM lineitem
"""
ENRICH_TBL_SQL = """
SELECT CAST(p_partkey AS VARCHAR) AS track_id, nullif(p_type, 'SMALL') AS youtube_video_id,
       CASE WHEN p_type = 'PROMO' THEN NULL ELSE 'https://video.example/' || p_partkey END AS youtube_url
FROM part WHERE p_size <= 25
"""


def _enrich_inputs(spark, d):
    src = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_returnflag"), F.lit("A")).alias("title"),
        F.col("l_linestatus").alias("artist"),
        F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(F.col("l_partkey").cast("string")).alias("track_id"))
    tbl = table(spark, d, "part").where(F.col("p_size") <= 25).select(
        F.col("p_partkey").cast("string").alias("track_id"),
        F.nullif(F.col("p_type"), F.lit("SMALL")).alias("youtube_video_id"),
        F.when(F.col("p_type") == "PROMO", F.lit(None))
         .otherwise(F.concat(F.lit("https://video.example/"), F.col("p_partkey").cast("string"))).alias("youtube_url"))
    return src, tbl


ENRICH_SQL = f"""
SELECT s.l_orderkey, s.l_linenumber,
  CASE WHEN r.reason IS NULL THEN 'enriched' ELSE 'skipped' END AS status, r.reason,
  CASE WHEN r.reason IS NULL THEN t.youtube_video_id END AS video_id,
  CASE WHEN r.reason IS NULL THEN coalesce(t.youtube_url, 'https://www.youtube.com/watch?v=' || t.youtube_video_id) END AS video_url
FROM ({ENRICH_SRC_SQL}) s
LEFT JOIN ({ENRICH_TBL_SQL}) t ON t.track_id = {S.strip("coalesce(s.track_id, '')")} AND {S.strip("coalesce(s.track_id, '')")} <> ''
CROSS JOIN LATERAL (SELECT CASE
   WHEN {S.strip("coalesce(s.title, '')")} = '' OR {S.strip("coalesce(s.artist, '')")} = '' THEN 'missing title or artist'
   WHEN {S.strip("coalesce(s.track_id, '')")} = '' THEN 'missing track_id'
   WHEN t.track_id IS NULL THEN 'track not found in database'
   WHEN coalesce(t.youtube_video_id, '') = '' THEN 'youtube_video_id missing in database' END AS reason) r
"""


@register("enrich", ENRICH_SQL)
def enrich(spark, d):
    src, tbl = _enrich_inputs(spark, d)
    return joins.enrich(src, tbl).select("l_orderkey", "l_linenumber", "status", "reason", "video_id", "video_url")


# ---------------------------------------------------------------- O31 / O48 / O49 monthly charts
CHART_SQL = """
SELECT month, o_custkey, CAST(pos AS BIGINT) AS position FROM (
  SELECT month, o_custkey, row_number() OVER (PARTITION BY month ORDER BY total DESC, o_custkey) AS pos
  FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY 1, 2)) WHERE pos <= 100
"""


def _chart(spark, d) -> DataFrame:
    """Monthly top-100 chart of customers by order value (the chart size is
    the feature).  ``row_number() <= 100`` plans a partial WindowGroupLimit
    before the shuffle, so each map task sends at most 100 rows per month."""
    totals = (table(spark, d, "orders")
              .groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_custkey")
              .agg(F.round(F.sum("o_totalprice"), 2).alias("total")))
    w = Window.partitionBy("month").orderBy(F.col("total").desc(), "o_custkey")
    ranked = totals.withColumn("position", F.row_number().over(w)).where(F.col("position") <= 100)
    return ranked.select("month", "o_custkey", F.col("position").cast("bigint").alias("position"))


def _next_month(c):
    return F.date_format(F.add_months(F.to_date(F.concat(c, F.lit("-01"))), 1), "yyyy-MM")


def _chart_pairs(chart: DataFrame):
    """Old/new sides keyed by the later month of each pair of consecutive
    calendar months that both have a chart (semi joins on the month list)."""
    months = chart.select(F.col("month").alias("pair")).distinct()
    has_prev = months.select(F.col("pair").alias("prev")).select(_next_month(F.col("prev")).alias("pair"))
    old = (chart.withColumn("pair", _next_month(F.col("month")))
                .join(months, "pair", "left_semi").select("pair", "o_custkey", "position"))
    new = (chart.withColumn("pair", F.col("month"))
                .join(has_prev, "pair", "left_semi").select("pair", "o_custkey", "position"))
    return old, new


NEXT_MONTH_SQL = "strftime(strptime({m} || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m')"

PAIRS_SQL = f"""
WITH chart AS ({CHART_SQL}),
months AS (SELECT DISTINCT month FROM chart),
o AS (SELECT {NEXT_MONTH_SQL.format(m='c.month')} AS pair, o_custkey, position FROM chart c
      WHERE {NEXT_MONTH_SQL.format(m='c.month')} IN (SELECT month FROM months)),
n AS (SELECT month AS pair, o_custkey, position FROM chart c
      WHERE c.month IN (SELECT {NEXT_MONTH_SQL.format(m='month')} FROM months))
"""

DIFF_BODY = """
SELECT coalesce(o.pair, n.pair) AS pair, coalesce(o.o_custkey, n.o_custkey) AS o_custkey,
  CASE WHEN o.o_custkey IS NULL THEN 'new' WHEN n.o_custkey IS NULL THEN 'removed' ELSE 'moved' END AS change_type,
  o.position AS old_position, n.position AS new_position,
  CASE WHEN o.o_custkey IS NOT NULL AND n.o_custkey IS NOT NULL AND coalesce(o.position, 0) <> 0
       AND coalesce(n.position, 0) <> 0 THEN n.position - o.position END AS change
FROM o FULL OUTER JOIN n ON o.pair = n.pair AND o.o_custkey = n.o_custkey
WHERE o.o_custkey IS NULL OR n.o_custkey IS NULL OR o.position IS DISTINCT FROM n.position
"""

DIFF_SQL = PAIRS_SQL + DIFF_BODY


def _diff(spark, d) -> DataFrame:
    old, new = _chart_pairs(_chart(spark, d))
    return history.snapshot_diff(old, new, "o_custkey", "position", by=["pair"])


@register("snapshot_diff", DIFF_SQL)
def snapshot_diff(spark, d):
    return _diff(spark, d).select("pair", "o_custkey", "change_type", "old_position", "new_position", "change")


@register("diff_summary", f"""
{PAIRS_SQL}, diff AS ({DIFF_BODY})
SELECT pair, count(*) FILTER (WHERE change_type = 'new') AS new_count,
       count(*) FILTER (WHERE change_type = 'removed') AS removed_count,
       count(*) FILTER (WHERE change_type = 'moved') AS moved_count
FROM diff GROUP BY pair
""")
def diff_summary(spark, d):
    return history.diff_summary(_diff(spark, d), by=["pair"])


@register("chart_top5", f"""
SELECT month, o_custkey, position FROM ({CHART_SQL}) WHERE position <= 5
""")
def chart_top5(spark, d):
    return history.top_k(_chart(spark, d), ["month"], [F.col("position")], 5)


@register("latest_chart_pair", f"""
WITH chart AS ({CHART_SQL}),
m AS (SELECT month, count(*) AS track_count, row_number() OVER (ORDER BY month DESC) AS r FROM chart GROUP BY month)
SELECT month, track_count, r AS recency FROM m WHERE r <= 2
""")
def latest_chart_pair(spark, d):
    """O49 header: key and track count of the two newest snapshots."""
    counts = _chart(spark, d).groupBy("month").agg(F.count(F.lit(1)).alias("track_count"))
    newest = counts.orderBy(F.col("month").desc()).limit(2)
    return newest.withColumn("recency", F.row_number().over(Window.orderBy(F.col("month").desc())).cast("bigint"))


# ---------------------------------------------------------------- O32 / O33 / O34 lookups
@register("lookup_exact", """
SELECT p.p_partkey, h.match_key FROM part p
LEFT JOIN (SELECT p_name, p_brand, min(p_partkey) AS match_key FROM part GROUP BY 1, 2) h
  ON h.p_name = p.p_name AND h.p_brand = p.p_brand
""")
def lookup_exact(spark, d):
    part = table(spark, d, "part")
    return joins.lookup_exact(part.select("p_partkey", "p_name", "p_brand"), part, ["p_name", "p_brand"],
                              "p_partkey").select("p_partkey", "match_key")


@register("lookup_by_content", f"""
SELECT p.p_partkey, {S.key("' ' || p.p_brand", "upper(p.p_name) || '!'")} AS lookup_key,
       k.track_id IS NOT NULL AS found
FROM part p LEFT JOIN (SELECT DISTINCT {S.key('p_brand', 'p_name')} AS track_id FROM part WHERE p_size <= 25) k
  ON k.track_id = {S.key("' ' || p.p_brand", "upper(p.p_name) || '!'")}
""")
def lookup_by_content(spark, d):
    part = table(spark, d, "part")
    tracks = part.where(F.col("p_size") <= 25).select(content_key("p_brand", "p_name").alias("track_id"))
    probe = part.select("p_partkey", F.concat(F.upper("p_name"), F.lit("!")).alias("title"),
                        F.concat(F.lit(" "), F.col("p_brand")).alias("artist"))
    return joins.lookup_by_content(probe, tracks).select("p_partkey", "lookup_key", "found")


@register("lookup_by_content_bucketed", f"""
SELECT p.p_partkey, {S.key("' ' || p.p_brand", "upper(p.p_name) || '!'")} AS lookup_key,
       k.track_id IS NOT NULL AS found
FROM part p LEFT JOIN (SELECT DISTINCT {S.key('p_brand', 'p_name')} AS track_id FROM part WHERE p_size <= 25) k
  ON k.track_id = {S.key("' ' || p.p_brand", "upper(p.p_name) || '!'")}
""")
def lookup_by_content_bucketed(spark, d):
    part = table(spark, d, "part")
    tracks = part.where(F.col("p_size") <= 25).select(content_key("p_brand", "p_name").alias("track_id"))
    probe = part.select("p_partkey", F.concat(F.upper("p_name"), F.lit("!")).alias("title"),
                        F.concat(F.lit(" "), F.col("p_brand")).alias("artist"))
    return joins.lookup_by_content(probe, _bucketed(spark, tracks, "track_id")).select("p_partkey", "lookup_key", "found")


TOKENS_SQL = "list_distinct(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> ''))"


@register("match_top1", f"""
WITH q AS (SELECT item_id, unnest({TOKENS_SQL.format(c='text')}) AS tok FROM benchmark),
c AS (SELECT doc_id, unnest({TOKENS_SQL.format(c='text')}) AS tok FROM documents),
ov AS (SELECT item_id, doc_id, count(*) AS overlap FROM q JOIN c USING (tok) GROUP BY 1, 2),
best AS (SELECT item_id, doc_id, overlap, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS r FROM ov)
SELECT b.item_id, x.doc_id AS match_id, x.overlap,
       CASE WHEN x.doc_id IS NULL THEN 'not_found' ELSE 'success' END AS status
FROM benchmark b LEFT JOIN (SELECT * FROM best WHERE r = 1) x ON x.item_id = b.item_id
""")
def match_top1(spark, d):
    bench = table(spark, d, "benchmark")
    docs = table(spark, d, "documents", spread=True)
    return joins.match_top1(bench.select("item_id", "text"), docs, "item_id", "text", "doc_id", "text") \
        .select("item_id", "match_id", "overlap", "status")


# ---------------------------------------------------------------- O36 - O39, O41 merges
def _customer_tracks(spark, d, segments):
    """Customers shaped as a tracks table keyed by the content key."""
    c = table(spark, d, "customer").where(F.col("c_mktsegment").isin(*segments))
    return c.select(
        content_key("c_mktsegment", "c_name").alias("track_id"),
        F.lit(AS_OF - _dt.timedelta(days=30)).cast("timestamp").alias("created_at"),
        F.lit(AS_OF - _dt.timedelta(days=30)).cast("timestamp").alias("updated_at"),
        F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist"),
        F.round("c_acctbal", 2).alias("rating"), F.col("c_nationkey").cast("bigint").alias("rank"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("v-"), F.col("c_custkey").cast("string")))
         .when(F.col("c_acctbal").between(0, 100), F.lit("")).alias("youtube_video_id"),
        F.lit(None).cast("string").alias("youtube_url"),
        F.lit("beatport").alias("source"), F.col("c_custkey"))


SEGMENTS = ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")
BASE_SEGMENTS = ("BUILDING", "AUTOMOBILE", "MACHINERY")
HIT_SEGMENTS = ("MACHINERY", "HOUSEHOLD", "FURNITURE")

CUST_BASE_SQL = f"""
SELECT {S.key('c_mktsegment', 'c_name')} AS track_id, c_name AS title, c_mktsegment AS artist,
  CASE WHEN c_acctbal > 5000 THEN 'v-' || c_custkey WHEN c_acctbal BETWEEN 0 AND 100 THEN '' END AS youtube_video_id,
  CAST(NULL AS VARCHAR) AS youtube_url, 'beatport' AS source, '2024-01-02 00:00:00' AS created_at,
  '2024-01-02 00:00:00' AS updated_at, c_custkey
FROM customer WHERE c_mktsegment IN {BASE_SEGMENTS}
"""

CUST_ALL_SQL = CUST_BASE_SQL.replace(str(BASE_SEGMENTS), str(SEGMENTS))


@register("insert_with_defaults", f"""
SELECT {S.key('c_mktsegment', 'c_name')} AS track_id, c_name AS title, c_mktsegment AS artist,
  round(c_acctbal, 2) AS rating, 'beatport' AS source, '2024-02-01 00:00:00' AS created_at,
  '2024-02-01 00:00:00' AS updated_at, CAST(NULL AS VARCHAR) AS album
FROM customer
""")
def insert_with_defaults(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist"),
        F.round("c_acctbal", 2).alias("rating"), F.lit("").alias("album"))
    rows = merge.insert_with_defaults(c, AS_OF)
    return ts_strings(rows.select("track_id", "title", "artist", "rating", "source", "created_at",
                                  "updated_at", "album"))


PATCH_UPD_SQL = f"""
SELECT CAST(c_custkey AS VARCHAR) AS track_id, round(c_acctbal * 2, 2) AS rating, CAST(NULL AS VARCHAR) AS genre
FROM customer WHERE c_acctbal < 0
UNION ALL
SELECT CAST(c_custkey + 100000000 AS VARCHAR), 1.0, 'x' FROM customer WHERE c_mktsegment = 'BUILDING'
"""


def _patch_inputs(spark, d):
    c = table(spark, d, "customer")
    base = c.select(F.col("c_custkey").cast("string").alias("track_id"), F.col("c_name").alias("title"),
                    F.round("c_acctbal", 2).alias("rating"), F.col("c_mktsegment").alias("genre"),
                    F.lit(AS_OF - _dt.timedelta(days=30)).cast("timestamp").alias("updated_at"))
    upd = c.where(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").cast("string").alias("track_id"), F.round(F.col("c_acctbal") * 2, 2).alias("rating"),
        F.lit(None).cast("string").alias("genre"), F.array(F.lit("rating"), F.lit("genre")).alias("present"))
    unknown = c.where(F.col("c_mktsegment") == "BUILDING").select(
        (F.col("c_custkey") + 100000000).cast("string").alias("track_id"), F.lit(1.0).alias("rating"),
        F.lit("x").alias("genre"), F.array(F.lit("rating"), F.lit("genre")).alias("present"))
    return base, upd.unionByName(unknown)


@register("patch", f"""
SELECT CAST(c.c_custkey AS VARCHAR) AS track_id, c.c_name AS title,
  CASE WHEN u.track_id IS NOT NULL THEN u.rating ELSE round(c.c_acctbal, 2) END AS rating,
  CASE WHEN u.track_id IS NOT NULL THEN u.genre ELSE c.c_mktsegment END AS genre,
  CASE WHEN u.track_id IS NOT NULL THEN '2024-02-01 00:00:00' ELSE '2024-01-02 00:00:00' END AS updated_at,
  CASE WHEN u.track_id IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS action
FROM customer c LEFT JOIN ({PATCH_UPD_SQL}) u ON u.track_id = CAST(c.c_custkey AS VARCHAR)
""")
def patch(spark, d):
    base, upd = _patch_inputs(spark, d)
    return ts_strings(merge.patch(base, upd, "track_id", as_of=AS_OF))


@register("patch_report", f"""
SELECT u.track_id, CASE WHEN c.c_custkey IS NULL THEN 'not_found' ELSE 'updated' END AS status
FROM ({PATCH_UPD_SQL}) u LEFT JOIN customer c ON u.track_id = CAST(c.c_custkey AS VARCHAR)
""")
def patch_report(spark, d):
    base, upd = _patch_inputs(spark, d)
    return merge.patch_report(base, upd, "track_id").select("track_id", "status")


def _hits(spark, d):
    c = table(spark, d, "customer").where(F.col("c_mktsegment").isin(*HIT_SEGMENTS))
    return c.select(content_key("c_mktsegment", "c_name").alias("track_id"),
                    F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist"),
                    F.concat(F.col("c_name"), F.lit(" (Official)")).alias("match_title"),
                    F.col("c_mktsegment").alias("match_artist"),
                    F.concat(F.lit("hit-"), F.col("c_custkey").cast("string")).alias("youtube_video_id"),
                    F.concat(F.lit("https://music.example/watch?v=hit-"), F.col("c_custkey").cast("string"))
                     .alias("youtube_url"))


HITS_SQL = f"""
SELECT {S.key('c_mktsegment', 'c_name')} AS track_id, c_name AS title, c_mktsegment AS artist,
  c_name || ' (Official)' AS match_title, c_mktsegment AS match_artist,
  'hit-' || c_custkey AS youtube_video_id, 'https://music.example/watch?v=hit-' || c_custkey AS youtube_url
FROM customer WHERE c_mktsegment IN {HIT_SEGMENTS}
"""


@register("upsert_if_missing", f"""
WITH b AS ({CUST_BASE_SQL}), h AS ({HITS_SQL}),
j AS (SELECT b.*, h.track_id AS h_key, h.title AS h_title, h.artist AS h_artist,
        h.youtube_video_id AS h_vid, h.youtube_url AS h_url,
        CASE WHEN b.track_id IS NOT NULL AND h.track_id IS NOT NULL AND b.youtube_video_id IS NULL THEN 'updated'
             WHEN b.track_id IS NOT NULL AND h.track_id IS NOT NULL THEN 'unchanged'
             WHEN h.track_id IS NOT NULL THEN 'inserted' ELSE 'untouched' END AS action
      FROM b FULL OUTER JOIN h ON b.track_id = h.track_id)
SELECT coalesce(track_id, h_key) AS track_id,
  CASE WHEN action = 'inserted' THEN h_title ELSE title END AS title,
  CASE WHEN action = 'inserted' THEN h_artist ELSE artist END AS artist,
  CASE WHEN action IN ('updated', 'inserted') THEN h_vid ELSE youtube_video_id END AS youtube_video_id,
  CASE WHEN action IN ('updated', 'inserted') THEN h_url ELSE youtube_url END AS youtube_url,
  CASE WHEN action = 'inserted' THEN 'ytmusic' ELSE source END AS source,
  CASE WHEN action = 'inserted' THEN '2024-02-01 00:00:00' ELSE created_at END AS created_at,
  CASE WHEN action IN ('updated', 'inserted') THEN '2024-02-01 00:00:00' ELSE updated_at END AS updated_at,
  action
FROM j
""")
def upsert_if_missing(spark, d):
    base = _customer_tracks(spark, d, BASE_SEGMENTS).select(
        "track_id", "title", "artist", "youtube_video_id", "youtube_url", "source", "created_at", "updated_at")
    out = merge.upsert_if_missing(base, _hits(spark, d), as_of=AS_OF,
                                  insert_cols={"title": "title", "artist": "artist"})
    return ts_strings(out)


@register("fill_by_content", f"""
WITH b AS ({CUST_BASE_SQL}), h AS ({HITS_SQL}),
hk AS (SELECT h.*, {S.key('match_artist', 'match_title')} AS k2 FROM h),
found AS (SELECT hk.*, b.youtube_video_id AS bval FROM hk JOIN b ON b.track_id = hk.track_id),
fills AS (SELECT track_id, youtube_video_id AS fv, youtube_url AS fu FROM found WHERE coalesce(bval, '') = ''),
ins AS (SELECT DISTINCT ON (k2) k2 AS track_id, match_title AS title, match_artist AS artist, youtube_video_id, youtube_url
        FROM hk WHERE hk.track_id NOT IN (SELECT track_id FROM b)
          AND k2 NOT IN (SELECT track_id FROM b) ORDER BY k2, youtube_video_id)
SELECT b.track_id, b.title,
  CASE WHEN f.track_id IS NOT NULL THEN f.fv ELSE b.youtube_video_id END AS youtube_video_id,
  CASE WHEN f.track_id IS NOT NULL THEN 'updated'
       WHEN b.track_id IN (SELECT track_id FROM found) THEN 'kept' ELSE 'untouched' END AS action
FROM b LEFT JOIN fills f ON f.track_id = b.track_id
UNION ALL
SELECT track_id, title, youtube_video_id, 'inserted' FROM ins
""")
def fill_by_content(spark, d):
    base = _customer_tracks(spark, d, BASE_SEGMENTS).select(
        "track_id", "title", "artist", "youtube_video_id", "youtube_url", "source", "created_at", "updated_at")
    out = merge.fill_by_content(base, _hits(spark, d), AS_OF)
    return out.select("track_id", "title", "youtube_video_id", "action")


@register("fill_all", """
WITH b AS (SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist,
             CASE WHEN p_size <= 10 THEN 'v-' || p_partkey END AS youtube_video_id FROM part),
u AS (SELECT p_name AS title, p_brand AS artist, min('promo-' || p_partkey) AS vid FROM part
      WHERE p_type = 'PROMO' GROUP BY 1, 2)
SELECT b.track_id,
  CASE WHEN u.title IS NOT NULL AND coalesce(b.youtube_video_id, '') = '' THEN u.vid ELSE b.youtube_video_id END AS youtube_video_id,
  u.title IS NOT NULL AS matched,
  u.title IS NOT NULL AND coalesce(b.youtube_video_id, '') = '' AS filled
FROM b LEFT JOIN u ON u.title = b.title AND u.artist = b.artist
""")
def fill_all(spark, d):
    part = table(spark, d, "part")
    base = part.select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title"),
                       F.col("p_brand").alias("artist"),
                       F.when(F.col("p_size") <= 10, F.concat(F.lit("v-"), F.col("p_partkey").cast("string")))
                        .alias("youtube_video_id"))
    upd = part.where(F.col("p_type") == "PROMO").select(
        F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.concat(F.lit("promo-"), F.col("p_partkey").cast("string")).alias("vid"))
    out = merge.fill_all(base, upd, ["title", "artist"], {"youtube_video_id": "vid"})
    return out.select("track_id", "youtube_video_id", "matched", "filled")


# ---------------------------------------------------------------- O09 - O12, O03, O04, O26
@register("quarantine", """
SELECT l_orderkey, l_linenumber, l_linenumber > 3 AS quarantined FROM lineitem
""")
def quarantine(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    kept, q = history.quarantine(li, "l_linenumber", 3)
    return (kept.withColumn("quarantined", F.lit(False))
                .unionByName(q.withColumn("quarantined", F.lit(True))))


RETAIN_AS_OF = _dt.datetime(1998, 8, 1)


@register("retain_versions", """
SELECT o_orderkey, o_custkey FROM (
  SELECT o_orderkey, o_custkey,
         lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS superseded_at
  FROM orders)
WHERE superseded_at IS NULL OR superseded_at >= TIMESTAMP '1998-07-02 00:00:00'
""")
def retain_versions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return history.retain_versions(o, "o_custkey", "o_orderdate", RETAIN_AS_OF, 30, version_col="o_orderkey") \
        .select("o_orderkey", "o_custkey")


@register("retain_recent", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-18 00:00:00'
""")
def retain_recent(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return history.retain_recent(o, "o_orderdate", RETAIN_AS_OF, 14).select("o_orderkey")


@register("get_by_key", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey = 7
""")
def get_by_key(spark, d):
    o = table(spark, d, "orders")
    return history.get_by_key(o, "o_orderkey", 7).select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@register("get_by_hashed_key", """
SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS track_id, o_custkey FROM orders WHERE o_orderkey = 7
""")
def get_by_hashed_key(spark, d):
    from rankflow.session import work_dir
    from rankflow.sources.tables import write_point_table
    path = work_dir(spark, "tracks")
    keyed = table(spark, d, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("track_id"), "o_custkey")
    write_point_table(keyed, path, "track_id", files=8)
    wanted = hashlib.sha256(b"7").hexdigest()
    return history.get_by_key(spark.read.parquet(path), "track_id", wanted)


@register("scan_limited", """
SELECT o_orderkey, o_custkey, count(*) OVER () AS returned_count
FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100)
""")
def scan_limited(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return history.scan_limited(o, "o_orderkey", 100)


LISTING_SQL = """
SELECT 'charts/' || strftime(o_orderdate, '%Y/%m/%d') || '/top100-' || o_orderkey
         || CASE WHEN o_orderstatus = 'P' THEN '.tmp' ELSE '.json' END AS key,
       CAST(trunc(o_totalprice) AS BIGINT) AS size,
       o_orderdate + to_seconds(o_orderkey % 86400) AS last_modified
FROM orders
"""


def _listing(spark, d) -> DataFrame:
    """An object listing derived from orders: dated keys, some not JSON."""
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("charts/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/top100-"),
                 F.col("o_orderkey").cast("string"),
                 F.when(F.col("o_orderstatus") == "P", ".tmp").otherwise(".json")).alias("key"),
        F.col("o_totalprice").cast("bigint").alias("size"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)")))
        .alias("last_modified"))


@register("list_snapshots", f"""
SELECT key, size, strftime(last_modified, '%Y-%m-%d %H:%M:%S') AS last_modified FROM ({LISTING_SQL})
WHERE starts_with(key, 'charts/1997/03/') AND ends_with(key, '.json')
""")
def list_snapshots(spark, d):
    from rankflow.sources.snapshots import list_snapshots as ls
    return ts_strings(ls(_listing(spark, d), date_prefix="1997/03/", root="charts/"))


@register("latest_snapshot", f"""
SELECT key, size, strftime(last_modified, '%Y-%m-%d %H:%M:%S') AS last_modified FROM ({LISTING_SQL})
WHERE ends_with(key, '.json') ORDER BY last_modified DESC, key DESC LIMIT 1
""")
def latest_snapshot(spark, d):
    from rankflow.sources.snapshots import latest_snapshot as ls, list_snapshots as li
    return ts_strings(ls(li(_listing(spark, d), root="charts/")))


@register("plain_numbers", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN CAST(l_extendedprice AS DECIMAL(12,2)) % 1 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS BIGINT) END AS price_int,
  CASE WHEN CAST(l_extendedprice AS DECIMAL(12,2)) % 1 <> 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) END AS price_float
FROM lineitem
""")
def plain_numbers(spark, d):
    li = table(spark, d, "lineitem", spread=True).select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    return records.plain_numbers(li, ["price"])


NUMBER_SQL = "CASE WHEN {0} % 1 = 0 THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST(CAST({0} AS DOUBLE) AS VARCHAR) END"


@register("plain_numbers_nested", f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_extendedprice AS DECIMAL(12,2)) AS p,
             CAST(l_discount AS DECIMAL(12,2)) AS d, CAST(l_quantity AS DECIMAL(12,2)) AS q FROM lineitem),
o AS (SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS DECIMAL(12,2)) AS t FROM orders),
a AS (SELECT l_orderkey, string_agg('{{"n":' || l_linenumber || ',"amounts":[' || {NUMBER_SQL.format("p")} || ',' || {NUMBER_SQL.format("q")}
        || CASE WHEN d = 0 THEN ',null' ELSE '' END || '],"by":{{"' || l_returnflag || '":' || {NUMBER_SQL.format("d")} || '}}}}', ',' ORDER BY l_linenumber, p, q, d, l_returnflag) AS x
      FROM l GROUP BY l_orderkey)
SELECT o_orderkey, '{{"ship":' || CASE WHEN o_orderpriority = '5-LOW' THEN 'null' ELSE '{{"total":' || {NUMBER_SQL.format("t")} || '}}' END
  || ',"lines":[' || CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE coalesce(x, '') END || ']}}' AS doc
FROM o LEFT JOIN a ON a.l_orderkey = o.o_orderkey
""")
def plain_numbers_nested(spark, d):
    dec = lambda c: F.col(c).cast("decimal(12,2)")
    line = F.struct(F.col("l_linenumber").alias("n"), F.when(dec("l_discount") == 0, F.array(dec("l_extendedprice"), dec("l_quantity"), F.lit(None).cast("decimal(12,2)")))
                    .otherwise(F.array(dec("l_extendedprice"), dec("l_quantity"))).alias("amounts"),
                    F.create_map(F.col("l_returnflag"), dec("l_discount")).alias("by"))
    # maps have no order, so the line is not its own sort key
    keyed = F.struct("l_linenumber", dec("l_extendedprice").alias("p"), dec("l_quantity").alias("q"), dec("l_discount").alias("d"),
                     "l_returnflag")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(keyed.alias("k"), line.alias("line"))).alias("_l"))
    ordered = F.transform(F.array_sort("_l", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda x: x["line"])
    lines = lines.select("l_orderkey", ordered.alias("_l"))
    kind = lines.schema["_l"].dataType
    held = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("_l"))
    doc = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.struct(
        F.when(F.col("o_orderpriority") != "5-LOW", F.struct(dec("o_totalprice").alias("total"))).alias("ship"),
        F.coalesce(held, F.array().cast(kind)).alias("lines")).alias("doc"))
    return records.plain_numbers(doc, ["doc"]).select("o_orderkey", F.to_json("doc", {"ignoreNullFields": "false"}).alias("doc"))


# ---------------------------------------------------------------- O05 / O46 notifications from events
def _notifications(spark, d) -> DataFrame:
    """Queue records built from events (to_json envelopes), one per event:
    signup = not a queue record, error = unreadable body, view = not a storage
    event, purchase under 2.0 = location without key, click from 45.0 = body of
    the wrong JSON type; the rest are well-formed."""
    e = table(spark, d, "events", spread=True)
    key = F.concat(F.lit("charts/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/top+"),
                   F.col("event_id").cast("string"), F.lit("%2Ejson"))
    obj = F.when((F.col("event_type") == "purchase") & (F.col("value") < 2),
                 F.to_json(F.struct(F.lit(1).alias("size")))) \
           .otherwise(F.to_json(F.struct(key.alias("key"), F.lit(1).alias("size"))))
    rec = F.concat(F.lit('{"eventSource":"'),
                   F.when(F.col("event_type") == "view", "aws:sns").otherwise("aws:s3"),
                   F.lit('","eventName":"ObjectCreated:Put","s3":{"bucket":{"name":"bucket-'),
                   F.col("user_id").cast("string"), F.lit('"},"object":'), obj, F.lit("}}"))
    body = (F.when(F.col("event_type") == "error", F.concat(F.lit('{"Records": ['), F.col("event_id").cast("string")))
             .when((F.col("event_type") == "click") & (F.col("value") >= 45),
                   F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")))
             .otherwise(F.concat(F.lit('{"Records":['), rec, F.lit("]}"))))
    return e.select("event_id", "ts",
                    F.when(F.col("event_type") == "signup", "aws:sns").otherwise("aws:sqs").alias("eventSource"),
                    body.alias("body"))


NOTIFY_SQL = """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, outcome,
  CASE WHEN outcome = 'processed' THEN 'bucket-' || user_id END AS bucket,
  CASE WHEN outcome = 'processed' THEN 'charts/' || strftime(ts, '%Y/%m/%d') || '/top ' || event_id || '.json' END AS key
FROM (SELECT *, CASE WHEN event_type IN ('signup', 'error', 'view') THEN 'skipped'
                     WHEN event_type = 'purchase' AND value < 2 THEN 'skipped'
                     WHEN event_type = 'click' AND value >= 45 THEN 'failed'
                     ELSE 'processed' END AS outcome FROM events)
"""


@register("decode_notifications", f"SELECT event_id, outcome, bucket, key FROM ({NOTIFY_SQL})")
def decode_notifications(spark, d):
    return envelopes.decode_notifications(_notifications(spark, d)).select("event_id", "outcome", "bucket", "key")


@register("outcome_summary", f"""
SELECT day, count(*) FILTER (WHERE outcome = 'processed') AS processed,
  count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed
FROM ({NOTIFY_SQL}) GROUP BY day
""")
def outcome_summary(spark, d):
    dec = envelopes.decode_notifications(_notifications(spark, d)).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return envelopes.outcome_summary(dec, ["day"])


# ---------------------------------------------------------------- O06 / O45 / O43 / O44 / O08 messages
def _messages(spark, d) -> DataFrame:
    return _messages_from(table(spark, d, "events", spread=True))


def _messages_from(e: DataFrame) -> DataFrame:
    """Doubly encoded fan-out messages built from events (batch or stream)."""
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    title = F.when((F.col("event_type") == "purchase") & (F.col("value") < 10), F.lit("  ")) \
             .otherwise(F.concat(F.lit("Track "), F.col("k").cast("string")))
    artist = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    job = F.concat(F.lit("job-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    src = F.concat(F.lit("charts/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/user-"),
                   F.col("user_id").cast("string"), F.lit(".json"))
    inner = F.to_json(F.struct(F.struct(title.alias("title"), artist.alias("artist"),
                                        F.concat(F.lit("tid-"), F.col("event_id").cast("string")).alias("track_id"))
                               .alias("track"), job.alias("job_id"), src.alias("source_file")))
    body = (F.when(F.col("event_type") == "signup", F.to_json(F.struct(F.lit("Notification").alias("Type"))))
             .when(F.col("event_type") == "error", F.concat(F.lit("oops "), F.col("event_id").cast("string")))
             .otherwise(F.to_json(F.struct(inner.alias("Message")))))
    return e.select("event_id", "ts", "user_id", "k", "event_type", body.alias("body"))


def _classified(spark, d) -> DataFrame:
    return _classify_from(_messages(spark, d), _catalog(spark, d, "_cat_key").distinct())


def _catalog(spark, d, key: str) -> DataFrame:
    """What click events put in the catalogue, by content key."""
    return (table(spark, d, "events", spread=True).where(F.col("event_type") == "click")
            .select(content_key(F.concat(F.lit("user "), F.col("user_id").cast("string")),
                                F.concat(F.lit("Track "), F.get_json_object("props", "$.k"))).alias(key)))


def _classify_from(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    msgs = envelopes.decode_messages(messages)
    looked = (msgs.withColumn("_q_key", content_key("artist", "title"))
                  .join(catalog, F.col("_q_key") == F.col("_cat_key"), "left")
                  .withColumn("lookup_status", F.when(F.col("_cat_key").isNotNull(), "success").otherwise("not_found")))
    return jobs.classify_outcomes(looked)


CLASSIFIED_SQL = f"""
WITH cat AS (SELECT DISTINCT {S.key("'user ' || user_id", "'Track ' || (props->>'k')")} AS ck FROM events WHERE event_type = 'click'),
m AS (SELECT event_id, event_type, user_id, value, CAST(props->>'k' AS INTEGER) AS k,
             'job-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS job_id FROM events WHERE event_type <> 'signup')
SELECT m.event_id,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' AND value < 10 THEN 'failed'
       WHEN cat.ck IS NOT NULL THEN 'success' ELSE 'not_found' END AS status,
  CASE WHEN event_type = 'error' THEN 'undecodable message'
       WHEN event_type = 'purchase' AND value < 10 THEN 'missing title or artist'
       WHEN cat.ck IS NOT NULL THEN NULL
       ELSE 'No YouTube results found for: Track ' || k || ' - user ' || user_id END AS error,
  CASE WHEN event_type = 'error' THEN NULL ELSE job_id END AS job_id,
  CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND value < 10) THEN 'unknown'
       ELSE 'Track ' || k || ' - user ' || user_id END AS track
FROM m LEFT JOIN cat ON cat.ck = {S.key("'user ' || m.user_id", "'Track ' || m.k")}
   AND NOT (event_type = 'error' OR (event_type = 'purchase' AND value < 10))
"""


@register("classify_outcomes", CLASSIFIED_SQL)
def classify_outcomes(spark, d):
    return _classified(spark, d).select("event_id", "status", "error", "job_id", "track")


@register("job_progress", f"""
SELECT job_id, count(*) FILTER (WHERE status IN ('success', 'not_found')) AS processed_count
FROM ({CLASSIFIED_SQL}) WHERE coalesce(job_id, '') <> '' GROUP BY job_id
""")
def job_progress(spark, d):
    return jobs.job_progress(_classified(spark, d))


def _event_jobs(spark, d) -> DataFrame:
    """Jobs created when the messages were fanned out: one per user-day."""
    e = table(spark, d, "events").where(F.col("event_type") != "signup").select(
        F.concat(F.lit("charts/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/user-"),
                 F.col("user_id").cast("string"), F.lit(".json")).alias("source_file"),
        F.concat(F.lit("job-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
        .alias("job_key"))
    made = jobs.create_jobs(e.where(F.col("source_file").isNotNull()), "source_file", AS_OF)
    ids = e.select("source_file", "job_key").distinct()
    return made.join(ids, "source_file").drop("job_id").withColumnRenamed("job_key", "job_id")


@register("completed_jobs", f"""
WITH p AS (SELECT job_id, count(*) FILTER (WHERE status IN ('success', 'not_found')) AS processed_count
           FROM ({CLASSIFIED_SQL}) WHERE coalesce(job_id, '') <> '' GROUP BY job_id),
j AS (SELECT 'job-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS job_id,
             'charts/' || strftime(ts, '%Y/%m/%d') || '/user-' || user_id || '.json' AS source_file,
             count(*) AS expected_count FROM events WHERE event_type <> 'signup' GROUP BY 1, 2)
SELECT j.job_id, j.source_file, j.expected_count, p.processed_count, '2024-02-01 00:00:00' AS created_at,
  'completed' AS status, '2024-02-01 00:00:00' AS completed_at, 'charts-bucket' AS s3_bucket, j.source_file AS s3_key
FROM j JOIN p USING (job_id) WHERE p.processed_count >= j.expected_count AND p.processed_count > 0
""")
def completed_jobs(spark, d):
    progress = jobs.job_progress(_classified(spark, d))
    return ts_strings(jobs.completed_jobs(_event_jobs(spark, d), progress, AS_OF, bucket="charts-bucket"))


@register("dead_letters", f"""
SELECT event_id, job_id, error AS failure_reason, '2024-02-01T00:00:00' AS dead_at
FROM ({CLASSIFIED_SQL}) WHERE status = 'not_found'
""")
def dead_letters(spark, d):
    _, dead = jobs.split_dead_letters(_classified(spark, d), AS_OF)
    return dead.select("event_id", "job_id", "failure_reason", "dead_at")


# ---------------------------------------------------------------- O27 / O28 requests
def _requests(spark, d) -> DataFrame:
    e = table(spark, d, "events", spread=True)
    uid = F.col("user_id").cast("string")
    job = F.to_json(F.struct(F.lit("music-search.orchestrator").alias("source"),
                             F.lit("Job Completed").alias("detail-type"),
                             F.struct(F.concat(F.lit("job-"), uid).alias("job_id"),
                                      F.when(F.col("value") >= 25, "charts").otherwise("").alias("s3_bucket"),
                                      F.concat(F.lit("charts/u"), uid, F.lit(".json")).alias("s3_key")).alias("detail")))
    loc = F.to_json(F.struct(F.lit("charts").alias("s3_bucket"), F.concat(F.lit("charts/u"), uid, F.lit(".json")).alias("s3_key")))
    ids = F.to_json(F.struct(F.when(F.col("value") >= 20, F.concat(F.lit("pl-"), uid)).otherwise("").alias("playlist_name"),
                             F.when(F.col("value") >= 5, F.array(F.concat(F.lit("v"), uid))).otherwise(F.array().cast("array<string>"))
                             .alias("video_ids")))
    look = F.to_json(F.struct(F.concat(F.lit("Track "), F.get_json_object("props", "$.k")).alias("title"),
                              F.when(F.col("value") >= 3, F.concat(F.lit("user "), uid)).alias("author")))
    req = (F.when(F.col("event_type") == "signup", job).when(F.col("event_type") == "click", loc)
            .when(F.col("event_type") == "view", ids).when(F.col("event_type") == "purchase", look)
            .otherwise(F.lit('{"Records": []}')))
    return e.select("event_id", req.alias("request"))


@register("route_validate", """
SELECT event_id,
  CASE event_type WHEN 'signup' THEN 'job_completed' WHEN 'click' THEN 'location' ELSE 'direct_ids' END AS route,
  CASE WHEN event_type = 'signup' AND value < 25 THEN 'Missing s3_bucket or s3_key in job completion event'
       WHEN event_type IN ('view', 'purchase', 'error') AND NOT (event_type = 'view' AND value >= 20) THEN 'playlist_name is required'
       WHEN event_type = 'view' AND value < 5 THEN 'video_ids array is required and cannot be empty' END AS error,
  CASE WHEN event_type = 'error' THEN 'batch' ELSE 'direct' END AS lookup_route,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' AND value >= 3 THEN NULL
       ELSE 'Missing title or author' END AS lookup_error
FROM events
""")
def route_validate(spark, d):
    routed = playlist.validate(playlist.route(_requests(spark, d)))
    return routed.select("event_id", "route", "error", "lookup_route", "lookup_error")


# ---------------------------------------------------------------- O40 / O42 playlists from orders
def _playlist_rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority",
                    F.when(F.col("o_orderpriority") == "5-LOW", "skipped").otherwise("enriched").alias("status"))


def _playlist_items(spark, d) -> DataFrame:
    rows = _playlist_rows(spark, d)
    add_status = (rows.where(F.col("o_orderstatus") == "P")
                      .select("o_orderkey", F.lit("quota exceeded").alias("add_error")))
    return playlist.playlist_items(rows.where(F.col("status") == "enriched"), ["o_custkey"],
                                   ["o_orderdate", "o_orderkey"], "o_orderkey", add_status, ["o_orderkey"])


ITEMS_SQL = """
SELECT o_custkey, o_orderkey, o_orderpriority AS payload,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS position,
  o_orderstatus <> 'P' AS added,
  CASE WHEN o_orderstatus = 'P' THEN CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) END AS failed_position
FROM orders WHERE o_orderpriority <> '5-LOW'
"""


@register("playlist_items", ITEMS_SQL)
def playlist_items(spark, d):
    return _playlist_items(spark, d).select(
        "o_custkey", "o_orderkey", F.col("o_orderpriority").alias("payload"), "position", "added", "failed_position")


@register("playlist_summary", f"""
WITH i AS ({ITEMS_SQL}),
r AS (SELECT o.o_custkey, o.o_orderpriority <> '5-LOW' AS enriched, i.added FROM orders o LEFT JOIN i USING (o_orderkey)),
a AS (SELECT o_custkey, count(*) AS total_tracks_in_source, count(*) FILTER (WHERE enriched) AS tracks_with_video_ids,
        count(*) FILTER (WHERE enriched AND added) AS videos_added_successfully,
        count(*) FILTER (WHERE enriched AND NOT added) AS failed_videos,
        count(*) FILTER (WHERE NOT enriched) AS skipped_tracks FROM r GROUP BY o_custkey)
SELECT a.*, sha256(CAST(a.o_custkey AS VARCHAR)) AS playlist_id,
  'https://www.youtube.com/playlist?list=' || sha256(CAST(a.o_custkey AS VARCHAR)) AS playlist_url,
  CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Beatport Top 100 (2024-02-01)'
       WHEN c.c_mktsegment = 'BUILDING' THEN 'Building mix' ELSE c.c_name END AS playlist_name,
  CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Automatically created playlist from job job-' || a.o_custkey
         || ' completed on 2024-02-01 00:00. Source: orders/' || a.o_custkey || '.json'
       ELSE 'Playlist created from orders/' || a.o_custkey || '.json on 2024-02-01 00:00' END AS description
FROM a JOIN customer c ON c.c_custkey = a.o_custkey
""")
def playlist_summary(spark, d):
    rows = _playlist_rows(spark, d)
    items = _playlist_items(spark, d).select("o_orderkey", "added")
    joined = rows.join(items, "o_orderkey", "left")
    summary = playlist.playlist_summary(joined, ["o_custkey"])
    cust = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("snapshot_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Building mix").alias("request_name"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("job-"), F.col("c_custkey").cast("string")))
         .alias("job_id"))
    head = playlist.playlist_header(
        summary.join(cust, "o_custkey").withColumn(
            "s3_key", F.concat(F.lit("orders/"), F.col("o_custkey").cast("string"), F.lit(".json"))),
        AS_OF, request_name="request_name", snapshot_name="snapshot_name", job_col="job_id")
    return head.select("o_custkey", "total_tracks_in_source", "tracks_with_video_ids", "videos_added_successfully",
                       "failed_videos", "skipped_tracks", "playlist_id", "playlist_url", "playlist_name",
                       "description")


# ---------------------------------------------------------------- O47 direct id lists from pages
def _id_requests(spark, d) -> DataFrame:
    p = table(spark, d, "pages", spread=True)
    return p.select("page_id", F.col("url").alias("playlist_name"),
                    F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1).alias("video_ids"))


IDS_SQL = """SELECT page_id, url AS playlist_name, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS video_ids FROM pages"""


def _refused(spark, d) -> DataFrame:
    """The second add of every fifth page is refused."""
    return table(spark, d, "pages").where(F.col("page_id") % 5 == 0).select(
        "page_id", F.lit(1).alias("position"), F.lit("quota exceeded").alias("add_error"))


@register("playlist_from_ids_items", f"""
SELECT page_id, CAST(o - 1 AS INTEGER) AS position, v AS video_id, NOT (page_id % 5 = 0 AND o = 2) AS added
FROM ({IDS_SQL}) r, unnest(r.video_ids) WITH ORDINALITY AS t(v, o)
WHERE coalesce(playlist_name, '') <> ''
""")
def playlist_from_ids_items(spark, d):
    items, _ = playlist.playlist_from_ids(_id_requests(spark, d), "playlist_name", "video_ids", AS_OF, id_col="page_id",
                                          failed=_refused(spark, d))
    return items.select("page_id", "position", "video_id", "added")


@register("playlist_from_ids_summary", f"""
SELECT page_id, playlist_name,
  CASE WHEN coalesce(playlist_name, '') = '' THEN 'playlist_name is required'
       WHEN len(video_ids) = 0 THEN 'video_ids array is required and cannot be empty' END AS error,
  'Public playlist created on 2024-02-01 00:00' AS description,
  CASE WHEN coalesce(playlist_name, '') <> '' AND len(video_ids) > 0 THEN CAST(len(video_ids) AS INTEGER) END AS total_videos_requested,
  CASE WHEN coalesce(playlist_name, '') <> '' AND len(video_ids) > 0
       THEN len(video_ids) - CASE WHEN page_id % 5 = 0 AND len(video_ids) > 1 THEN 1 ELSE 0 END END AS videos_added_successfully,
  CASE WHEN coalesce(playlist_name, '') <> '' AND len(video_ids) > 0
       THEN CASE WHEN page_id % 5 = 0 AND len(video_ids) > 1 THEN 1 ELSE 0 END END AS failed_videos
FROM ({IDS_SQL})
""")
def playlist_from_ids_summary(spark, d):
    _, summary = playlist.playlist_from_ids(_id_requests(spark, d), "playlist_name", "video_ids", AS_OF, id_col="page_id",
                                            failed=_refused(spark, d))
    return summary.select("page_id", "playlist_name", "error", "description", "total_videos_requested",
                          "videos_added_successfully", "failed_videos")


# ---------------------------------------------------------------- O13 - O21 extraction from pages
LI_RULES = pages.ExtractRules(row_pattern=r"<li>(.*?)</li>", title_href="/", id_pattern=r"^/([^/]+)$",
                              host="https://www.example.com", artist_href="/", label_href="/", genre_href="/")
ARTICLE_RULES = pages.ExtractRules(row_pattern=r"(?s)<article>(.*?)</article>")

LINK_SQL = r'<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def _extract_sql(row_pattern: str, title_href: str, id_pattern: str, host: str, other_href: str,
                 block: str = "(?:span|div|p)", own_close: bool = False) -> str:
    """``own_close``: a block ends at its own end tag, counted over the tags of its name, else at the first one."""
    clean = S.strip(S.html_text("t[i]"))
    own = S.strip(S.html_text("x"))
    stop = "('track', 'title', 'artist', 'label', 'genre', 'bpm', 'key')"
    text = S.html_text("row_html")
    blocks = f"regexp_extract_all(row_html, '(?s)<{block}\\b[^>]*>(.*?)(?:</{block}\\s*>|$)', 1)"
    if own_close:
        tokens = f"regexp_extract_all(row_html, '(?s)</?{block}\\b[^>]*>|<[^>]*>|[^<]+|<')"
        sign = (f"list_transform({tokens}, lambda x: CASE WHEN regexp_matches(x, '^<{block}\\b') THEN 1 "
                f"WHEN regexp_matches(x, '^</{block}\\b') THEN -1 ELSE 0 END)")
        end = ("coalesce(list_filter(generate_series(i + 1, len(sg)), lambda j: sg[j] = -1 AND list_sum(sg[i:j]) = 0)[1], len(sg) + 1)")
        blocks = f"""(SELECT list_transform(list_filter(generate_series(1, len(sg)), lambda i: sg[i] = 1),
            lambda i: array_to_string(tk[i + 1:{end} - 1], '')) FROM (SELECT {tokens} AS tk, {sign} AS sg))"""
    return f"""
WITH r AS (SELECT page_id, CAST(o AS INTEGER) AS position, row_html
           FROM pages, unnest(regexp_extract_all(html, '{row_pattern}', 1)) WITH ORDINALITY AS u(row_html, o)),
l AS (SELECT *, regexp_extract_all(row_html, '{LINK_SQL}', 1) AS h,
             list_transform(regexp_extract_all(row_html, '{LINK_SQL}', 2), lambda t_: t_) AS traw FROM r),
c AS (SELECT *, list_transform(traw, lambda x: {S.strip(S.html_text("x"))}) AS t FROM l),
f AS (SELECT *,
  list_filter(generate_series(1, len(h)), lambda i: contains(h[i], '{title_href}') AND length(t[i]) > 3)[1] AS ti,
  list_filter(list_transform({blocks}, lambda x: {own}),
              lambda x: length(x) > 5 AND lower(x) NOT IN {stop} AND NOT regexp_matches(x, '^\\p{{Nd}}+$')
                        AND NOT regexp_matches(x, '^\\d+[A-G]?$'))[1] AS fb,
  list_filter(generate_series(1, len(h)), lambda i: contains(h[i], '{other_href}'))[1] AS oi,
  list_transform(list_filter(generate_series(1, len(h)), lambda i: contains(h[i], '{other_href}') AND length(t[i]) > 1),
                 lambda i: t[i]) AS arts,
  TRY_CAST(nullif(regexp_extract({text}, '(?i)(\\d{{2,3}})\\s*BPM', 1), '') AS INTEGER) AS num,
  nullif(regexp_extract({text}, '(?i)([A-G](?:#|b)?\\s+(?:Major|Minor))', 1), '') AS mkey
  FROM c)
SELECT page_id, position, coalesce(t[ti], fb) AS title,
  CASE WHEN ti IS NOT NULL THEN nullif(regexp_extract(h[ti], '{id_pattern}', 1), '') END AS beatport_id,
  CASE WHEN ti IS NOT NULL AND nullif(regexp_extract(h[ti], '{id_pattern}', 1), '') IS NOT NULL
       THEN CASE WHEN starts_with(h[ti], '/') THEN '{host}' || h[ti] ELSE h[ti] END END AS url,
  nullif(array_to_string(arts, ', '), '') AS artist,
  nullif(t[oi], '') AS label, nullif(t[oi], '') AS genre,
  CASE WHEN num BETWEEN 80 AND 200 THEN num END AS bpm, mkey AS "key"
FROM f
"""


EXTRACT_LI_SQL = _extract_sql(LI_RULES.row_pattern, "/", LI_RULES.id_pattern, LI_RULES.host, "/")


def _extracted(spark, d, rules) -> DataFrame:
    rows = pages.split_rows(table(spark, d, "pages", spread=True).select("page_id", "html"), "html", rules.row_pattern)
    return pages.extract_fields(rows.where(F.col("row_count") > 0), rules)


FIELDS = ["page_id", "position", "title", "beatport_id", "url", "artist", "label", "genre", "bpm", "key"]


@register("extract_rows", EXTRACT_LI_SQL)
def extract_rows(spark, d):
    return _extracted(spark, d, LI_RULES).select(*FIELDS)


@register("valid_rows", f"""
SELECT * FROM ({EXTRACT_LI_SQL}) WHERE coalesce(title, '') <> '' AND coalesce(artist, '') <> ''
""")
def valid_rows(spark, d):
    return pages.valid_rows(_extracted(spark, d, LI_RULES)).select(*FIELDS)


@register("assemble_snapshot", f"""
SELECT page_id, CAST(count(*) AS BIGINT) AS track_count, 'beatport-top100-20240201-000000' AS playlist_id,
  min(position) AS first_position, arg_min(title, position) AS first_title
FROM ({EXTRACT_LI_SQL}) WHERE coalesce(title, '') <> '' AND coalesce(artist, '') <> '' GROUP BY page_id
""")
def assemble_snapshot(spark, d):
    valid = pages.valid_rows(_extracted(spark, d, LI_RULES)).withColumn("track_id", content_key("artist", "title"))
    snap = pages.assemble_snapshot(valid, "page_id", AS_OF)
    return snap.select("page_id", "track_count", "playlist_id",
                       F.col("tracks")[0]["position"].alias("first_position"),
                       F.col("tracks")[0]["title"].alias("first_title"))


@register("title_fallback", f"""
SELECT page_id, title FROM ({_extract_sql(ARTICLE_RULES.row_pattern, '/track/', ARTICLE_RULES.id_pattern,
                                          ARTICLE_RULES.host, '/artist/', 'p', own_close=True)})
""")
def title_fallback(spark, d):
    return _extracted(spark, d, ARTICLE_RULES).select("page_id", "title")


BPM_TEXT_SQL = ("l_returnflag || ' ' || CAST(CAST(l_quantity * 5 AS INTEGER) AS VARCHAR) || 'BPM ' || "
                "substr('ABCDEFG', l_linenumber, 1) || CASE WHEN l_linestatus = 'O' THEN 'b' ELSE '' END || ' minor'")


@register("number_and_pattern", f"""
SELECT l_orderkey, l_linenumber,
  CASE WHEN TRY_CAST(nullif(regexp_extract({BPM_TEXT_SQL}, '(?i)(\\d{{2,3}})\\s*BPM', 1), '') AS INTEGER) BETWEEN 80 AND 200
       THEN TRY_CAST(nullif(regexp_extract({BPM_TEXT_SQL}, '(?i)(\\d{{2,3}})\\s*BPM', 1), '') AS INTEGER) END AS bpm,
  nullif(regexp_extract({BPM_TEXT_SQL}, '(?i)([A-G](?:#|b)?\\s+(?:Major|Minor))', 1), '') AS "key"
FROM lineitem
""")
def number_and_pattern(spark, d):
    li = table(spark, d, "lineitem", spread=True)
    text = F.concat(F.col("l_returnflag"), F.lit(" "), (F.col("l_quantity") * 5).cast("int").cast("string"),
                    F.lit("BPM "), F.substring(F.lit("ABCDEFG"), F.col("l_linenumber"), F.lit(1)),
                    F.when(F.col("l_linestatus") == "O", "b").otherwise(""), F.lit(" minor"))
    return li.select("l_orderkey", "l_linenumber", pages.number_with_unit(text).alias("bpm"),
                     pages.pattern_extract(text).alias("key"))


# ---------------------------------------------------------------- O01 / O22 / O23 / O24 / O25 documents from events
def _event_docs(spark, d) -> DataFrame:
    return _event_docs_from(table(spark, d, "events", spread=True))


def _event_docs_from(e: DataFrame) -> DataFrame:
    """One JSON document per event, in the shapes snapshot files take:
    click = ``tracks`` list (second record has an empty title), view =
    ``playlist.tracks`` with an artist list, purchase = first record-like
    array field after a non-record one, signup = root array with rank 0,
    error = unreadable text."""
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    uid = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    k = F.col("k").cast("string")
    click = F.to_json(F.struct(F.lit("chart").alias("name"), F.array(
        F.struct(F.concat(F.lit("Track "), k).alias("title"), uid.alias("artist"), F.col("k").alias("rank"),
                 F.lit("").alias("genre")),
        F.struct(F.lit("").alias("title"), uid.alias("artist"), F.col("k").alias("rank"),
                 F.lit("x").alias("genre"))).alias("tracks")))
    view = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.concat(F.lit("View "), k).alias("track"), F.array(uid, F.lit("guest")).alias("artists"))).alias("tracks"))
        .alias("playlist")))
    purchase = F.to_json(F.struct(F.array(F.col("k")).alias("meta"), F.array(F.struct(
        F.concat(F.lit("Buy "), k, F.lit("!")).alias("name"), uid.alias("artist"), F.col("k").alias("position")))
        .alias("items")))
    signup = F.to_json(F.array(F.struct(F.concat(F.lit("  Hello "), k).alias("title"), uid.alias("artist"),
                                        F.lit(0).alias("rank"), F.col("k").alias("position"))))
    doc = (F.when(F.col("event_type") == "click", click).when(F.col("event_type") == "view", view)
            .when(F.col("event_type") == "purchase", purchase).when(F.col("event_type") == "signup", signup)
            .otherwise(F.concat(F.lit("not json "), F.col("event_id").cast("string"))))
    return e.select("event_id", doc.alias("json"),
                    F.concat(F.lit("events/"), F.date_format("ts", "yyyy/MM/dd"), F.lit(".json")).alias("source_file"))


DOCS_SQL = f"""
WITH e AS (SELECT event_id, event_type, 'user ' || user_id AS artist, CAST(props->>'k' AS INTEGER) AS k FROM events),
recs AS (
  SELECT event_id, 0 AS rec_pos, 'Track ' || k AS title, artist, CAST(nullif(k, 0) AS BIGINT) AS rank, '' AS genre
  FROM e WHERE event_type = 'click'
  UNION ALL SELECT event_id, 0, 'View ' || k, artist || ', guest', NULL, '' FROM e WHERE event_type = 'view'
  UNION ALL SELECT event_id, 0, 'Buy ' || k || '!', artist, CAST(k AS BIGINT), '' FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, 0, 'Hello ' || k, artist, CAST(k AS BIGINT), '' FROM e WHERE event_type = 'signup')
SELECT event_id, CAST(rec_pos AS INTEGER) AS rec_pos, title, artist, rank, genre, {S.key('artist', 'title')} AS track_id
FROM recs
"""


def _normalized_docs(spark, d) -> DataFrame:
    docs = records.locate_records(_event_docs(spark, d), "json")
    return records.normalize_records(docs)


@register("normalize_records", DOCS_SQL)
def normalize_records(spark, d):
    return _normalized_docs(spark, d).drop("source_file").select("event_id", "rec_pos", "title", "artist", "rank", "genre", "track_id")


@register("locate_records", """
SELECT event_id, CAST(rec_pos AS INTEGER) AS rec_pos FROM (
  SELECT event_id, unnest(CASE event_type WHEN 'click' THEN [0, 1] WHEN 'error' THEN [] ELSE [0] END) AS rec_pos
  FROM events)
""")
def locate_records(spark, d):
    return records.locate_records(_event_docs(spark, d).drop("source_file"), "json").select("event_id", "rec_pos")


@register("sparse_records", f"""
SELECT event_id, rec_pos, title, nullif(genre, '') AS genre FROM ({DOCS_SQL})
""")
def sparse_records(spark, d):
    n = _normalized_docs(spark, d).select("event_id", "rec_pos", "title", "genre")
    return records.sparse(n, ["genre"])


# ---------------------------------------------------------------- O02 / O03 / O01 snapshot files round trip
def _chart_docs(spark, d) -> DataFrame:
    """One snapshot document per monthly chart (<= 100 tracks, the chart size)."""
    chart = _chart(spark, d).withColumn(
        "track", F.struct(F.col("position"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("title"),
                          F.lit("orders chart").alias("artist"), F.col("o_custkey").cast("string").alias("beatport_id")))
    return (chart.groupBy("month")
                 .agg(F.array_sort(F.collect_list("track")).alias("tracks"))
                 .select(F.concat(F.lit("chart-"), F.col("month")).alias("playlist_id"),
                         F.lit("Monthly chart").alias("name"), F.size("tracks").alias("track_count"), "tracks",
                         F.to_timestamp(F.concat(F.col("month"), F.lit("-01"))).alias("created_at")))


def _written_charts(spark, d) -> str:
    from rankflow.session import work_dir
    from rankflow.sources.snapshots import write_snapshots
    path = work_dir(spark, "snapshots")
    write_snapshots(_chart_docs(spark, d), path, "created_at", source="chart")
    return path


@register("snapshot_roundtrip", f"""
SELECT month, CAST(position - 1 AS INTEGER) AS rec_pos, 'Customer ' || o_custkey AS title,
  'orders chart' AS artist, position AS rank, {S.key("'orders chart'", "'Customer ' || o_custkey")} AS track_id
FROM ({CHART_SQL})
""")
def snapshot_roundtrip(spark, d):
    from rankflow.sources.snapshots import read_snapshots
    path = _written_charts(spark, d)
    docs = read_snapshots(spark, path).withColumn(
        "month", F.concat(F.regexp_extract("path", r"year=(\d{4})", 1), F.lit("-"),
                          F.regexp_extract("path", r"month=(\d{2})", 1)))
    recs = records.normalize_records(records.locate_records(docs.drop("doc"), "json"))
    return recs.select("month", "rec_pos", "title", "artist", "rank", "track_id")


@register("list_snapshot_files", f"""
SELECT 'year=' || m[1] || '/month=' || m[2] || '/day=01/snapshot=chart-' || m[1] || m[2] || '01-000000' AS folder,
  'chart' AS source, CASE WHEN m[2] < '07' THEN 'first half' ELSE 'second half' END AS playlist_type,
  m[1] || '-' || m[2] || '-01T00:00:00' AS scraped_at, true AS whole, true AS same
FROM (SELECT DISTINCT string_split(month, '-') AS m FROM ({CHART_SQL}) WHERE month LIKE '1997-%')
""")
def list_snapshot_files(spark, d):
    from rankflow.session import work_dir
    from rankflow.sources.snapshots import list_snapshot_files as lsf, write_snapshots
    path = work_dir(spark, "snapshots")
    half = F.when(F.month("created_at") < 7, "first half").otherwise("second half")
    write_snapshots(_chart_docs(spark, d), path, "created_at", source="chart", playlist_type=half)
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.octet_length("value").alias("n"))
    below = lambda c: F.regexp_extract(c, "(year=.*)$", 1)
    files = lsf(spark, path, date_prefix="1997/")
    # sizes are those of the objects; the key is the end of the url
    return files.join(read.select(below("p").alias("_below"), "n"), below("url") == F.col("_below")).select(
        F.regexp_extract("key", "^(.*)/[^/]+$", 1).alias("folder"), F.col("metadata")["source"].alias("source"),
        F.col("metadata")["playlist-type"].alias("playlist_type"), F.col("metadata")["scraped-at"].alias("scraped_at"),
        (F.col("size") == F.col("n")).alias("whole"), F.col("url").endswith(F.col("key")).alias("same"))


# ---------------------------------------------------------------- O46, O50 - O53 streaming over the events files
STREAM_FILES = 3
#: rows of a file that are worth a task of their own
FILE_ROWS = 1000


def _arrivals(spark, rows: DataFrame, by: str = "user_id") -> DataFrame:
    """Rows that arrive in ``STREAM_FILES`` batches, each with rows of all times (so late ones too) and of as many files
    as keep the cluster's cores busy."""
    from rankflow.session import work_dir
    from rankflow.streaming import file_stream
    folder, n = work_dir(spark, "arrivals"), -(-rows.count() // STREAM_FILES)
    files = max(1, min(spark.sparkContext.defaultParallelism, -(-n // FILE_ROWS)), -(-n // TASK_ROWS))
    rows.repartition(STREAM_FILES * files, by).write.parquet(folder)
    return file_stream(spark, folder, rows.schema, glob="*.parquet", max_files=files)


def _events_stream(spark, d) -> DataFrame:
    return _arrivals(spark, table(spark, d, "events"))


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@register("stream_outcome_summary", f"""
SELECT count(*) FILTER (WHERE outcome = 'processed') AS processed,
  count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed
FROM ({NOTIFY_SQL})
""")
def stream_outcome_summary(spark, d):
    from rankflow.session import work_dir
    from rankflow.streaming import OutcomeCounts, notification_stream
    out, counts = work_dir(spark, "notifications"), OutcomeCounts()
    spark.streams.addListener(counts)
    try:
        _run(notification_stream(_arrivals(spark, _notifications(spark, d), "event_id"), counts, f"{out}/decoded", f"{out}/_checkpoint"))
        counts.wait(STREAM_FILES)
    finally:
        spark.streams.removeListener(counts)
    return counts.frame(spark).groupBy().agg(*[F.sum(c).alias(c) for c in ("processed", "skipped", "failed")])


def _ingested(spark, d) -> str:
    from rankflow.session import work_dir
    from rankflow.streaming import ingest_stream
    # known tracks: the content keys of what click events put in the catalogue
    out = work_dir(spark, "ingest")
    _catalog(spark, d, "track_id").write.parquet(f"{out}/known")
    _run(ingest_stream(_event_docs_from(_events_stream(spark, d)), f"{out}/known", out, f"{out}/_checkpoint", AS_OF))
    return out


@register("stream_ingest", f"""
SELECT event_id, rec_pos, track_id FROM ({DOCS_SQL})
WHERE track_id NOT IN (SELECT {S.key("'user ' || user_id", "'Track ' || (props->>'k')")} FROM events WHERE event_type = 'click')
""")
def stream_ingest(spark, d):
    out = _ingested(spark, d)
    return spark.read.parquet(f"{out}/records").select("event_id", "rec_pos", "track_id")


@register("stream_ingest_jobs", f"""
SELECT sha256(source_file) AS job_id, source_file, count(*) AS expected_count
FROM (SELECT 'events/' || strftime(e.ts, '%Y/%m/%d') || '.json' AS source_file
      FROM ({DOCS_SQL}) r JOIN events e USING (event_id)
      WHERE r.track_id NOT IN (SELECT {S.key("'user ' || user_id", "'Track ' || (props->>'k')")} FROM events WHERE event_type = 'click'))
GROUP BY source_file
""")
def stream_ingest_jobs(spark, d):
    out = _ingested(spark, d)
    from rankflow.streaming import job_table
    return job_table(spark, f"{out}/jobs").select("job_id", "source_file", "expected_count")


def _stream_outcomes(spark, d) -> DataFrame:
    """Classified outcomes of the message stream; purchase messages are
    delivered twice (at-least-once delivery)."""
    from rankflow.session import work_dir
    s = _events_stream(spark, d)
    copies = F.when(F.col("event_type") == "purchase", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    s = s.withColumn("_copy", F.explode(copies)).drop("_copy")
    folder = work_dir(spark, "catalogue")  # every batch looks it up
    _catalog(spark, d, "_cat_key").distinct().write.parquet(folder)
    return _classify_from(_messages_from(s), spark.read.parquet(folder))


@register("stream_dead_letters", f"""
SELECT event_id, job_id, error AS failure_reason FROM ({CLASSIFIED_SQL}) WHERE status = 'not_found'
""")
def stream_dead_letters(spark, d):
    from rankflow.session import work_dir
    from rankflow.streaming import dead_letter_stream
    out = work_dir(spark, "dead-letters")
    _run(dead_letter_stream(_stream_outcomes(spark, d), f"{out}/dlq", f"{out}/_checkpoint", AS_OF, id_col="event_id"))
    return spark.read.parquet(f"{out}/dlq").select("event_id", "job_id", "failure_reason")


@register("stream_tracks", f"""
WITH c AS ({CLASSIFIED_SQL}),
hits AS (SELECT {S.key("regexp_extract(track, ' - (.*)$', 1)", "regexp_extract(track, '^(.*) - ', 1)")} AS track_id,
                min('yt-' || event_id) AS vid
         FROM c WHERE status = 'success' GROUP BY 1),
b AS ({CUST_ALL_SQL})
SELECT coalesce(b.track_id, h.track_id) AS track_id,
  CASE WHEN b.track_id IS NULL OR (h.track_id IS NOT NULL AND b.youtube_video_id IS NULL) THEN h.vid
       ELSE b.youtube_video_id END AS youtube_video_id,
  CASE WHEN b.track_id IS NULL THEN 'ytmusic' ELSE b.source END AS source
FROM b FULL OUTER JOIN hits h ON h.track_id = b.track_id
""")
def stream_tracks(spark, d):
    from rankflow.session import work_dir
    from rankflow.streaming import current_table, file_stream, lookup_stream
    out = work_dir(spark, "lookup")
    base = _customer_tracks(spark, d, SEGMENTS).select(
        "track_id", "title", "artist", "youtube_video_id", "youtube_url", "source", "created_at", "updated_at")
    base.write.parquet(f"{out}/base")
    outcomes = (_stream_outcomes(spark, d)
                .withColumn("youtube_video_id", F.concat(F.lit("yt-"), F.col("event_id").cast("string")))
                .withColumn("youtube_url", F.concat(F.lit("https://music.example/watch?v=yt-"),
                                                    F.col("event_id").cast("string")))
                .withColumn("track_id", content_key("artist", "title")))
    tracks = file_stream(spark, f"{out}/base", base.schema, glob="*.parquet", max_files=None)
    _run(lookup_stream(outcomes, tracks, f"{out}/tracks", f"{out}/_checkpoint", AS_OF))
    return current_table(spark, f"{out}/tracks").select("track_id", "youtube_video_id", "source")


def _progressed(spark, d) -> str:
    from rankflow.session import work_dir
    from rankflow.streaming import JOB_SCHEMA, file_stream, progress_stream
    out = work_dir(spark, "progress")
    _event_jobs(spark, d).write.parquet(f"{out}/jobs")
    made = file_stream(spark, f"{out}/jobs", JOB_SCHEMA, glob="*.parquet", max_files=None)
    _run(progress_stream(_stream_outcomes(spark, d), made, f"{out}/progress", f"{out}/_progress", id_col="event_id"))
    return out


@register("stream_progress", f"""
SELECT job_id, count(*) FILTER (WHERE status IN ('success', 'not_found')) AS processed_count
FROM ({CLASSIFIED_SQL}) WHERE coalesce(job_id, '') <> '' GROUP BY job_id
""")
def stream_progress(spark, d):
    from rankflow.streaming import job_totals
    out = _progressed(spark, d)
    mentioned = _stream_jobs_mentioned(spark, d)
    return job_totals(spark, f"{out}/progress").join(mentioned, "job_id", "left_semi")


def _stream_jobs_mentioned(spark, d) -> DataFrame:
    """Jobs that an outcome names (the counters also hold jobs that wait for their first)."""
    return _classified(spark, d).where("coalesce(job_id, '') <> ''").select("job_id").distinct()


def _completed(spark, d) -> str:
    from rankflow.streaming import PROGRESS_SCHEMA, batches_of, completion_stream
    out = _progressed(spark, d)
    _run(completion_stream(batches_of(spark, f"{out}/progress", PROGRESS_SCHEMA, 16), f"{out}/completions",
                           f"{out}/_completions", AS_OF, bucket="charts-bucket"))
    return out


STREAM_DONE_SQL = f"""
SELECT j.job_id, j.source_file, j.user_id, j.day, j.expected_count, p.processed_count
FROM (SELECT 'job-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS job_id, user_id, strftime(ts, '%Y-%m-%d') AS day,
        'charts/' || strftime(ts, '%Y/%m/%d') || '/user-' || user_id || '.json' AS source_file, count(*) AS expected_count
      FROM events WHERE event_type <> 'signup' GROUP BY ALL) j
JOIN (SELECT job_id, count(*) FILTER (WHERE status IN ('success', 'not_found')) AS processed_count
      FROM ({CLASSIFIED_SQL}) WHERE coalesce(job_id, '') <> '' GROUP BY job_id) p USING (job_id)
WHERE p.processed_count >= j.expected_count AND p.processed_count > 0
"""


@register("stream_completions", f"SELECT job_id, expected_count, processed_count FROM ({STREAM_DONE_SQL})")
def stream_completions(spark, d):
    out = _completed(spark, d)
    return spark.read.parquet(f"{out}/completions").select("job_id", "expected_count", "processed_count")


def _job_snapshots(spark, d) -> DataFrame:
    """The stored snapshot of each user-day: its events in order, of which every fifth has no title and every seventh no
    track id.  Users divisible by 13 have none, and days of users divisible by 11 hold no tracks."""
    e = table(spark, d, "events", spread=True).where(F.col("event_type") != "signup")
    title = F.concat(F.lit("Track "), F.get_json_object("props", "$.k"))
    artist = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    one = F.struct("event_id", F.struct(
        F.when(F.col("event_id") % 5 == 0, "").otherwise(title).alias("title"), artist.alias("artist"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise(content_key(artist, title)).alias("track_id")).alias("t"))
    rows = e.where(F.col("user_id") % 13 != 0).groupBy("user_id", F.date_format("ts", "yyyy/MM/dd").alias("day")).agg(
        F.array_sort(F.collect_list(one)).alias("_t"))
    tracks = F.when(F.col("user_id") % 11 == 0, F.slice("_t", 1, 0)).otherwise(F.col("_t"))
    return rows.select(F.lit("charts-bucket").alias("bucket"),
                       F.concat(F.lit("charts/"), F.col("day"), F.lit("/user-"), F.col("user_id").cast("string"), F.lit(".json")).alias("key"),
                       F.to_json(F.struct(F.transform(tracks, lambda x: x["t"]).alias("tracks"))).alias("json"))


def _job_tracks(spark, d) -> DataFrame:
    """The tracks table: what click events put in it; those of users divisible by 3 wait for their video."""
    e = table(spark, d, "events", spread=True).where(F.col("event_type") == "click")
    title = F.concat(F.lit("Track "), F.get_json_object("props", "$.k"))
    artist = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    found = e.select(content_key(artist, title).alias("track_id"),
                     F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("v-"), F.get_json_object("props", "$.k"))).alias("youtube_video_id"))
    return found.distinct().withColumn("youtube_url", F.lit(None).cast("string"))


def _playlists(spark, d) -> str:
    from rankflow.streaming import COMPLETION_SCHEMA, batches_of, playlist_stream
    out = _completed(spark, d)
    _job_snapshots(spark, d).write.parquet(f"{out}/snapshots")
    _job_tracks(spark, d).write.parquet(f"{out}/tracks")
    stored = spark.read.parquet(f"{out}/snapshots")
    done = batches_of(spark, f"{out}/completions", COMPLETION_SCHEMA, 16)
    twice = done.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")  # two rules deliver each completion
    _run(playlist_stream(twice, lambda names: stored.join(names, ["bucket", "key"], "left_semi"), f"{out}/tracks",
                         f"{out}/made", f"{out}/_made", AS_OF))
    return f"{out}/made"


JOB_ROWS_SQL = f"""
WITH t AS (SELECT DISTINCT {S.key("'user ' || user_id", "'Track ' || (props->>'k')")} AS track_id,
             CASE WHEN user_id % 3 <> 0 THEN 'v-' || (props->>'k') END AS vid FROM events WHERE event_type = 'click'),
r AS (SELECT c.job_id, c.user_id, e.event_id, row_number() OVER (PARTITION BY c.job_id ORDER BY e.event_id) - 1 AS rec_pos,
        {S.key("'user ' || e.user_id", "'Track ' || (e.props->>'k')")} AS track_id
      FROM ({STREAM_DONE_SQL}) c JOIN events e ON e.user_id = c.user_id AND strftime(e.ts, '%Y-%m-%d') = c.day AND e.event_type <> 'signup'
      WHERE c.user_id % 13 <> 0 AND c.user_id % 11 <> 0),
x AS (SELECT r.*, t.vid, CASE WHEN event_id % 5 = 0 THEN 'missing title or artist' WHEN event_id % 7 = 0 THEN 'missing track_id'
        WHEN t.track_id IS NULL THEN 'track not found in database' WHEN t.vid IS NULL THEN 'youtube_video_id missing in database' END AS reason
      FROM r LEFT JOIN t USING (track_id))
"""


@register("stream_playlist_items", f"""{JOB_ROWS_SQL}
SELECT job_id, CAST(rec_pos AS INTEGER) AS rec_pos, reason, CASE WHEN reason IS NULL THEN vid END AS video_id,
  CASE WHEN reason IS NULL THEN CAST(count(*) FILTER (WHERE reason IS NULL) OVER (PARTITION BY job_id ORDER BY rec_pos) - 1 AS INTEGER) END AS position
FROM x
""")
def stream_playlist_items(spark, d):
    out = _playlists(spark, d)
    return spark.read.parquet(f"{out}/items").select("job_id", "rec_pos", "reason", "video_id", "position")


@register("stream_playlists", f"""{JOB_ROWS_SQL},
n AS (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS ok FROM x GROUP BY job_id),
j AS (SELECT c.*, n.total, n.ok, CASE WHEN c.user_id % 13 = 0 THEN 'Failed to download playlist data from S3'
        WHEN n.total IS NULL THEN 'No tracks found in playlist data' WHEN n.ok = 0 THEN 'No tracks with YouTube video IDs found in database' END AS error
      FROM ({STREAM_DONE_SQL}) c LEFT JOIN n USING (job_id))
SELECT job_id, error, total AS total_tracks_in_source, ok AS tracks_with_video_ids, ok AS videos_added_successfully,
  total - ok AS skipped_tracks,
  CASE WHEN error IS NULL THEN 'https://www.youtube.com/playlist?list=' || sha256(job_id) END AS playlist_url,
  CASE WHEN error IS NULL THEN 'Beatport Top 100 (2024-02-01)' END AS playlist_name,
  CASE WHEN error IS NULL THEN 'Automatically created playlist from job ' || job_id || ' completed on 2024-02-01 00:00. Source: ' || source_file END AS description
FROM j
""")
def stream_playlists(spark, d):
    out = _playlists(spark, d)
    return spark.read.parquet(f"{out}/playlists").select(
        "job_id", "error", "total_tracks_in_source", "tracks_with_video_ids", "videos_added_successfully", "skipped_tracks",
        "playlist_url", "playlist_name", "description")
