"""Requests, validation and ordered playlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.variant import vfield, vtruthy, vtype
from rankflow.operators.ordinal import ordinal_in_group

# Fixed values used in request routing, messages and links.
ORCHESTRATOR_SOURCE = "music-search.orchestrator"
JOB_COMPLETED = "Job Completed"
PLAYLIST_URL = "https://www.youtube.com/playlist?list="
MUSIC_URL = "https://music.youtube.com/playlist?list="
DEFAULT_PLAYLIST_NAME = "Playlist from S3"
JOB_PLAYLIST_NAME = "Beatport Top 100 ({date})"


def route(df: DataFrame, json_col: str = "request") -> DataFrame:
    """``route`` = job_completed | location | direct_ids for playlist
    requests and ``lookup_route`` = batch | direct for lookup requests."""
    v = F.try_parse_json(F.col(json_col))
    is_job = (F.coalesce(F.try_variant_get(v, "$.source", "string") == ORCHESTRATOR_SOURCE, F.lit(False))
              & F.coalesce(F.try_variant_get(v, "$['detail-type']", "string") == JOB_COMPLETED, F.lit(False)))
    loc = vtruthy(vfield(v, "s3_bucket")) & vtruthy(vfield(v, "s3_key"))
    r = F.when(is_job, "job_completed").when(loc, "location").otherwise("direct_ids")
    batch = F.when(vfield(v, "Records").isNotNull(), "batch").otherwise("direct")
    return df.select("*", r.alias("route"), batch.alias("lookup_route"))


def first_failing(rules: list[tuple[Column, str]]) -> Column:
    """Reason of the first failing rule, NULL when all pass."""
    out = F.lit(None).cast("string")
    for failing, reason in reversed(rules):
        out = F.when(failing, F.lit(reason)).otherwise(out)
    return out


def validate(df: DataFrame, json_col: str = "request") -> DataFrame:
    """First failing input rule per routed request (``error``)."""
    v = F.try_parse_json(F.col(json_col))
    detail = vfield(v, "detail")
    ids = vfield(v, "video_ids")
    rules_job = [(~(vtruthy(vfield(detail, "s3_bucket")) & vtruthy(vfield(detail, "s3_key"))),
                  "Missing s3_bucket or s3_key in job completion event")]
    rules_direct = [(~vtruthy(vfield(v, "playlist_name")), "playlist_name is required"),
                    (~vtruthy(ids) | ~F.coalesce(vtype(ids).startswith("ARRAY"), F.lit(False)),
                     "video_ids array is required and cannot be empty")]
    rules_lookup = [(~(vtruthy(vfield(v, "title")) & vtruthy(vfield(v, "author"))), "Missing title or author")]
    err = (F.when(F.col("route") == "job_completed", first_failing(rules_job))
            .when(F.col("route") == "direct_ids", first_failing(rules_direct)))
    lookup_err = F.when(F.col("lookup_route") == "direct", first_failing(rules_lookup))
    return df.select("*", err.alias("error"), lookup_err.alias("lookup_error"))


def snapshot_tracks(objects: DataFrame, json_col: str = "json", pos_col: str = "rec_pos") -> DataFrame:
    """The rows of ``tracks`` of each stored document, in order, with ``title``, ``artist`` and ``track_id`` as the
    document has them.  Documents without such a list give no rows; a field that is no text counts as missing."""
    v = F.try_parse_json(F.col(json_col))
    keep = [c for c in objects.columns if c != json_col]
    rows = objects.select(*keep, F.posexplode(F.try_variant_get(v, "$.tracks", "array<variant>")).alias(pos_col, "_track"))
    return rows.select(*keep, pos_col, *[
        F.when(vtype(vfield("_track", c)) == "STRING", F.try_variant_get(vfield("_track", c), "$", "string")).alias(c)
        for c in ("title", "artist", "track_id")])


def playlist_items(enriched: DataFrame, group: list[str], order: list[str], value_col: str,
                   add_status: DataFrame | None = None, status_keys: list[str] | None = None) -> DataFrame:
    """0-based ``position`` of each value in its playlist, in source
    order; duplicates are kept and a failed add does not renumber the rest.

    ``add_status`` (keys + ``add_error``) models the external insert result:
    rows with an error are failures reported at ``position + 1``.  Positions
    come from ``ordinal_in_group``, so one huge playlist is numbered by many
    tasks.
    """
    items = ordinal_in_group(enriched, group, order, "position")
    if add_status is not None:
        items = items.join(add_status, on=status_keys, how="left")
    else:
        items = items.withColumn("add_error", F.lit(None).cast("string"))
    return (items.withColumn("added", F.col("add_error").isNull())
                 .withColumn("failed_position", F.when(F.col("add_error").isNotNull(), F.col("position") + 1)))


def playlist_summary(items: DataFrame, group: list[str], id_col: str | None = None) -> DataFrame:
    """O42 totals per playlist: source tracks, with ids, added, failed,
    skipped, and the playlist links.  Inputs are the O30 rows joined with O40."""
    agg = items.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_tracks_in_source"),
        F.count_if(F.col("status") == "enriched").alias("tracks_with_video_ids"),
        F.count_if(F.col("added") & (F.col("status") == "enriched")).alias("videos_added_successfully"),
        F.count_if(~F.col("added") & (F.col("status") == "enriched")).alias("failed_videos"),
        F.count_if(F.col("status") == "skipped").alias("skipped_tracks"))
    pid = F.col(id_col) if id_col else F.sha2(F.concat_ws("/", *[F.col(g).cast("string") for g in group]), 256)
    return (agg.withColumn("playlist_id", pid)
               .withColumn("playlist_url", F.concat(F.lit(PLAYLIST_URL), F.col("playlist_id")))
               .withColumn("music_url", F.concat(F.lit(MUSIC_URL), F.col("playlist_id"))))


def playlist_header(df: DataFrame, as_of, request_name: str | None = None, snapshot_name: str | None = None,
                    request_desc: str | None = None, snapshot_desc: str | None = None,
                    key_col: str = "s3_key", job_col: str | None = None) -> DataFrame:
    """O42 header: name (request -> snapshot -> constant) and description
    (request -> snapshot -> template); job-completion playlists get dated
    names and a job description."""
    day = F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd")
    minute = F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd HH:mm")

    def truthy(c):
        return F.col(c).isNotNull() & (F.col(c) != "") if c else F.lit(False)

    name = F.coalesce(F.when(truthy(request_name), F.col(request_name)) if request_name else F.lit(None),
                      F.col(snapshot_name) if snapshot_name else F.lit(None), F.lit(DEFAULT_PLAYLIST_NAME))
    desc = F.coalesce(F.when(truthy(request_desc), F.col(request_desc)) if request_desc else F.lit(None),
                      F.col(snapshot_desc) if snapshot_desc else F.lit(None),
                      F.concat(F.lit("Playlist created from "), F.col(key_col), F.lit(" on "), minute))
    if job_col:
        is_job = F.col(job_col).isNotNull()
        name = F.when(is_job, F.concat(F.lit("Beatport Top 100 ("), day, F.lit(")"))).otherwise(name)
        desc = F.when(is_job, F.concat(F.lit("Automatically created playlist from job "), F.col(job_col),
                                       F.lit(" completed on "), minute, F.lit(". Source: "), F.col(key_col))
                      ).otherwise(desc)
    return df.select("*", name.alias("playlist_name"), desc.alias("description"))


def playlist_from_ids(requests: DataFrame, name_col: str, ids_col: str, as_of,
                      desc_col: str | None = None, id_col: str | None = None,
                      failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, summary) for direct id-list requests.  Invalid requests
    get an ``error`` and no items; ``position`` is 0-based list order.

    ``id_col`` tells requests of one name apart and stays with their items.
    ``failed`` (``id_col``, ``position``, ``add_error``) has the adds that the
    service refused; items then say whether they were ``added``, and the
    summary counts ``videos_added_successfully`` and ``failed_videos``."""
    minute = F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd HH:mm")
    default_desc = F.concat(F.lit("Public playlist created on "), minute)
    err = (F.when(F.col(name_col).isNull() | (F.col(name_col) == ""), "playlist_name is required")
            .when(F.coalesce(F.size(ids_col), F.lit(0)) <= 0, "video_ids array is required and cannot be empty"))
    req = requests.withColumn("error", err).withColumn(
        "description", F.coalesce(F.col(desc_col), default_desc) if desc_col else default_desc)
    items = (req.where(F.col("error").isNull())
                .select(*([id_col] if id_col else []), name_col, F.posexplode(ids_col).alias("position", "video_id")))
    summary = req.select("*", F.when(F.col("error").isNull(), F.size(ids_col)).alias("total_videos_requested"))
    if failed is not None:
        items = (items.join(failed.select(id_col, "position", "add_error"), [id_col, "position"], "left")
                      .withColumn("added", F.col("add_error").isNull()))
        totals = items.groupBy(id_col).agg(F.count_if("added").alias("videos_added_successfully"),
                                           F.count_if(~F.col("added")).alias("failed_videos"))
        summary = summary.join(totals, id_col, "left")
    return items, summary


def validate_location(enriched: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """O28 for stored playlists: each request (``key``) with ``error`` where
    its document has no tracks, or none of them a video id, after enrichment
    (O30 rows carry ``key`` and ``status``)."""
    per = enriched.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") == "enriched").alias("_ok"))
    error = (F.when(F.coalesce("_n", F.lit(0)) == 0, "No tracks found in playlist data")
              .when(F.col("_ok") == 0, "No tracks with YouTube video IDs found in database"))
    return requests.join(per, key, "left").withColumn("error", error).drop("_n", "_ok")
