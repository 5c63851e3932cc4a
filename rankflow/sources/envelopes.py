"""Message envelopes: arrival notifications, fan-out messages.

Envelopes are JSON strings inside JSON strings.  Each level is parsed with
``try_parse_json`` (bad JSON -> NULL, never an exception) and classified with
``when`` chains, so a malformed record becomes an outcome row instead of a
failed task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.columns import with_columns_once
from rankflow.functions.text import py_isoformat, py_strip
from rankflow.functions.variant import vfield, vstr, vtruthy, vtype

QUEUE_SOURCE = "aws:sqs"
STORE_SOURCE = "aws:s3"
MESSAGE_ACTION = "process_new_track"


def unquote_plus(c: Column) -> Column:
    """Plus signs and valid ``%XX`` escapes decoded; everything else stays."""
    return F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _is_obj(v: Column) -> Column:
    return F.coalesce(vtype(v).startswith("OBJECT"), F.lit(False))


def _has_key(v: Column, k: str) -> Column:
    return vfield(v, k).isNotNull()


def decode_notifications(df: DataFrame, body_col: str = "body", source_col: str = "eventSource",
                         subscription_only: bool = False) -> DataFrame:
    """Queue records -> one row per storage event with ``outcome``.

    outcome: ``processed`` (bucket and key decoded), ``skipped`` (not a queue
    record, unreadable body, not a storage event, malformed location) or
    ``failed`` (body or event of the wrong JSON type).  A queue record whose
    body holds no events yields no row.  ``subscription_only`` also applies the
    bucket subscription (``ObjectCreated:*`` and ``.json`` keys).
    """
    df0 = df
    df = df.withColumn("_b", F.try_parse_json(F.col(body_col)))
    b = F.col("_b")
    level1 = (F.when(F.coalesce(F.col(source_col) != QUEUE_SOURCE, F.lit(True)), "skipped")
               .when(b.isNull(), "skipped")
               .when(~_is_obj(b), "failed"))
    recs = F.coalesce(F.try_variant_get(b, "$.Records", "array<variant>"), F.array())
    items = F.when(level1.isNotNull(),
                   F.array(F.struct(F.lit(None).cast("variant").alias("r"), level1.alias("o"))))\
             .otherwise(F.transform(recs, lambda r: F.struct(r.alias("r"), F.lit(None).cast("string").alias("o"))))
    keep = [c for c in df0.columns]
    x = df.select(*keep, F.posexplode(items).alias("event_pos", "_it"))
    x = x.withColumn("_r", F.col("_it.r")).withColumn("_s3", vfield("_it.r", "s3"))
    x = (x.withColumn("_bucket", F.coalesce(vfield("_s3", "bucket"), F.parse_json(F.lit("{}"))))
          .withColumn("_obj", F.coalesce(vfield("_s3", "object"), F.parse_json(F.lit("{}")))))
    r, s3, bucket, obj = F.col("_r"), F.col("_s3"), F.col("_bucket"), F.col("_obj")
    valid = _is_obj(s3) & _is_obj(bucket) & _is_obj(obj) & _has_key(bucket, "name") & _has_key(obj, "key")
    es = F.try_variant_get(r, "$.eventSource", "string")
    outcome = F.coalesce(F.col("_it.o"),
                         F.when(~_is_obj(r), "failed")
                          .when(F.coalesce(es != STORE_SOURCE, F.lit(True)) | s3.isNull(), "skipped")
                          .when(~valid, "skipped")
                          .otherwise("processed"))
    key_raw = vstr(vfield(obj, "key"))
    out = x.select(*keep, "event_pos", outcome.alias("outcome"),
                   F.when(outcome == "processed", vstr(vfield(bucket, "name"))).alias("bucket"),
                   F.when(outcome == "processed", unquote_plus(key_raw)).alias("key"),
                   F.try_variant_get(r, "$.eventName", "string").alias("event_name"))
    if subscription_only:
        out = out.where((F.col("outcome") != "processed") | (
            F.col("event_name").startswith("ObjectCreated:") & F.col("key").endswith(".json")))
    return out


def outcome_summary(decoded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Processed / skipped / failed counts per batch."""
    by = by or []
    return decoded.groupBy(*by).agg(
        F.count_if(F.col("outcome") == "processed").alias("processed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"))


def _field_str(track: Column, k: str) -> Column:
    """``track.get(k, '').strip()``: '' when absent, NULL marks a non-string."""
    v = vfield(track, k)
    return F.when(v.isNull(), F.lit("")).when(vtype(v) == "STRING", py_strip(F.try_variant_get(v, "$", "string")))


def decode_messages(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Queue body -> topic envelope -> message -> track fields.

    ``message_state``: ``ok``; ``no_message`` / ``no_track`` (the reference
    emits nothing for these); ``undecodable`` (any level unreadable or of the
    wrong type, including an explicit null title/artist/track_id).

    Each level is parsed once into its own column so the generated code stays
    small (one parse per level, not one per reference).
    """
    x = df.withColumn("_b", F.try_parse_json(F.col(body_col)))
    x = x.withColumn("_msg", vfield("_b", "Message"))
    x = x.withColumn("_s", F.try_parse_json(F.try_variant_get("_msg", "$", "string")))
    x = x.withColumn("_track", vfield("_s", "track"))
    x = (x.withColumn("_title", _field_str(F.col("_track"), "title"))
          .withColumn("_artist", _field_str(F.col("_track"), "artist"))
          .withColumn("_tid", _field_str(F.col("_track"), "track_id"))
          .withColumn("_job", vfield("_s", "job_id")))
    state = (F.when(F.col("_b").isNull() | ~_is_obj(F.col("_b")), "undecodable")
              .when(F.col("_msg").isNull(), "no_message")
              .when(vtype("_msg") != "STRING", "undecodable")
              .when(F.col("_s").isNull() | ~_is_obj(F.col("_s")), "undecodable")
              .when(~vtruthy("_track"), "no_track")
              .when(~_is_obj(F.col("_track")), "undecodable")
              .when(F.col("_title").isNull() | F.col("_artist").isNull() | F.col("_tid").isNull(), "undecodable")
              .otherwise("ok"))
    x = x.withColumn("_state", state)
    ok = F.col("_state") == "ok"
    return with_columns_once(x, {
        "message_state": F.col("_state"),
        "job_id": F.when(F.is_variant_null("_job"), F.lit(None)).otherwise(vstr("_job")),
        "title": F.when(ok, F.col("_title")),
        "artist": F.when(ok, F.col("_artist")),
        "track_id": F.when(ok, F.col("_tid")),
        "source_file": vstr(vfield("_s", "source_file")),
    }, keep=df.columns)


def build_messages(df: DataFrame, source_col: str, job_col: str, as_of,
                   track_cols: list[str] | None = None) -> DataFrame:
    """One fan-out message per new record: JSON body, subject, attributes."""
    track_cols = track_cols or [c for c in df.columns if c not in (source_col, job_col)]
    ts = py_isoformat(F.lit(as_of))
    # null fields stay in the message, as the reference's writer keeps them
    body = F.to_json(F.struct(
        F.struct(*[F.col(c) for c in track_cols]).alias("track"),
        F.col(source_col).alias("source_file"),
        F.col(job_col).alias("job_id"),
        ts.alias("timestamp"),
        F.lit(MESSAGE_ACTION).alias("action")), {"ignoreNullFields": "false"})
    title = F.coalesce(F.col("title").cast("string"), F.lit("Unknown")) if "title" in df.columns else F.lit("Unknown")
    artist = F.coalesce(F.col("artist").cast("string"), F.lit("Unknown")) if "artist" in df.columns else F.lit("Unknown")
    subject = py_strip(F.substring(F.concat(F.lit("New track: "), title, F.lit(" - "), artist), 1, 100))
    tid = F.coalesce(F.col("track_id"), F.lit("unknown")) if "track_id" in df.columns else F.lit("unknown")
    attrs = F.create_map(
        F.lit("source_file"), F.col(source_col).cast("string"),
        F.lit("job_id"), F.coalesce(F.nullif(F.col(job_col).cast("string"), F.lit("")), F.lit("unknown")),
        F.lit("track_id"), tid,
        F.lit("track_title"), title,
        F.lit("track_artist"), artist)
    return df.select("*", body.alias("message"), subject.alias("subject"), attrs.alias("attributes"))
