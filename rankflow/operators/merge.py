"""Keyed table mutation without a table format.

Each operator is one join that produces the next version of the table plus an
``action`` column; callers write the result as a new Parquet version.  ``as_of`` replaces wall-clock now
so reruns give identical output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.text import content_key, truthy_str

# The attributes a track update may set, in the reference's order.
UPDATABLE_FIELDS = [
    "title", "artist", "album", "genre", "rating", "rank", "bpm",
    "key", "label", "release_date", "beatport_url", "youtube_video_id",
    "youtube_url", "source", "metadata",
]

TRACK_SCHEMA = [
    ("track_id", "string"), ("created_at", "timestamp"), ("updated_at", "timestamp"),
    ("title", "string"), ("artist", "string"), ("album", "string"), ("genre", "string"),
    ("rating", "double"), ("rank", "bigint"), ("bpm", "bigint"), ("key", "string"),
    ("label", "string"), ("release_date", "string"), ("beatport_url", "string"),
    ("youtube_video_id", "string"), ("youtube_url", "string"), ("source", "string"),
    ("metadata", "string"),
]


def _col_or_null(df: DataFrame, name: str, typ: str) -> Column:
    return F.col(name).cast(typ) if name in df.columns else F.lit(None).cast(typ)


def insert_with_defaults(df: DataFrame, as_of, default_source: str = "beatport",
                         id_col: str | None = None) -> DataFrame:
    """Rows shaped as tracks, with created_at = updated_at = as_of,
    ``source`` defaulting to ``beatport`` and empty strings dropped (NULL).

    The id is the content key of (artist, title) unless ``id_col`` is given,
    so a rerun writes the same ids and later lookups by content find them.
    """
    ts = F.lit(as_of).cast("timestamp")
    cols = []
    for name, typ in TRACK_SCHEMA:
        if name == "track_id":
            continue
        if name in ("created_at", "updated_at"):
            c = ts
        elif name == "source":
            c = F.coalesce(_col_or_null(df, name, typ), F.lit(default_source))
        else:
            c = _col_or_null(df, name, typ)
        if typ == "string":
            c = F.when(c == "", F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(name))
    body = df.select(*cols)
    if id_col:
        body = df.select(F.col(id_col).alias("track_id"), *cols)
    else:
        body = body.withColumn("track_id", content_key("artist", "title"))
    return body.select(*[n for n, _ in TRACK_SCHEMA])


def patch(base: DataFrame, updates: DataFrame, key: str, allowed: list[str] | None = None,
          present_col: str = "present", as_of=None, order_col: str | None = None) -> DataFrame:
    """Apply partial updates; only fields named in ``present_col`` (an
    array of names) and in ``allowed`` change, a present NULL overwrites, and
    ``updated_at`` becomes ``as_of``.  Keys not in ``base`` insert nothing.
    Several patches for one key are applied one after another in the order of
    ``order_col`` (needed then; without it a repeated key is an error): each
    field takes its last patch that names it, one partial ``max_by`` a field.
    Output: the next table version with ``action`` (updated / unchanged)."""
    allowed = allowed or UPDATABLE_FIELDS
    settable = [c for c in allowed if c in base.columns and c in updates.columns]
    order = F.col(order_col) if order_col else F.lit(0)
    last = [F.max_by(F.struct(F.col(c).alias("v")), F.when(F.array_contains(F.col(present_col), c), order))
            .alias(f"_u_{c}") for c in settable]
    u = updates.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_u_key")).agg(F.count(F.lit(1)).alias("_u_n"), *last)
    if not order_col:
        u = u.withColumn("_u_key", F.when(F.col("_u_n") > 1, F.raise_error(
            F.lit("patch: several patches for one key need order_col")).cast("string"))
            .otherwise(F.col("_u_key").cast("string")).cast(base.schema[key].dataType))
    j = base.join(u, F.col(key) == F.col("_u_key"), "left")
    hit = F.col("_u_key").isNotNull()
    out = []
    for c in base.columns:
        if c in settable:
            out.append(F.when(F.col(f"_u_{c}").isNotNull(), F.col(f"_u_{c}.v")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and as_of is not None:
            out.append(F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    out.append(F.when(hit, "updated").otherwise("unchanged").alias("action"))
    return j.select(*out)


def patch_report(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """O37 status per update: ``updated`` or ``not_found`` (no insert)."""
    keys = base.select(F.col(key).alias("_b_key"))
    return (updates.join(keys, F.col(key) == F.col("_b_key"), "left")
                   .withColumn("status", F.when(F.col("_b_key").isNull(), "not_found").otherwise("updated"))
                   .drop("_b_key"))


def upsert_if_missing(base: DataFrame, hits: DataFrame, key: str = "track_id",
                      fill: dict[str, str] | None = None, as_of=None, insert_cols: dict[str, str] | None = None,
                      insert_source: str = "ytmusic", order_col: str | None = None,
                      guard_falsy: bool = False) -> DataFrame:
    """Conditional upsert in one full outer join.

    * key in base, fill attribute absent (NULL) -> set fill columns, ``updated``
    * key in base, attribute present (even '')  -> ``unchanged``
    * key only in hits                           -> new sparse row, ``inserted``
    * key only in base                           -> carried over, ``untouched``

    ``fill`` maps table column -> hit column; ``insert_cols`` adds the extra
    table columns an insert sets.  Several hits on one key behave as if applied
    in ``order_col`` order: the first one decides.  ``guard_falsy`` also
    treats '' as missing (O39's rule).
    """
    fill = fill or {"youtube_video_id": "youtube_video_id", "youtube_url": "youtube_url"}
    insert_cols = insert_cols or {}
    ts = F.lit(as_of).cast("timestamp")
    hit_cols = sorted(set(fill.values()) | set(insert_cols.values()))
    order = F.col(order_col) if order_col else F.col(list(fill.values())[0])
    h = (hits.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
             .groupBy(F.col(key).alias("_h_key"))
             .agg(F.min_by(F.struct(*[F.col(c).alias(c) for c in hit_cols]), order).alias("_h")))
    guard = list(fill.keys())[0]
    j = base.join(h, F.col(key) == F.col("_h_key"), "full_outer")
    in_base = F.col(key).isNotNull()
    in_hits = F.col("_h_key").isNotNull()
    missing = ~truthy_str(guard) if guard_falsy else F.col(guard).isNull()
    action = (F.when(in_base & in_hits & missing, "updated")
               .when(in_base & in_hits, "unchanged")
               .when(in_hits, "inserted")
               .otherwise("untouched"))
    j = j.withColumn("action", action)
    out = []
    for c in base.columns:
        if c == key:
            out.append(F.coalesce(F.col(key), F.col("_h_key")).alias(key))
        elif c in fill:
            out.append(F.when(F.col("action").isin("updated", "inserted"), F.col(f"_h.{fill[c]}"))
                        .otherwise(F.col(c)).alias(c))
        elif c in insert_cols:
            out.append(F.when(F.col("action") == "inserted", F.col(f"_h.{insert_cols[c]}"))
                        .otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("action").isin("updated", "inserted"), ts).otherwise(F.col(c)).alias(c))
        elif c == "created_at":
            out.append(F.when(F.col("action") == "inserted", ts).otherwise(F.col(c)).alias(c))
        elif c == "source":
            out.append(F.when(F.col("action") == "inserted", F.lit(insert_source)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    out.append(F.col("action"))
    return j.select(*out)


def fill_by_content(base: DataFrame, hits: DataFrame, as_of, key: str = "track_id",
                    q_title: str = "title", q_artist: str = "artist",
                    c_title: str = "match_title", c_artist: str = "match_artist",
                    value: str = "youtube_video_id", url: str = "youtube_url",
                    order_col: str | None = None) -> DataFrame:
    """Fill-if-missing by derived key.

    The query's (title, artist) key is looked up; a row without a value
    (NULL or '') is filled, one with a value is kept.  A miss inserts a row
    keyed by the *catalogue's* title/artist, unless that key already exists.
    Output: the next table version with ``action``.
    """
    h = (hits.withColumn("_k1", content_key(q_artist, q_title))
             .withColumn("_k2", content_key(c_artist, c_title)))
    base_keys = base.select(F.col(key).alias("_bk"), F.col(value).alias("_bval"))
    probed = h.join(base_keys, F.col("_k1") == F.col("_bk"), "left")
    # Hits whose query key exists: fill when the stored value is falsy.
    fills = (probed.where(F.col("_bk").isNotNull())
                   .select(F.col("_k1").alias(key), F.col(value).alias("_fv"), F.col(url).alias("_fu"),
                           *( [F.col(order_col)] if order_col else [])))
    # Misses insert under the catalogue key when that key is new.
    misses = (probed.where(F.col("_bk").isNull())
                    .select(F.col("_k2").alias(key), F.col(c_title).alias("title"), F.col(c_artist).alias("artist"),
                            F.col(value).alias("_fv"), F.col(url).alias("_fu"),
                            *( [F.col(order_col)] if order_col else [])))
    updated = upsert_if_missing(base, fills, key=key, fill={value: "_fv", url: "_fu"}, as_of=as_of,
                                order_col=order_col, guard_falsy=True).where(F.col("action") != "inserted")
    updated = updated.withColumn("action", F.when(F.col("action") == "unchanged", "kept").otherwise(F.col("action")))
    new_keys = misses.join(base.select(F.col(key).alias("_ek")), F.col(key) == F.col("_ek"), "left_anti")
    order = F.col(order_col) if order_col else F.col("_fv")
    ins = (new_keys.groupBy(key)
                   .agg(F.min_by(F.struct("title", "artist", "_fv", "_fu"), order).alias("_i"))
                   .select(key, F.col("_i.title").alias("title"), F.col("_i.artist").alias("artist"),
                           F.col("_i._fv").alias(value), F.col("_i._fu").alias(url)))
    ts = F.lit(as_of).cast("timestamp")
    ins_rows = ins.select(*[
        (F.col(c) if c in (key, "title", "artist", value, url) else
         ts.alias(c) if c in ("created_at", "updated_at") else
         F.lit("ytmusic").alias(c) if c == "source" else
         F.lit(None).cast(base.schema[c].dataType).alias(c))
        for c in base.columns], F.lit("inserted").alias("action"))
    return updated.unionByName(ins_rows)


def fill_all(base: DataFrame, updates: DataFrame, cols: list[str], fill: dict[str, str], as_of=None) -> DataFrame:
    """Every base row equal on ``cols`` whose first fill column is falsy
    gets the update; ``matched`` marks every row that matched (the count the
    reference returns), filled or not.  One update per value tuple (the first
    by the fill value) is applied."""
    guard = list(fill.keys())[0]
    u = (updates.groupBy(*cols)
                .agg(F.min_by(F.struct(*[F.col(v).alias(v) for v in sorted(set(fill.values()))]),
                              F.col(list(fill.values())[0])).alias("_u")))
    u = u.select(*[F.col(c).alias(f"_u_{c}") for c in cols], "_u")
    cond = None
    for c in cols:
        e = F.col(c) == F.col(f"_u_{c}")
        cond = e if cond is None else cond & e
    j = base.join(u, cond, "left")
    matched = F.col(f"_u_{cols[0]}").isNotNull()
    do_fill = matched & ~truthy_str(guard)
    out = []
    for c in base.columns:
        if c in fill:
            out.append(F.when(do_fill, F.col(f"_u.{fill[c]}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and as_of is not None:
            out.append(F.when(do_fill, F.lit(as_of).cast("timestamp")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out, matched.alias("matched"), do_fill.alias("filled"))
