"""Variable-shape JSON documents -> normalised, keyed records.

All work is per row (no shuffle): documents are parsed once to VARIANT, the
record array is located with ordered key lists, and each record is exploded
with its 0-based position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, MapType, StructType, VariantType

from rankflow.functions.columns import where_once, with_columns_once
from rankflow.functions.text import content_key, py_strip
from rankflow.functions.variant import vfield, vfirst_truthy, vstr, vtruthy, vtype

NORMALISED_SOURCE = "chart-processor"


DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


def _looks_like_records(v: Column) -> Column:
    """A non-empty array whose first element is an object with a ``title`` or
    ``artist`` key (constant paths only, whatever the field is called)."""
    return (F.try_variant_get(v, "$[0].title", "variant").isNotNull()
            | F.try_variant_get(v, "$[0].artist", "variant").isNotNull())


def record_array(json_col: str | Column) -> Column:
    """``array<variant>`` of candidate records of one document, or NULL.

    Order of preference: key ``tracks`` (wins even when empty or not a list),
    ``playlist.tracks``, the first record-like array field in document order,
    a root array.  The document is parsed once; its fields are a map, so any
    field name works.  Of a repeated key the last value counts.
    """
    j = F.col(json_col) if isinstance(json_col, str) else json_col
    v = F.try_parse_json(j)
    t = F.schema_of_variant(v)
    is_obj = t.startswith("OBJECT")
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    tracks = F.try_variant_get(v, "$.tracks", "variant")
    playlist = F.try_variant_get(v, "$.playlist", "variant")
    ptype = F.schema_of_variant(playlist)
    playlist_tracks = F.try_variant_get(v, "$.playlist.tracks", "variant")
    # 'tracks' in <string or list> is true but indexing it fails -> no records
    playlist_blocks = (
        (ptype == "STRING") & F.coalesce(F.try_variant_get(playlist, "$", "string").contains("tracks"), F.lit(False))
    ) | (ptype.startswith("ARRAY") & F.coalesce(
        F.array_contains(F.try_variant_get(playlist, "$", "array<string>"), "tracks"), F.lit(False)))
    first = F.get(F.filter(F.json_object_keys(j), lambda k: _looks_like_records(F.try_element_at(fields, k))), 0)
    return (F.when(is_obj & tracks.isNotNull(), F.try_variant_get(tracks, "$", "array<variant>"))
            .when(is_obj & playlist_tracks.isNotNull(), F.try_variant_get(playlist_tracks, "$", "array<variant>"))
            .when(is_obj & playlist_blocks, F.lit(None))
            .when(is_obj, F.try_variant_get(F.try_element_at(fields, first), "$", "array<variant>"))
            .when(t.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")))


def locate_records(df: DataFrame, json_col: str, pos_col: str = "rec_pos",
                   rec_col: str = "record") -> DataFrame:
    """One row per candidate record with its 0-based position.

    Documents that are unreadable or hold no record array produce no rows.
    Repeated keys are read as ``json.loads`` does (a session setting of the
    parser, set here).
    """
    df.sparkSession.conf.set(DUPLICATE_KEYS, "true")
    keep = [c for c in df.columns if c != json_col]
    return df.select(*keep, F.posexplode(record_array(json_col)).alias(pos_col, rec_col))


def _typed(v: Column, sql_type: str) -> Column:
    return F.try_variant_get(v, "$", sql_type)


def normalize_records(df: DataFrame, rec_col: str = "record", source: str = NORMALISED_SOURCE) -> DataFrame:
    """O23 + O24: normalise schemaless records and attach the content key.

    Non-objects and records without a truthy title or artist are dropped.
    Field values are staged as columns first so each is extracted once.
    """
    r = F.col(rec_col)
    fields = ["title", "track", "name", "artist", "artists", "album", "genre", "label", "bpm", "key",
              "rank", "position", "rating", "release_date", "released", "beatport_url", "url", "beatport_id", "id"]
    x = df.where(vtype(r).startswith("OBJECT"))
    x = x.select("*", *[vfield(r, f).alias(f"_f_{f}") for f in fields])
    f = lambda n: F.col(f"_f_{n}")
    x = (x.withColumn("_title_v", vfirst_truthy(f("title"), f("track"), f("name")))
          .withColumn("_artist_v", vfirst_truthy(f("artist"), f("artists")))
          .withColumn("_rank_v", vfirst_truthy(f("rank"), f("position")))
          .withColumn("_rel_v", vfirst_truthy(f("release_date"), f("released")))
          .withColumn("_url_v", vfirst_truthy(f("beatport_url"), f("url")))
          .withColumn("_id_v", vfirst_truthy(f("beatport_id"), f("id"))))
    x = x.withColumn("_artist_list", vtype("_artist_v").startswith("ARRAY"))
    x = x.withColumn("_artist_joined", F.when(F.col("_artist_list"), F.array_join(
        F.transform(_typed(F.col("_artist_v"), "array<variant>"), lambda e: vstr(e)), ", ")))
    artist_ok = F.when(F.col("_artist_list"), F.coalesce(F.col("_artist_joined") != F.lit(""), F.lit(False))) \
                 .otherwise(vtruthy("_artist_v"))
    x = where_once(x, vtruthy("_title_v") & artist_ok)
    keep = [c for c in df.columns if c != rec_col]

    def default_empty(n: str):
        v = f(n)
        return F.when(v.isNull(), F.lit("")).when(F.is_variant_null(v), F.lit(None)).otherwise(vstr(v))

    out = with_columns_once(x, {
        "title": py_strip(vstr("_title_v")),
        "artist": py_strip(F.when(F.col("_artist_list"), F.col("_artist_joined")).otherwise(vstr("_artist_v"))),
        "album": default_empty("album"),
        "genre": default_empty("genre"),
        "label": default_empty("label"),
        "bpm": _typed(f("bpm"), "bigint"),
        "key": default_empty("key"),
        "rank": _typed(F.col("_rank_v"), "bigint"),
        "rating": _typed(f("rating"), "double"),
        "release_date": vstr("_rel_v"),
        "beatport_url": vstr("_url_v"),
        "beatport_id": vstr("_id_v"),
        "original_data": F.to_json(r),
        "source": F.lit(source),
    }, keep=keep)
    # computed above the generator: predicates on the key stop there
    return out.withColumn("track_id", content_key("artist", "title"))


def sparse(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Empty-string attributes become NULL (JSON writers then omit them)."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.select(*[F.when(F.col(c) == "", F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def _has_number(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_number(kind.elementType)
    if isinstance(kind, MapType):
        return _has_number(kind.valueType)
    if isinstance(kind, StructType):
        return any(_has_number(f.dataType) for f in kind.fields)
    return isinstance(kind, DecimalType | VariantType)


def plain_value(value: Column, kind: DataType) -> Column:
    """O26 for a value of any type: the same shape with every exact decimal a VARIANT number, whole (of any size) or
    a double.  Null structs, arrays and elements stay null, empty ones empty; keys of maps and types without
    decimals are left as they are.  In a VARIANT, whole numbers become whole and others stay exact (they print the
    same)."""
    if not _has_number(kind):
        return value
    if isinstance(kind, DecimalType):
        whole = value.cast("decimal(38,0)")
        number = F.when(F.abs(value) <= (1 << 63) - 1, whole.try_cast("bigint").cast("variant")).otherwise(whole.cast("variant"))
        return F.when(value % 1 == 0, number).when(value.isNotNull(), value.cast("double").cast("variant"))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: plain_value(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: plain_value(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[plain_value(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return F.try_parse_json(F.to_json(value))


def plain_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact decimals rendered as whole numbers (``<c>_int``) or as
    fractional doubles (``<c>_float``); exactly one of the two is set.  A struct,
    array, map or VARIANT column keeps its name and shape, with the decimals in
    it rendered at every depth (``plain_value``)."""
    out = df
    for c in cols:
        d, kind = F.col(c), df.schema[c].dataType
        if not isinstance(kind, DecimalType):
            out = out.withColumn(c, plain_value(d, kind))
            continue
        whole = (d % 1) == 0
        out = (out.withColumn(f"{c}_int", F.when(whole, d.cast("bigint")))
                  .withColumn(f"{c}_float", F.when(~whole, d.cast("double")))
                  .drop(c))
    return out
