"""Helpers over VARIANT values parsed from schemaless JSON records.

They give Python-dict semantics to SQL: a key can be absent (SQL NULL), present
with JSON null (variant null) or present with a value, and ``a or b`` chains
follow Python truthiness (None, '', 0, False, [], {} are false).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vfield(v, key: str) -> Column:
    """Value of top-level ``key`` as VARIANT; SQL NULL when the key is absent."""
    return F.try_variant_get(_c(v), f"$['{key}']", "variant")


def vtype(v) -> Column:
    return F.schema_of_variant(_c(v))


def vtruthy(v) -> Column:
    v = _c(v)
    t = vtype(v)
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(False))
            .when(t == "STRING", F.try_variant_get(v, "$", "string") != F.lit(""))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(t.startswith("ARRAY"), F.coalesce(
                F.size(F.try_variant_get(v, "$", "array<variant>")) > 0, F.lit(False)))
            .when(t.startswith("OBJECT"), F.coalesce(
                F.size(F.json_object_keys(F.to_json(v))) > 0, F.lit(False)))
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True))))


def vstr(v) -> Column:
    """``str(value)`` for a JSON value; JSON spelling for lists and objects."""
    v = _c(v)
    t = vtype(v)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(F.is_variant_null(v), F.lit("None"))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False"))
            .when(t.startswith("ARRAY") | t.startswith("OBJECT"), F.to_json(v))
            .otherwise(F.try_variant_get(v, "$", "string")))


def vfirst_truthy(*vals) -> Column:
    """Python ``a or b or c``: first truthy value, else the last one."""
    out = vals[-1]
    for v in reversed(vals[:-1]):
        out = F.when(vtruthy(v), v).otherwise(out)
    return out
