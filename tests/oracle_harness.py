"""Run a registered query in Spark and its SQL oracle in DuckDB, then compare
row count, column names and the order-insensitive multiset of values."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

from rankflow.plans.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _canon(v.asDict())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: repr(t))


def compare(spark_df, con, sql: str):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    info = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
            "cols_match": sorted(s_cols) == sorted(d_cols)}
    if not info["cols_match"]:
        info["spark_cols"], info["oracle_cols"] = sorted(s_cols), sorted(d_cols)
        info["ok"] = False
        return info
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    info["ok"] = a == b
    if not info["ok"]:
        sa, sb = set(a), set(b)
        info["only_spark"] = list(sa - sb)[:3]
        info["only_oracle"] = list(sb - sa)[:3]
    return info
