"""O22 / O23 / O25 / O26 on inline documents (FIXTURES §3)."""

import json
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from rowtools import rows
from rankflow.operators.records import locate_records, normalize_records, plain_numbers, sparse

DOCS = [
    (1, '{"name":"x","tracks":[{"title":"T1","artist":"A","rank":0,"position":4},'
        ' 5, {"title":"   ","artist":["a","b"]}, {"title":"T3","artist":[]}]}'),
    (2, '{"playlist":{"tracks":[{"track":"T2","artists":["p", 2]}]}}'),
    (3, '[{"name":"Root","artist":"R","rank":null,"position":7}]'),
    (4, '{"z":[{"x":1}],"b":[{"artist":"B","title":"bb"}],"a":[{"title":"aa","artist":"A"}]}'),
    (5, '{"tracks":[]}'), (6, 'broken {'), (7, '42'),
    (8, '{"tracks":null,"a":[{"title":"q","artist":"w"}]}'),
    (9, '{"items":[{"title":"t","artist":"x","album":null,"genre":"g","url":"u","id":7}]}'),
]


def test_locate(spark):
    df = spark.createDataFrame(DOCS, "doc long, json string")
    got = rows(locate_records(df, "json"), "doc", "rec_pos")
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (3, 0), (4, 0), (9, 0)]


def test_normalize(spark):
    df = spark.createDataFrame(DOCS, "doc long, json string")
    out = normalize_records(locate_records(df, "json"))
    got = {(r.doc, r.rec_pos): r for r in out.collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 0), (3, 0), (4, 0), (9, 0)}
    assert got[(1, 0)].rank == 4                       # rank 0 is falsy -> position
    assert got[(1, 2)].title == "" and got[(1, 2)].artist == "a, b"   # blank title survives here
    assert got[(2, 0)].title == "T2" and got[(2, 0)].artist == "p, 2"
    assert got[(3, 0)].rank == 7 and got[(3, 0)].title == "Root"
    assert got[(4, 0)].title == "bb"                   # first record-like field in document order
    r9 = got[(9, 0)]
    assert r9.album is None and r9.genre == "g" and r9.label == ""   # null vs absent
    assert r9.beatport_url == "u" and r9.beatport_id == "7" and r9.source == "chart-processor"


def test_sparse_and_plain_numbers(spark):
    df = spark.createDataFrame([("", "x", Decimal("3.00")), ("a", None, Decimal("2.50"))],
                               "a string, b string, n decimal(10,2)")
    s = sparse(df, ["a", "b"]).collect()
    assert s[0].a is None and s[1].b is None
    p = plain_numbers(df, ["n"]).collect()
    assert (p[0].n_int, p[0].n_float) == (3, None) and (p[1].n_int, p[1].n_float) == (None, 2.5)


def test_any_field_name_and_repeated_keys(spark):
    docs = ['{"a": 1, "dj\'s picks": [{"title": "t1", "artist": "x"}]}',
            '{"tracks": [{"title": "old", "artist": "x"}], "tracks": [{"title": "new", "artist": "x"}]}',
            '{"x": [1], "b.c[0]": [{"artist": "y", "title": "t3"}], "a": [{"title": "later", "artist": "z"}]}',
            '{"tracks": "none", "other": [{"title": "no"}]}']
    df = spark.createDataFrame(list(enumerate(docs)), "doc int, json string")
    got = normalize_records(locate_records(df, "json"))
    assert rows(got, "doc", "title") == [(0, "t1"), (1, "new"), (2, "t3")]


def _plain(x):
    """The reference's rule on Python values."""
    if isinstance(x, Decimal):
        with localcontext(prec=60):
            return int(x) if x % 1 == 0 else float(x)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [_plain(v) for v in x]
    return x


def test_plain_numbers_at_every_depth(spark):
    D = Decimal
    schema = ("id int, a array<decimal(10,2)>, s struct<x:decimal(38,2),y:struct<z:array<map<string,decimal(20,5)>>,t:string>>, "
              "m map<string,array<decimal(10,0)>>, keep array<int>")
    data = [(1, [D("1.00"), D("2.50"), None], {"x": D("3.00"), "y": {"z": [{"k": D("0.10000"), "w": D("-7.00000")}, {}], "t": "u"}},
             {"p": [D("4")], "e": []}, [1, 2]),
            (2, [], {"x": D("123456789012345678901234567890.00"), "y": None}, {}, []),
            (3, None, None, None, None),
            (4, [D("-0.01")], {"x": None, "y": {"z": None, "t": None}}, {"n": None}, [None])]
    df = spark.createDataFrame(data, schema)
    got = {r[0]: json.loads(r[1]) for r in plain_numbers(df, ["a", "s", "m", "keep"]).select(
        "id", F.to_json(F.struct("a", "s", "m", "keep"), {"ignoreNullFields": "false"})).collect()}
    for r in data:
        want = json.loads(json.dumps(_plain(dict(zip(("a", "s", "m", "keep"), r[1:], strict=True)))))
        assert got[r[0]] == want
        assert json.dumps(got[r[0]], sort_keys=True) == json.dumps(want, sort_keys=True)  # 3 is not 3.0
    assert plain_numbers(df, ["keep"]).schema["keep"] == df.schema["keep"]


def test_plain_numbers_of_a_variant(spark):
    df = spark.createDataFrame([('{"a":1.00,"b":[2.50,{"c":-3.0}],"d":"4.00","e":null,"f":[]}',), ("null",), (None,)], "j string")
    out = plain_numbers(df.select(F.try_parse_json("j").alias("v")), ["v"]).select(F.to_json("v")).collect()
    assert [r[0] for r in out] == ['{"a":1,"b":[2.5,{"c":-3}],"d":"4.00","e":null,"f":[]}', "null", None]
