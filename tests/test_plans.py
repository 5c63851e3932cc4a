"""Physical-plan guards for every registered query (sf0.001)."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from rankflow.plans.bindings import QUERIES

SF = "/root/testdata/sf0.001"
# these run a stream or write files when called; their returned plans are plain reads
SIDE_EFFECTS = {"snapshot_roundtrip", "list_snapshot_files"}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas"]


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_") and n not in SIDE_EFFECTS))
def test_no_cross_products_or_python(spark, name):
    text = plan(E.queries()[name](spark, SF))
    for op in FORBIDDEN:
        assert op not in text, f"{name}: {op}"


def test_point_get_is_pushed_down(spark):
    text = plan(E.queries()["get_by_key"](spark, SF))
    assert "EqualTo(o_orderkey,7)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_chart_top_k_limits_before_shuffle(spark):
    assert "WindowGroupLimit" in plan(E.queries()["chart_top5"](spark, SF))


def test_retention_has_no_window(spark):
    text = plan(E.queries()["retain_versions"](spark, SF))
    assert "Window" not in text and "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in text


@pytest.mark.parametrize("name", ["new_records", "enrich", "lookup_by_content", "lookup_exact", "patch", "fill_all"])
def test_keyed_lookups_force_no_broadcast(spark, name):
    """The initial plan joins by shuffle; only AQE may broadcast, by measured bytes."""
    text = plan(E.queries()[name](spark, SF)).split("== Initial Plan ==")[-1]
    assert "BroadcastExchange" not in text and "SinglePartition" not in text
