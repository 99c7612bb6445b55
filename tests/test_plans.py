"""Plan shape checks: no cartesian products, no row-at-a-time Python, pushdown and pruning."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

SQL = E.oracle_sql()


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_cartesian_or_python_udf(spark, name):
    p = plan_text(E.queries()[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p, f"{name} plans {bad}"


def test_records_prunes_columns_and_pushes_filters(spark):
    p = plan_text(E.queries()["risk_filter"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in p
    assert "PushedFilters: [IsNotNull(o_custkey)]" in p
    assert "supplier.parquet" not in p   # InternetAccess IN (1) removes the all-null source


def test_parquet_filter_reaches_scan(spark):
    p = plan_text(E.queries()["parquet_roundtrip_pruned"](spark, SF_SMALL))
    assert "EqualTo(GradeClass,4)" in p and "ReadSchema: struct<row_id:bigint,GPA:double,GradeClass:int>" in p


def test_split_window_is_chunked(spark):
    p = plan_text(E.queries()["stratified_split_test"](spark, SF_SMALL))
    # the ranking window is partitioned by (stratum, chunk)
    windows = [blk for blk in p.split("\n\n") if ") Window" in blk]
    assert windows and all("_chunk" in blk or "GradeClass" in blk for blk in windows)
