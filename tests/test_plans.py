"""Plan shapes that must hold at any data size."""

import re

import pytest

import __spark_entry__ as entry
from cashlens.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ACTIONS = {
    "fit_quantiles", "feature_importance", "forecast_cash", "fit_retry", "score_declines",
    "stream_to_ledger", "stream_removals", "stream_hourly_counts", "stream_daily_stats", "upsert_ledger_path", "followed_cash_position",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_and_no_unchecked_broadcasts(spark):
    """With automatic broadcasts off, only calendar-sized tables and top-k lists are still broadcast."""
    bounded = {"scale_to_targets", "scale_to_targets_floors", "cap_daily_spikes"}
    bounded |= {"high_risk_accounts", "aging_list", "scoring_rows"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, run in QUERIES.items():
            if name in ACTIONS:
                continue
            text = plan(run(spark, SF))
            assert "CartesianProduct" not in text, name
            assert "NestedLoopJoin" not in text, name
            assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name
            if name not in bounded:
                assert "BroadcastExchange" not in text, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def columns_read(df):
    return [m.group(1) for m in re.finditer(r"ReadSchema: struct<([^>]*)", df._jdf.queryExecution().toString())]


def test_scans_read_what_they_need(spark):
    queries = QUERIES
    assert columns_read(queries["daily_cash_position"](spark, SF)) == [
        "posted_date:date,status:string,fx_rate:double,net_amount:bigint,basis:string"
    ]
    text = plan(queries["daily_cash_position"](spark, SF))
    assert "EqualTo(basis,cash)" in text and "EqualTo(status,succeeded)" in text


@pytest.mark.parametrize("name", ["basis_check", "sales_and_collections", "range_totals", "read_ledger_range"])
def test_date_ranges_prune_months(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(entry.queries()[name](spark, SF))
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", text).group(1)
    assert "occurred_year" in filters and "occurred_month" in filters


def test_every_query_is_named_once():
    names, oracles = QUERIES, ORACLES
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(names) <= set(entry.queries()) and len(names) >= 150
    without = set(names) - set(oracles)
    assert without == ACTIONS - {
        "stream_to_ledger", "stream_removals", "stream_hourly_counts", "stream_daily_stats", "upsert_ledger_path", "followed_cash_position",
    }
