"""Shapes of the physical plans."""

import pytest

from __spark_entry__ import queries
from candlewick.plans import tables as T

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tech_features", "return_panel", "ewm_volatility", "latest_snapshot", "returns_fwd",
                                  "backtest_naive", "train_test_split"])
def test_no_single_partition_and_no_nested_loop(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "SinglePartition" not in text and "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["lookback_panel", "lookback_unaligned", "cross_corr_kendall", "cross_corr_pearson", "kde", "histogram"])
def test_no_pair_expansion(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_candles_aggregate_by_hash_and_read_four_columns(spark):
    text = plan(T.bars(spark, SF))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert "partial_min_by" in text and "props" not in text


def test_newest_row_is_picked_before_the_shuffle(spark):
    text = plan(queries()["latest_snapshot"](spark, SF))
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Partial")


def test_time_filter_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'").select("o_orderkey")
    assert "GreaterThanOrEqual(o_orderdate" in plan(df)


def test_numeric_queries_do_not_read_texts_for_post_times(spark):
    assert "text#" not in plan(queries()["lookback_unaligned"](spark, SF))


@pytest.mark.parametrize("name,bounds", [("time_range", ["GreaterThanOrEqual(ts,2024-01-10", "LessThan(ts,2024-01-20"]), ("latest_hours", ["GreaterThanOrEqual(ts,2024-01-2"]),
                                         ("history_and_forecast", ["GreaterThanOrEqual(ts,2024-01-1", "LessThan(ts,2024-01-25"]), ("price_range", ["GreaterThanOrEqual(ts,2024-01-1"])])
def test_times_of_registered_queries_reach_the_scan(spark, name, bounds):
    text = queries()[name](spark, SF)._jdf.queryExecution().toString()
    pushed = [p for p in text.split("PushedFilters: [")[1:]]
    assert pushed and all(b in text for b in bounds)
