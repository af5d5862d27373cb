"""Plans at scale: what must not appear once nothing is small enough to broadcast."""

from __future__ import annotations

import re

import pytest

from salesloom.functions.text import present
from salesloom.operators import products, summaries, trends
from salesloom.plans import star
from salesloom.plans.queries import registry
from salesloom.sources import staging
from tests.conftest import SF

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")
LAZY = sorted(n for n in registry() if not n.startswith("stream_"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(no_broadcast, name):
    text = plan(registry()[name](no_broadcast, SF))
    assert not [k for k in FORBIDDEN if k in text]


def test_daily_summary_reads_three_line_columns(no_broadcast):
    text = plan(registry()["daily_sales_summary"](no_broadcast, SF))
    assert re.search(r"FileScan parquet \[l_orderkey#\d+L,l_partkey#\d+L,l_extendedprice#\d+\]", text)
    assert "Expand" not in text


def test_date_range_reaches_the_scan(spark):
    import datetime as dt

    from salesloom.operators.facts import dated_orders

    orders = dated_orders(staging.orders(spark, SF), dt.date(1997, 1, 1), dt.date(1997, 1, 31))
    text = plan(orders.select("order_id"))
    assert re.search(r"DataFilters: \[.*o_orderdate", text)


def test_lines_are_summed_before_they_meet_orders(no_broadcast):
    text = plan(star.order_totals(no_broadcast, SF))
    partial = text.index("partial_sum(total_cents")
    assert text.index("SortMergeJoin [order_id") < partial


def test_rank_limit_is_applied_before_the_shuffle(no_broadcast):
    text = plan(registry()["top_products_per_category"](no_broadcast, SF))
    assert text.count("WindowGroupLimit") == 2


def test_top_k_does_not_sort_everything(no_broadcast):
    text = plan(registry()["recent_events"](no_broadcast, SF))
    assert "TakeOrderedAndProject" in text


def test_windows_without_partition_see_only_aggregates(no_broadcast):
    """The one-task windows run over days, months, categories or bins: rows after an aggregate."""
    for name in ("monthly_growth", "running_revenue", "revenue_by_category", "feature_drift_psi"):
        text = plan(registry()[name](no_broadcast, SF))
        below = text[text.index("Exchange SinglePartition") :]
        assert "HashAggregate" in below.split("FileScan")[0], name


def test_hot_key_is_split_even_before_an_aggregate(spark):
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


def test_present_types(spark):
    df = spark.sql("SELECT DATE '2024-02-29' d, TIMESTAMP '2024-01-01 01:02:03' t, 1.50 x, 'a' s")
    assert present(df).first().asDict() == {
        "d": "2024-02-29",
        "t": "2024-01-01 01:02:03.000000",
        "x": 1.5,
        "s": "a",
    }


def test_bad_parameters(spark):
    lines = star.sales(spark, SF)
    with pytest.raises(ValueError):
        products.top_products(lines, staging.products(spark, SF), metric="price")
    with pytest.raises(ValueError):
        summaries.sales_trend(star.order_totals(spark, SF), "hourly")
    with pytest.raises(ValueError):
        summaries.in_range(lines, "order_day", None, None, on_empty="some")


def test_time_split(spark):
    import datetime as dt

    df = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-10')) d")
    train, test = trends.split_by_date(df, "d", dt.date(2024, 1, 8))
    assert (train.count(), test.count()) == (7, 3)


def test_bucketed_fact_joins_without_a_shuffle(no_broadcast):
    """Lines and orders lie in buckets of the order: neither their join nor sums and windows by order exchange rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from salesloom.plans.queries import _bucketed_sales

    joined = _bucketed_sales(no_broadcast, SF)
    for df in (
        joined,
        summaries.order_totals(joined),
        joined.withColumn("n", F.sum("total_cents").over(Window.partitionBy("order_id"))),
    ):
        text = plan(df)
        assert "SortMergeJoin [order_id" in text and "Exchange" not in text
        assert "SelectedBucketsCount: 16 out of 16" in text
    assert joined.count() == star.sales(no_broadcast, SF).count()


def test_orders_per_product_hold_no_row_per_order_in_a_hash_table(spark):
    """Lines of one order and product may come twice, in one file or by a doubled order; lines without an order count none."""
    columns = "order_id long, product_id long, total_cents long, profit_cents long, quantity int, margin_points int, order_day date"
    data = [(1, 1, 5, 1, 2, 10, None), (1, 1, 5, 1, 2, 10, None), (2, 1, 7, 1, 1, None, None), (None, 1, 1, 1, 1, 1, None), (1, 2, 3, 1, 1, 1, None)]
    sums = products.product_sums(spark.createDataFrame(data, columns))
    got = {r.product_id: (r.orders, r.revenue_cents, r.quantity, r.margin_lines) for r in sums.collect()}
    assert got == {1: (2, 18, 6, 3), 2: (1, 3, 1, 1)}
    assert "distinct" not in sums._jdf.queryExecution().optimizedPlan().toString()


def test_as_of_does_not_sort_examples_to_tell_their_chunks(no_broadcast):
    text = registry()["features_as_of"](no_broadcast, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"max\(_state#\d+\)", text)
    assert not re.search(r"Aggregate \[.*max\(_state#\d+\).*\n[ :+-]*(Project.*\n[ :+-]*)?Union", text)
