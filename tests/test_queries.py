"""Every registered query against its check SQL, or for rows where SQL cannot say it."""

from __future__ import annotations

import pytest

from salesloom.plans.oracle import sql_by_query
from salesloom.plans.queries import registry
from tests.check import compare
from tests.conftest import SF

SQL = sql_by_query()
ROWS_ONLY = {
    "approx_customers",
    "behavior_clusters",
    "churn_scores",
    "customers_by_range_estimate",
    "forecast_gbt",
    "model_status",
    "recommend_als",
    "recommend_new",
}


def test_only_known_queries_lack_sql():
    assert set(registry()) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(registry())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, registry()[name], SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_has_rows(spark, name):
    assert registry()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.queries().keys() >= e.oracle_sql().keys()


def test_totals_agree(spark):
    """Days, months, categories, geography and customers add up to the same revenue."""

    def total(name, column, where="true"):
        got = registry()[name](spark, SF).filter(where).selectExpr(f"round(sum({column}), 2)").first()[0]
        return got

    whole = total("sales_summary", "total_revenue")
    assert total("daily_sales_summary", "total_revenue") == whole
    assert total("monthly_sales_trend", "total_revenue") == whole
    assert total("revenue_by_category", "revenue") == whole
    assert total("sales_by_geography", "revenue", "country = 'ALL'") == whole
    assert total("customer_segment_summary", "total_value") == whole
    seg = registry()["customer_segment_summary"](spark, SF)
    assert seg.filter("abs(total_value - count * avg_spent) > 0.01").count() == 0
    customers = registry()["sales_summary"](spark, SF).first().total_customers
    assert seg.selectExpr("sum(count)").first()[0] == customers
