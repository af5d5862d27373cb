"""Sales summaries over order totals, so that distinct counts become plain counts.

An order has one customer and one day, hence: rows per order, then per (period, customer), then per
period. Each step sums on the map side before it shuffles, and no step multiplies rows the way several
distinct counts in one aggregation do.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.dates import period_start
from salesloom.functions.money import dbl, dollars, from_cents, grand, ratio, ratio_at_least_one, ratio_or_zero
from salesloom.schemas import TOTAL


def _line_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("quantity"),
        F.sum("total_cents").alias("revenue_cents"),
        F.sum("profit_cents").alias("profit_cents"),
    ]


ORDER_COLUMNS = ("order_id", "customer_id", "order_day", "order_status", "registration_date")


def order_totals(sales: DataFrame) -> DataFrame:
    """One row per order of the fact."""
    return sales.groupBy(*ORDER_COLUMNS).agg(*_line_sums())


def order_totals_of(priced: DataFrame, orders: DataFrame, buyers: DataFrame) -> DataFrame:
    """The same from lines that have not met their orders yet.

    Lines are summed before they shuffle, so an order with very many lines is one row per task by then,
    and the customers join last, on the key that most summaries group by next.
    """
    placed = orders.select("order_id", "customer_id", "order_day", "order_status")
    who = buyers.select("customer_id", "registration_date")
    return priced.groupBy("order_id").agg(*_line_sums()).join(placed, "order_id").join(who, "customer_id")


def per_customer(totals: DataFrame, *extra: Column) -> DataFrame:
    """Orders, lines, revenue and profit per customer (and per ``extra`` grouping columns)."""
    return totals.groupBy("customer_id", "registration_date", *extra).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("lines").alias("lines"),
        F.sum("revenue_cents").alias("revenue_cents"),
        F.sum("profit_cents").alias("profit_cents"),
        F.min("order_day").alias("first_day"),
        F.max("order_day").alias("last_day"),
    )


def daily_sales_summary(totals: DataFrame) -> DataFrame:
    return daily_of_customer_days(per_customer(totals, F.col("order_day")))


def daily_of_customer_days(days: DataFrame) -> DataFrame:
    """The summary from one row per customer and day, which is all that its distinct counts need."""
    registered = F.col("registration_date")
    day = F.col("order_day")
    daily = days.groupBy(day.alias("date")).agg(
        F.sum("orders").alias("total_orders"),
        grand("revenue_cents").alias("_revenue"),
        grand("profit_cents").alias("_profit"),
        F.sum("lines").alias("_lines"),
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(registered == day).alias("new_customers"),
        F.count_if(registered < day).alias("repeat_customers"),
    )
    return daily.select(
        "date",
        "total_orders",
        from_cents("_revenue").alias("total_revenue"),
        from_cents("_profit").alias("total_profit"),
        ratio(dollars("_revenue"), "_lines").alias("avg_line_value"),
        ratio(dollars("_revenue"), "total_orders").alias("avg_order_value"),
        "total_customers",
        "new_customers",
        "repeat_customers",
    )


def monthly_sales_trend(totals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Summed per day first, so that only one row per day meets the calendar."""
    daily = totals.groupBy(F.col("order_day").alias("full_date")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("lines").alias("lines"),
        grand("revenue_cents").alias("revenue"),
        grand("profit_cents").alias("profit"),
    )
    monthly = (
        daily.join(calendar.select("full_date", "year", "month", "month_name"), "full_date")
        .groupBy("year", "month", "month_name")
        .agg(
            F.sum("orders").alias("total_orders"),
            grand("revenue").alias("_revenue"),
            grand("profit").alias("_profit"),
            F.sum("lines").alias("_lines"),
        )
    )
    return monthly.select(
        "year",
        "month",
        "month_name",
        "total_orders",
        from_cents("_revenue").alias("total_revenue"),
        from_cents("_profit").alias("total_profit"),
        ratio(dollars("_revenue"), "_lines").alias("avg_line_value"),
    )


def sales_trend(totals: DataFrame, granularity: str = "daily") -> DataFrame:
    period = period_start("order_day", granularity).alias("period")
    by_period = per_customer(totals, period).groupBy("period").agg(
        grand("revenue_cents").alias("_revenue"),
        F.sum("orders").alias("orders"),
        F.count(F.lit(1)).alias("customers"),
    )
    return by_period.select(
        "period",
        from_cents("_revenue").alias("revenue"),
        "orders",
        "customers",
        ratio_at_least_one(dollars("_revenue"), "orders").alias("avg_order_value"),
    )


def in_range(
    df: DataFrame, column: str, start: dt.date | None, end: dt.date | None, on_empty: str = "none"
) -> DataFrame:
    """Closed date range; ``on_empty="all"`` gives every row back where the range holds none."""
    if on_empty not in ("none", "all"):
        raise ValueError("on_empty must be 'none' or 'all'")
    out = df
    if start is not None:
        out = out.filter(F.col(column) >= F.lit(start))
    if end is not None:
        out = out.filter(F.col(column) <= F.lit(end))
    if on_empty == "all" and out.isEmpty():
        return df
    return out


def with_statuses(totals: DataFrame, statuses: Sequence[str] | None) -> DataFrame:
    """Without statuses every order counts, cancelled ones too."""
    return totals if statuses is None else totals.filter(F.col("order_status").isin(list(statuses)))


def sales_summary(
    totals: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    statuses: Sequence[str] | None = None,
) -> DataFrame:
    """One row; ``customer_days`` adds up daily customer counts, ``total_customers`` counts each once."""
    chosen = with_statuses(in_range(totals, "order_day", start, end), statuses)
    daily = per_customer(chosen, F.col("order_day"))
    each = daily.groupBy("customer_id").agg(
        F.sum("revenue_cents").alias("revenue"), F.sum("orders").alias("orders"), F.count(F.lit(1)).alias("days")
    )
    one = each.agg(
        F.coalesce(grand("revenue"), F.lit(0)).alias("_revenue"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        F.count(F.lit(1)).alias("total_customers"),
        F.coalesce(F.sum("days"), F.lit(0)).alias("customer_days"),
    )
    return one.select(
        from_cents("_revenue").alias("total_revenue"),
        "total_orders",
        "total_customers",
        "customer_days",
        ratio_or_zero(dollars("_revenue"), "total_orders").alias("avg_order_value"),
    )


def orders_by_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_status", "payment_method").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_amount").cast(TOTAL).alias("amount")
    )


def sales_by_geography(totals: DataFrame, customers: DataFrame) -> DataFrame:
    """Country and state with subtotals: a customer lives in one state, so only state rows are rolled up."""
    where = customers.select(
        "customer_id",
        F.coalesce("country", F.lit("Unknown")).alias("country"),
        F.coalesce("state", F.lit("Unknown")).alias("state"),
    )
    states = (
        per_customer(totals)
        .join(where, "customer_id")
        .groupBy("country", "state")
        .agg(
            grand("revenue_cents").alias("r"), F.sum("orders").alias("o"), F.count(F.lit(1)).alias("c")
        )
    )
    rolled = states.rollup("country", "state").agg(
        from_cents(grand("r")).alias("revenue"),
        F.sum("o").alias("orders"),
        F.sum("c").alias("customers"),
        F.grouping("country").alias("_all_countries"),
        F.grouping("state").alias("_all_states"),
    )
    return rolled.select(
        F.when(F.col("_all_countries") == 1, F.lit("ALL")).otherwise(F.col("country")).alias("country"),
        F.when(F.col("_all_states") == 1, F.lit("ALL")).otherwise(F.col("state")).alias("state"),
        "revenue",
        "orders",
        "customers",
    )


def approx_customers(totals: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Opt-in estimate of distinct customers per day; the sketch merges on the map side."""
    return totals.groupBy(F.col("order_day").alias("date")).agg(
        F.approx_count_distinct("customer_id", rsd).alias("approx_customers")
    )


def customer_sketches(sales: DataFrame, products: DataFrame, lg_k: int = 12) -> DataFrame:
    """A mergeable sketch of the customers of each day and category: the stored state of distinct counts.

    Sketches of any set of days and categories union to that of all, so that a range needs no line. With ``lg_k`` 12 the
    standard error is 1.6 percent, and a sketch never takes more than about 2.5 KB.
    """
    goods = products.select("product_id", "category")
    return (
        sales.select("product_id", "customer_id", "order_day")
        .join(goods, "product_id")
        .groupBy(F.col("order_day").alias("date"), "category")
        .agg(F.hll_sketch_agg("customer_id", lg_k).alias("customers"))
    )


def customers_from_sketches(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Estimated distinct customers of what ``by`` groups."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("estimate"))


def basket_size_distribution(totals: DataFrame) -> DataFrame:
    return (
        totals.groupBy(F.col("lines").alias("items"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("quantity").alias("total_quantity"))
        .withColumn("avg_quantity", ratio("total_quantity", "orders"))
    )


def sales_kpis(totals: DataFrame) -> DataFrame:
    """The summary in long form, for banding and formatting."""
    return sales_summary(totals).select(
        F.explode(
            F.array(
                F.struct(F.lit("revenue").alias("kpi"), dbl("total_revenue").alias("value")),
                F.struct(F.lit("orders").alias("kpi"), dbl("total_orders").alias("value")),
                F.struct(F.lit("customers").alias("kpi"), dbl("total_customers").alias("value")),
            )
        ).alias("k")
    ).select("k.kpi", "k.value")


def revenue_growth(trend: DataFrame) -> DataFrame:
    """Growth over the previous period; the window runs over one row per period."""
    previous = F.lag("revenue").over(Window.orderBy("period"))
    return trend.select(
        "period", "revenue", previous.alias("previous_revenue")
    ).withColumn("growth", F.try_divide(dbl("revenue") - dbl("previous_revenue"), dbl("previous_revenue")))
