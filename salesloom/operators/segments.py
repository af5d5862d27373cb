"""Customer value: recency, frequency and money, segments, lifetime value, churn, cohorts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.dates import month_index
from salesloom.functions.money import dbl, dollars, from_cents, grand, ratio
from salesloom.operators.ordering import with_tile
from salesloom.operators.summaries import per_customer
from salesloom.schemas import TOTAL


def rfm_values(totals: DataFrame, as_of: dt.date) -> DataFrame:
    return per_customer(totals).select(
        "customer_id",
        F.date_diff(F.lit(as_of), "last_day").alias("recency_days"),
        F.col("orders").alias("frequency"),
        from_cents("revenue_cents").alias("monetary"),
    )


def rfm_scores(values: DataFrame) -> DataFrame:
    """Quintile 5 is best: bought last, most often, for most. Ties go by customer id."""
    r = with_tile(values, [F.col("recency_days").desc(), F.col("customer_id")], 5, "r_score")
    f = with_tile(r, [F.col("frequency"), F.col("customer_id")], 5, "f_score")
    return with_tile(f, [F.col("monetary"), F.col("customer_id")], 5, "m_score")


def segment_name(r: Column, f: Column, m: Column) -> Column:
    """The first rule that holds."""
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r <= 2) & (f >= 4) & (m >= 4), "Cannot Lose Them")
        .when(f >= 4, "Loyal Customers")
        .when((r >= 4) & (f <= 2), "New Customers")
        .when(r <= 2, "At Risk")
        .otherwise("Regular")
    )


def customer_ltv(totals: DataFrame, as_of: dt.date) -> DataFrame:
    """Profit per year of acquaintance; acquaintance counts for 30 days at least."""
    tenure = F.greatest(F.date_diff(F.lit(as_of), "first_day"), F.lit(30))
    return per_customer(totals).select(
        "customer_id",
        from_cents("profit_cents").alias("profit_to_date"),
        tenure.alias("tenure_days"),
        (dollars("profit_cents") / dbl(tenure) * F.lit(365.0)).alias("lifetime_value"),
    )


def customer_segments(totals: DataFrame, as_of: dt.date) -> DataFrame:
    """The segment table; the per-customer sums are taken once and carried through the tiles."""
    base = per_customer(totals)
    tenure = F.greatest(F.date_diff(F.lit(as_of), "first_day"), F.lit(30))
    values = base.select(
        "customer_id",
        F.date_diff(F.lit(as_of), "last_day").alias("recency_days"),
        F.col("orders").alias("frequency"),
        from_cents("revenue_cents").alias("monetary"),
        F.col("last_day").alias("last_order_date"),
        (dollars("profit_cents") / dbl(tenure) * F.lit(365.0)).alias("lifetime_value"),
    )
    scored = rfm_scores(values)
    return scored.select(
        "customer_id",
        segment_name(F.col("r_score"), F.col("f_score"), F.col("m_score")).alias("segment"),
        F.col("monetary").alias("total_spent"),
        F.col("frequency").alias("total_orders"),
        ratio("monetary", "frequency").alias("avg_order_value"),
        "last_order_date",
        F.col("recency_days").alias("days_since_last_order"),
        "lifetime_value",
    )


def customer_segment_summary(segments: DataFrame) -> DataFrame:
    return (
        segments.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("total_orders").alias("_orders"),
            F.sum("total_spent").cast(TOTAL).alias("total_value"),
        )
        .select(
            "segment",
            "count",
            ratio("total_value", F.col("count")).alias("avg_spent"),
            ratio("_orders", F.col("count")).alias("avg_orders"),
            "total_value",
        )
    )


def churn_labels(totals: DataFrame, cut: dt.date, horizon_days: int = 180) -> DataFrame:
    """Features strictly before the cut; churned = no order within the horizon after it."""
    end = cut + dt.timedelta(days=horizon_days)
    day = F.col("order_day")
    known = day < F.lit(cut)
    return (
        totals.filter(day < F.lit(end))
        .groupBy("customer_id")
        .agg(
            F.count_if(known).alias("frequency"),
            from_cents(F.sum(F.when(known, F.col("revenue_cents")))).alias("monetary"),
            F.date_diff(F.lit(cut), F.max(F.when(known, day))).alias("recency_days"),
            F.date_diff(F.lit(cut), F.min(F.when(known, day))).alias("tenure_days"),
            F.count_if(~known).alias("_later"),
        )
        .filter(F.col("frequency") > 0)
        .withColumn("churned", (F.col("_later") == 0).cast("int"))
        .drop("_later")
    )


def cohort_retention(totals: DataFrame) -> DataFrame:
    """Customers active by month since their first; the window sees at most one row per customer and month."""
    month = F.trunc("order_day", "month")
    active = totals.groupBy("customer_id", month.alias("month")).agg(F.sum("revenue_cents").alias("cents"))
    cohort = F.min("month").over(Window.partitionBy("customer_id"))
    return (
        active.withColumn("cohort", cohort)
        .withColumn("months_since", month_index("month") - month_index("cohort"))
        .groupBy("cohort", "months_since")
        .agg(F.count(F.lit(1)).alias("customers"), from_cents(grand("cents")).alias("revenue"))
    )
