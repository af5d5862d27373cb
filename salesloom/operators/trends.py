"""Series over days and months. Windows here run over one row per day (and category), never over lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.dates import month_index
from salesloom.functions.money import dbl, from_cents, grand, ratio


def daily_revenue(totals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Revenue of every calendar day, 0 where nothing was sold."""
    sold = totals.groupBy(F.col("order_day").alias("full_date")).agg(grand("revenue_cents").alias("_cents"))
    return calendar.select("full_date").join(sold, "full_date", "left").select(
        F.col("full_date").alias("date"),
        from_cents(F.coalesce("_cents", F.lit(0))).alias("revenue"),
    )


def moving_average_revenue(daily: DataFrame, short: int = 7, long: int = 28) -> DataFrame:
    """Trailing means over the days at hand, the current one included."""

    def mean(days: int):
        w = Window.orderBy("date").rowsBetween(-(days - 1), 0)
        return dbl(F.sum("revenue").over(w)) / F.count(F.lit(1)).over(w)

    return daily.select(
        "date", "revenue", mean(short).alias(f"avg_{short}d"), mean(long).alias(f"avg_{long}d")
    )


def running_revenue(daily: DataFrame) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("date", "revenue", F.sum("revenue").over(w).alias("running_revenue"))


def first_periods(trend: DataFrame, limit: int = 30) -> DataFrame:
    return trend.orderBy("period").limit(limit)


def monthly_revenue(totals: DataFrame) -> DataFrame:
    return totals.groupBy(F.trunc("order_day", "month").alias("period")).agg(
        from_cents(grand("revenue_cents")).alias("revenue")
    )


def forecast_seasonal_naive(monthly: DataFrame) -> DataFrame:
    """Forecast = the same month a year before; past months keep their actual, for measuring error.

    Each month counts as an actual now and as a forecast a year on, so one pass serves both.
    """
    both = monthly.select(
        F.explode(
            F.array(
                F.struct(F.col("period"), F.col("revenue").alias("actual"), F.lit(None).alias("forecast")),
                F.struct(
                    F.add_months("period", 12).alias("period"),
                    F.lit(None).alias("actual"),
                    F.col("revenue").alias("forecast"),
                ),
            )
        ).alias("m")
    ).select("m.*")
    return (
        both.groupBy("period")
        .agg(F.max("actual").alias("actual"), F.max("forecast").alias("forecast"))
        .filter(F.col("forecast").isNotNull())
    )


def forecast_linear(monthly: DataFrame, ahead: int = 6) -> DataFrame:
    """Least-squares line through the monthly revenue, read off for the coming months."""
    x = dbl(month_index("period"))
    line = monthly.agg(
        F.regr_slope(dbl("revenue"), x).alias("slope"),
        F.regr_intercept(dbl("revenue"), x).alias("intercept"),
        F.max("period").alias("last"),
    )
    steps = line.select(
        "slope", "intercept", "last", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step")
    )
    period = F.add_months("last", F.col("step"))
    value = F.col("intercept") + F.col("slope") * dbl(month_index(period))
    return steps.select(
        period.alias("period"),
        F.col("slope").cast("decimal(18,2)").alias("monthly_change"),
        value.cast("decimal(18,2)").alias("forecast"),
    )


def forecast_error(forecast: DataFrame, model: str) -> DataFrame:
    """RMSE, MAE and MAPE of the months whose actual is known; sums are exact decimals."""
    miss = F.col("actual") - F.col("forecast")
    exact = miss.cast("decimal(18,2)")
    relative = F.try_divide(F.abs(exact), F.col("actual")).cast("decimal(18,8)")
    sums = forecast.filter(F.col("actual").isNotNull()).agg(
        F.count(F.lit(1)).alias("periods"),
        F.sum((exact * exact).cast("decimal(38,4)")).alias("_squares"),
        F.sum(F.abs(exact)).alias("_absolute"),
        F.avg(dbl(relative)).alias("_relative"),
    )
    return sums.select(
        F.lit(model).alias("model"),
        "periods",
        F.sqrt(ratio("_squares", "periods")).cast("decimal(18,2)").alias("rmse"),
        ratio("_absolute", "periods").cast("decimal(18,2)").alias("mae"),
        (F.col("_relative") * 100).cast("decimal(18,4)").alias("mape"),
    )


def category_days(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue per category and day; lines are summed per product and day before the lookup."""
    sold = sales.groupBy("product_id", "order_day").agg(F.sum("total_cents").alias("cents"))
    return (
        sold.join(products.select("product_id", "category"), "product_id")
        .groupBy("category", F.col("order_day").alias("date"))
        .agg(from_cents(grand("cents")).alias("revenue"))
    )


def every_category_day(by_category: DataFrame) -> DataFrame:
    """The same with 0 for each category's days without sales, from the first day of any category to the last."""
    first, last = by_category.agg(F.min("date")).scalar(), by_category.agg(F.max("date")).scalar()
    days = by_category.select("category").distinct().select("category", F.explode(F.sequence(first, last)).alias("date"))
    revenue = F.coalesce("revenue", F.lit(0)).cast(by_category.schema["revenue"].dataType)
    return days.join(by_category, ["category", "date"], "left").select("category", "date", revenue.alias("revenue"))


def revenue_anomalies(by_category: DataFrame, days: int = 28, sigmas: float = 3.0) -> DataFrame:
    """Days further than ``sigmas`` deviations from the mean of the ``days`` before, per category.

    The mean is over days with sales: a day without any is a gap in the data here, not a revenue of 0.
    """
    before = Window.partitionBy("category").orderBy(F.unix_date("date")).rangeBetween(-days, -1)
    x = dbl("revenue")
    scored = by_category.select(
        "category",
        "date",
        "revenue",
        F.avg(x).over(before).alias("_mean"),
        F.stddev_samp(x).over(before).alias("_std"),
        F.count(F.lit(1)).over(before).alias("days_seen"),
    )
    far = F.abs(x - F.col("_mean")) > F.lit(sigmas) * F.col("_std")
    return scored.select("category", "date", "revenue", "days_seen", F.coalesce(far, F.lit(False)).alias("is_anomaly"))


def order_outliers(orders: DataFrame, sigmas: float = 3.0, min_orders: int = 5) -> DataFrame:
    """Orders above their customer's mean by ``sigmas`` deviations, among customers with enough orders."""
    x = dbl("total_amount")
    habits = (
        orders.groupBy("customer_id")
        .agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"), F.count(F.lit(1)).alias("customer_orders"))
        .filter(F.col("customer_orders") >= min_orders)
    )
    return (
        orders.join(habits, "customer_id")
        .filter(x > F.col("_mean") + F.lit(sigmas) * F.col("_std"))
        .select("order_id", "customer_id", "total_amount", "customer_orders")
    )


def split_by_date(df: DataFrame, column: str, cut: dt.date) -> tuple[DataFrame, DataFrame]:
    """Rows before the cut for training, the rest for testing."""
    return df.filter(F.col(column) < F.lit(cut)), df.filter(F.col(column) >= F.lit(cut))
