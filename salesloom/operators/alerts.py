"""Business alerts over batch results: rows ``rule, subject, observed, threshold``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.money import dbl


def _alert(df: DataFrame, rule: str, subject: Column, observed: Column, threshold: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        subject.cast("string").alias("subject"),
        dbl(observed).alias("observed"),
        dbl(threshold).alias("threshold"),
    )


def revenue_drops(daily: DataFrame, share: float = 0.5, days: int = 7) -> DataFrame:
    """Days below a share of the mean of the ``days`` before; ``daily`` has one row per day."""
    w = Window.orderBy("date").rowsBetween(-days, -1)
    seen = F.count(F.lit(1)).over(w)
    floor = F.try_divide(dbl(F.sum("revenue").over(w)), dbl(seen)) * F.lit(share)
    low = daily.select("date", "revenue", floor.alias("_floor"), seen.alias("_seen")).filter(
        (F.col("_seen") == days) & (dbl("revenue") < F.col("_floor"))
    )
    day = F.date_format("date", "yyyy-MM-dd")
    return _alert(low, "revenue_drop", day, F.col("revenue"), F.col("_floor"))


def low_conversion(funnel: DataFrame, floor: float) -> DataFrame:
    """Days on which purchases per view fall below the floor."""
    rate = F.try_divide(dbl("purchase_events"), dbl("view_events"))
    low = funnel.select("date", rate.alias("_rate")).filter(F.col("_rate") < F.lit(floor))
    day = F.date_format("date", "yyyy-MM-dd")
    return _alert(low, "low_conversion", day, F.col("_rate"), F.lit(floor))


def lapsed_top_customers(segments: DataFrame, days: int = 180) -> DataFrame:
    """Frequent, high-spending customers who have not ordered for ``days``."""
    gone = segments.filter(
        (F.col("segment") == "Cannot Lose Them") & (F.col("days_since_last_order") > days)
    )
    return _alert(gone, "lapsed_top_customer", F.col("customer_id"), F.col("days_since_last_order"), F.lit(days))


def business_alerts(daily: DataFrame, funnel: DataFrame, segments: DataFrame, conversion_floor: float) -> DataFrame:
    return (
        revenue_drops(daily)
        .unionByName(low_conversion(funnel, conversion_floor))
        .unionByName(lapsed_top_customers(segments))
    )


def data_alerts(report: DataFrame, allowed: float = 0.0) -> DataFrame:
    """Data-quality rules of which a larger share fails than ``allowed``."""
    share = F.try_divide(dbl("failed"), dbl("checked"))
    bad = report.select("rule", share.alias("_share")).filter(F.col("_share") > F.lit(allowed))
    return _alert(bad, "data_quality", F.col("rule"), F.col("_share"), F.lit(allowed))


def accuracy_alerts(status: DataFrame, most_mape: float, least_auc: float) -> DataFrame:
    """Models whose mean error in percent is above a limit, or whose ranking is below one."""
    off = status.filter(dbl("mape") > F.lit(most_mape))
    weak = status.filter(F.col("auc") < F.lit(least_auc))
    return _alert(off, "model_error", F.col("model"), F.col("mape"), F.lit(most_mape)).unionByName(
        _alert(weak, "model_ranking", F.col("model"), F.col("auc"), F.lit(least_auc))
    )
