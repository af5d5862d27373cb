"""Calendar dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions.dates import date_key


def _describe(days: DataFrame, holidays: DataFrame | None) -> DataFrame:
    d = F.col("full_date")
    out = days.select(
        date_key(d).alias("date_key"),
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.day(d).alias("day"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
    )
    if holidays is None:
        return out.withColumns({"is_holiday": F.lit(False), "holiday_name": F.lit(None).cast("string")})
    marked = out.join(holidays.select("full_date", "holiday_name"), "full_date", "left")
    return marked.select(
        *out.columns, F.col("holiday_name").isNotNull().alias("is_holiday"), "holiday_name"
    )


def dim_date(
    spark: SparkSession, start: dt.date, end: dt.date, holidays: DataFrame | None = None
) -> DataFrame:
    """One row per day of a closed range; ``holidays`` has (full_date, holiday_name)."""
    span = spark.range(1).select(F.lit(start).alias("a"), F.lit(end).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("full_date"))
    return _describe(days, holidays)


def dim_date_of(df: DataFrame, column: str, holidays: DataFrame | None = None) -> DataFrame:
    """The calendar from the first to the last day of a date column."""
    span = df.agg(F.to_date(F.min(column)).alias("a"), F.to_date(F.max(column)).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("full_date"))
    return _describe(days, holidays)
