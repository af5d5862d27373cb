"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Request granularity to the truncation unit.
GRANULARITIES = {
    "daily": "day",
    "weekly": "week",
    "monthly": "month",
    "quarterly": "quarter",
    "yearly": "year",
}


def date_key(day: Column | str) -> Column:
    """Epoch seconds of midnight UTC as INT."""
    return (F.unix_date(day) * F.lit(86400)).cast("int")


def period_start(day: Column | str, granularity: str) -> Column:
    """First day of the period; weeks start on Monday."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {sorted(GRANULARITIES)}")
    if granularity == "daily":
        return F.to_date(day)
    return F.trunc(day, GRANULARITIES[granularity])


def month_index(day: Column | str) -> Column:
    """Months since year 0, so that one calendar year apart is 12 apart."""
    return F.year(day) * 12 + F.month(day)


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))
