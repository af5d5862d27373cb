"""Metric series: latest samples, label sums, rates and counter increases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.bands import band
from salesloom.functions.dates import micros
from salesloom.functions.money import dbl

_SECOND = 1_000_000


def latest_per_series(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Newest sample of each series; equal times go to the higher event id."""
    newest = F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id"))
    return samples.groupBy(*labels).agg(newest.alias("_s")).select(*labels, "_s.ts", "_s.value")


def sum_by_label(samples: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``sum by (by)`` over the latest sample of each series, not over all samples."""
    latest = latest_per_series(samples, labels)
    return latest.groupBy(*by).agg(
        F.sum("value").cast("decimal(18,2)").alias("value"), F.count(F.lit(1)).alias("series")
    )


def kpi_status(kpis: DataFrame, bands: dict[str, Sequence[tuple[float | None, str]]]) -> DataFrame:
    """Colour of each figure in (kpi, value) rows."""
    status = F.lit(None).cast("string")
    for kpi, limits in bands.items():
        status = F.when(F.col("kpi") == kpi, band(F.col("value"), limits)).otherwise(status)
    return kpis.withColumn("status", status)


def _chunked(df: DataFrame, span_us: int, chunk_us: int) -> DataFrame:
    """Cuts time into chunks; rows that later windows still see are copied into the next chunk.

    A series with most of the rows is thereby spread over its chunks, and each window finds all its
    rows in its own chunk. Needs ``chunk_us >= span_us``, so a row has one copy at most.
    """
    if chunk_us < span_us:
        raise ValueError("chunk must be at least as long as the window")
    own = F.floor(F.col("_us") / chunk_us)
    seen_until = F.floor((F.col("_us") + (span_us - 1)) / chunk_us)
    spread = df.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.array_distinct(F.array("_own", seen_until)))
    )
    return spread


def rolling_rate(
    events: DataFrame, labels: Sequence[str], seconds: int = 300, chunk_seconds: int = 600
) -> DataFrame:
    """Events per second over ``(ts - seconds, ts]`` at each time an event of the series happened."""
    span, chunk = seconds * _SECOND, chunk_seconds * _SECOND
    points = events.groupBy(*labels, "ts").agg(F.count(F.lit(1)).alias("_n")).withColumn("_us", micros("ts"))
    w = Window.partitionBy(*labels, "_chunk").orderBy("_us").rangeBetween(-(span - 1), 0)
    return (
        _chunked(points, span, chunk)
        .withColumn("events", F.sum("_n").over(w))
        .filter(F.col("_own") == F.col("_chunk"))
        .select(*labels, "ts", "events", (dbl("events") / F.lit(float(seconds))).alias("rate"))
    )


def counter_increase(
    samples: DataFrame, labels: Sequence[str], seconds: int = 300, chunk_seconds: int = 600
) -> DataFrame:
    """Growth of a counter over the samples in ``(ts - seconds, ts]``.

    A drop is a reset: the counter restarted at 0 and grew to the new value. The first sample of the
    window is the baseline. Nothing is extrapolated to the window's edges.
    """
    span, chunk = seconds * _SECOND, chunk_seconds * _SECOND
    points = (
        samples.groupBy(*labels, "ts")
        .agg(F.max_by("value", "event_id").alias("value"))
        .withColumn("_us", micros("ts"))
    )
    series = Window.partitionBy(*labels, "_chunk").orderBy("_us")
    w = series.rangeBetween(-(span - 1), 0)
    before = F.lag("value").over(series)
    step = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return (
        _chunked(points, span, chunk)
        .withColumn("_step", step)
        .withColumn("increase", F.sum("_step").over(w) - F.first("_step").over(w))
        .filter(F.col("_own") == F.col("_chunk"))
        .select(*labels, "ts", "value", "increase")
    )


def pipeline_throughput(stages: DataFrame, as_of: Column, seconds: int = 300) -> DataFrame:
    """Records per second by stage and status over ``(as_of - seconds, as_of]``, from the load's stage rows."""
    recent = stages.filter(
        (F.col("ts") > as_of - F.expr(f"interval {int(seconds)} seconds")) & (F.col("ts") <= as_of)
    )
    return recent.groupBy("pipeline_stage", "status").agg(
        F.sum("records").alias("records"), (dbl(F.sum("records")) / F.lit(float(seconds))).alias("rate")
    )


def latest_event_per_user(events: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("event_id", "ts", "event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(newest.alias("_e")).select("user_id", "_e.*")


def recent_events(events: DataFrame, limit: int = 100) -> DataFrame:
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(limit)


def last_hours(events: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Events in ``(as_of - hours, as_of]``."""
    return events.filter((F.col("ts") > as_of - F.expr(f"interval {int(hours)} hours")) & (F.col("ts") <= as_of))


def conversion_funnel(events: DataFrame) -> DataFrame:
    """Events, users and step rates by day; users are counted after one row per (day, user)."""
    steps = ("view", "click", "signup", "purchase")
    day = F.to_date("ts").alias("date")
    each = events.groupBy(day, "user_id").agg(
        *[F.count_if(F.col("event_type") == s).alias(s) for s in steps]
    )
    daily = each.groupBy("date").agg(
        *[F.sum(s).alias(f"{s}_events") for s in steps],
        *[F.count_if(F.col(s) > 0).alias(f"{s}_users") for s in steps],
    )
    rate = {
        f"{b}_rate": F.try_divide(dbl(f"{b}_events"), dbl(f"{a}_events")) for a, b in zip(steps, steps[1:])
    }
    return daily.withColumns(rate)
