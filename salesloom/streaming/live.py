"""Queries over the event stream. Each takes a DataFrame, so the same code runs on a batch.

Live, windowed queries run in append mode: a window comes out once, when the watermark passes its end, and its state
is dropped. Over a finished input they run in update mode, so that windows still open at its end come out too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.money import dbl, ratio_or_zero

DELAY = "10 minutes"


def _bounds(df: DataFrame, *rest: Column | str) -> DataFrame:
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest
    )


def tumbling_counts(
    events: DataFrame, labels: Sequence[str] = ("event_type",), width: str = "1 hour", delay: str = DELAY
) -> DataFrame:
    counted = (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), *labels)
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return _bounds(counted, *labels, "events")


def sliding_rate(
    events: DataFrame, labels: Sequence[str] = ("event_type",), minutes: int = 5, slide: int = 1, delay: str = DELAY
) -> DataFrame:
    """Events per second per label over the last minutes, on a grid of slides."""
    counted = (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{minutes} minutes", f"{slide} minutes"), *labels)
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return _bounds(counted, *labels, "events", (dbl("events") / F.lit(minutes * 60.0)).alias("rate"))


def _kpi_sums() -> list[Column]:
    bought = F.col("event_type") == "purchase"
    return [
        F.count(F.lit(1)).alias("total_events"),
        F.coalesce(F.sum(F.when(bought, F.col("value"))), F.lit(0)).cast("decimal(18,2)").alias("total_revenue"),
        F.count_if(bought).alias("purchases"),
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    ]


def _kpi_rates() -> dict[str, Column]:
    return {
        "conversion_rate": ratio_or_zero("purchases", "views") * F.lit(100.0),
        "avg_order_value": ratio_or_zero("total_revenue", "purchases"),
    }


def realtime_metrics(events: DataFrame) -> DataFrame:
    """One row over all events: count, purchase revenue, purchases per 100 views, revenue per purchase."""
    out = events.agg(*_kpi_sums()).withColumns(_kpi_rates())
    return out.select("total_events", "total_revenue", "conversion_rate", "avg_order_value")


def windowed_metrics(events: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    sums = events.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(*_kpi_sums())
    return _bounds(
        sums.withColumns(_kpi_rates()).withColumn("error_share", ratio_or_zero("errors", "total_events")),
        "total_events",
        "total_revenue",
        "conversion_rate",
        "avg_order_value",
        "error_share",
    )


# Rule, figure, whether it must stay "above" or "below", limit.
ALERT_RULES = (
    ("revenue_low", "total_revenue", "above", 50.0),
    ("errors_high", "error_share", "below", 0.4),
    ("conversion_low", "conversion_rate", "above", 20.0),
)


def alerts(metrics: DataFrame, rules: Sequence[tuple[str, str, str, float]] = ALERT_RULES) -> DataFrame:
    """Broken rules per window, without further state."""
    broken = []
    for rule, figure, side, limit in rules:
        value = dbl(figure)
        hit = value < F.lit(limit) if side == "above" else value > F.lit(limit)
        broken.append(
            F.when(hit, F.struct(F.lit(rule).alias("rule"), value.alias("observed"), F.lit(limit).alias("threshold")))
        )
    return metrics.select(
        "window_start", "window_end", F.explode(F.array_compact(F.array(*broken))).alias("a")
    ).select("window_start", "window_end", "a.rule", "a.observed", "a.threshold")


def latest_gauge(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Newest sample per series; update mode."""
    newest = F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id"))
    return samples.groupBy(*labels).agg(newest.alias("_s")).select(*labels, "_s.ts", "_s.value")


def deduplicated(events: DataFrame, delay: str = DELAY, salts: int = 16) -> DataFrame:
    """Redelivered events once, as long as copies arrive within the delay.

    Copies first meet within their salt (the input partition, so not tied to the event): an event that
    is redelivered endlessly is thinned by many tasks before its copies come together in one.
    """
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    salted = events.withWatermark("ts", delay).withColumn("_salt", F.spark_partition_id() % salts)
    thinned = salted.dropDuplicatesWithinWatermark(["event_id", "_salt"]).drop("_salt")
    return thinned.dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Visits per user, ended by a pause of ``gap``."""
    out = (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("window"), "user_id")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").cast("decimal(18,2)").alias("value"))
    )
    return _bounds(out, "user_id", "events", "value")


def user_state(events: DataFrame) -> DataFrame:
    """Running figures per user; update mode."""
    spend = F.when(F.col("event_type") == "purchase", F.col("value"))
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.max("ts").alias("last_seen"),
        F.coalesce(F.sum(spend), F.lit(0)).cast("decimal(18,2)").alias("spend"),
    )


def events_by_segment(events: DataFrame, customers: DataFrame, width: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Stream joined to the static customer table; Spark broadcasts that only below its size threshold."""
    who = customers.select(F.col("customer_id").alias("user_id"), "customer_segment")
    return tumbling_counts(events.join(who, "user_id"), ("customer_segment",), width, delay)


def event_counts(events: DataFrame) -> DataFrame:
    """Events by type since the start; update mode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
