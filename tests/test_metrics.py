"""Metric series: counters, rates, gauges, bands."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesloom.functions import bands
from salesloom.functions.money import gigabytes, percent
from salesloom.operators import metrics
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, event_type string, value decimal(12,2)"


def frame(spark, points):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(seconds=s), label, Decimal(v)) for i, (s, label, v) in enumerate(points)], SCHEMA
    )


def test_counter_with_reset(spark):
    df = frame(spark, [(0, "a", 10), (60, "a", 20), (120, "a", 5), (180, "a", 8)])
    got = metrics.counter_increase(df, ["event_type"]).orderBy("ts").collect()
    assert [r.increase for r in got] == [0, 10, 15, 18]


@pytest.mark.parametrize("chunk", [300, 3600])
def test_windows_across_chunks_equal_brute_force(spark, chunk):
    rng = random.Random(3)
    points = [(rng.randint(0, 4000), "hot" if rng.random() < 0.8 else "cold", rng.randint(0, 9)) for _ in range(300)]
    df = frame(spark, points)
    rate = {(r.event_type, r.ts): r.events for r in metrics.rolling_rate(df, ["event_type"], 300, chunk).collect()}
    want = {}
    for s, label, _ in points:
        want[(label, T0 + dt.timedelta(seconds=s))] = sum(1 for t, k, _ in points if k == label and s - 300 < t <= s)
    assert rate == want

    series: dict[str, dict[int, int]] = {"hot": {}, "cold": {}}
    for s, label, v in points:
        series[label][s] = v  # the later event id wins
    want = {}
    for label, at in series.items():
        for s in at:
            inside = sorted(t for t in at if s - 300 < t <= s)
            steps = zip(inside, inside[1:])
            want[(label, T0 + dt.timedelta(seconds=s))] = sum(at[b] - at[a] if at[b] >= at[a] else at[b] for a, b in steps)
    got = {(r.event_type, r.ts): int(r.increase) for r in metrics.counter_increase(df, ["event_type"], 300, chunk).collect()}
    assert got == want


def test_chunk_shorter_than_window_is_refused(spark):
    with pytest.raises(ValueError):
        metrics.rolling_rate(frame(spark, [(0, "a", 1)]), ["event_type"], 300, 60)


def test_label_sum_uses_latest_sample(spark):
    df = frame(spark, [(0, "a", 100), (60, "a", 7), (0, "b", 5)])
    assert rows(metrics.sum_by_label(df, ["event_type"], ["event_type"]).select("event_type", "value"), "event_type") == [
        ("a", Decimal("7.00")),
        ("b", Decimal("5.00")),
    ]


def test_bands(spark):
    df = spark.sql("SELECT * FROM VALUES (9999), (10000), (49999), (50000), (NULL) AS t(v)")
    got = [r[0] for r in df.select(bands.band(F.col("v"), bands.REVENUE_BANDS)).collect()]
    assert got == ["red", "yellow", "yellow", "green", None]
    cpu = spark.sql("SELECT * FROM VALUES (10), (70), (95) AS t(v)")
    assert [r[0] for r in cpu.select(bands.band(F.col("v"), bands.CPU_BANDS)).collect()] == ["green", "yellow", "red"]


def test_units(spark):
    one = spark.range(1).select(gigabytes(F.lit(3 * (1 << 30))), percent(F.lit(0.25))).first()
    assert tuple(one) == (3.0, 25.0)


def test_lookback_excludes_the_edge(spark):
    df = frame(spark, [(0, "a", 1), (1, "a", 1), (3600, "a", 1), (3601, "a", 1)])
    as_of = F.lit(T0 + dt.timedelta(seconds=3600))
    assert sorted(r.event_id for r in metrics.last_hours(df, as_of).collect()) == [1, 2]
