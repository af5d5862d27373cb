"""Streams against their batch twins, late and repeated events, repeated batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from salesloom import schemas
from salesloom.operators.facts import sales_lines
from salesloom.operators.summaries import daily_sales_summary, order_totals
from salesloom.plans import star
from salesloom.sources import staging
from salesloom.sources.events import event_stream
from salesloom.streaming import live, progress, sinks, users
from tests.conftest import SF, rows

T0 = dt.datetime(2024, 1, 1)


def write_files(spark, folder, *batches):
    """One file per batch, in order of time of writing."""
    import os
    import time

    for i, batch in enumerate(batches):
        data = [(e, T0 + dt.timedelta(minutes=m), u, t, float(v), '{"k": 1}') for e, m, u, t, v in batch]
        df = spark.createDataFrame(data, schemas.FILES["events"]).coalesce(1)
        path = f"{folder}/events.parquet/part{i}"
        df.write.parquet(path)
        for name in os.listdir(path):
            at = time.time() - 1000 + i * 10
            os.utime(f"{path}/{name}", (at, at))
    return str(folder)


def stream_of(spark, folder):
    return event_stream(spark, folder, maxFilesPerTrigger="1", recursiveFileLookup="true")


def test_closed_windows_equal_the_batch(spark):
    batch = live.tumbling_counts(staging.events(spark, SF))
    newest = staging.events(spark, SF).agg(F.max("ts")).first()[0]
    closed = batch.filter(F.col("window_end") <= F.lit(newest - dt.timedelta(minutes=10)))
    got = sinks.drain_append(live.tumbling_counts(event_stream(spark, SF)), "t")
    assert rows(got, "window_start", "event_type") == rows(closed, "window_start", "event_type")


def test_a_finished_input_gives_open_windows_too(spark):
    keys = ["window_start", "window_end", "event_type"]
    want = live.tumbling_counts(staging.events(spark, SF))
    got = sinks.drain_updates(live.tumbling_counts(event_stream(spark, SF)), "t", keys)
    assert rows(got.select(*want.columns), *keys) == rows(want, *keys)


def test_sessions_of_a_finished_input(spark, tmp_path):
    folder = write_files(
        spark, tmp_path,
        [(1, 0, 1, "view", 1), (2, 20, 1, "view", 1), (3, 10, 2, "view", 1)],
        [(4, 120, 1, "view", 1), (5, 125, 3, "view", 1)],
        [(6, 140, 1, "view", 1), (7, 171, 1, "view", 1)],  # the last visits are open when the input ends
    )
    raw = spark.read.schema(schemas.FILES["events"]).option("recursiveFileLookup", "true")
    batch = staging.parse_events(raw.parquet(f"{folder}/events.parquet"))
    got = sinks.drain_sessions(stream_of(spark, folder), batch, live.sessions)
    assert rows(got, "user_id", "window_start") == rows(live.sessions(batch), "user_id", "window_start")


@pytest.mark.parametrize(
    "job, keys",
    [
        (live.user_state, ["user_id"]),
        (live.event_counts, ["event_type"]),
        (lambda e: live.latest_gauge(e, ["event_type", "source"]), ["event_type", "source"]),
    ],
)
def test_running_state_equals_the_batch(spark, job, keys):
    got = sinks.drain_updates(job(event_stream(spark, SF)), "s", keys)
    want = job(staging.events(spark, SF))
    assert rows(got.select(*want.columns), *keys) == rows(want, *keys)


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    folder = write_files(
        spark, tmp_path,
        [(1, 0, 1, "view", 1), (2, 90, 1, "view", 1)],
        [(3, 200, 1, "view", 1)],
        [(4, 5, 1, "view", 1), (5, 300, 1, "view", 1)],  # event 4 belongs to a window closed a batch ago
    )
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    q = sinks.append_table(live.tumbling_counts(stream_of(spark, folder)), path, state, sinks.until_done())
    q.awaitTermination()
    got = rows(spark.read.parquet(path).select("window_start", "events"), "window_start")
    assert got == [(T0, 1), (T0 + dt.timedelta(hours=1), 1), (T0 + dt.timedelta(hours=3), 1)]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    assert dropped == 1


def test_state_over_several_batches(spark, tmp_path):
    folder = write_files(
        spark, tmp_path,
        [(1, 0, 1, "purchase", 5), (2, 1, 2, "view", 1)],
        [(3, 2, 1, "purchase", 7)],
    )
    got = sinks.drain_updates(live.user_state(stream_of(spark, folder)), "u", ["user_id"])
    assert [(r.user_id, r.events, float(r.spend)) for r in got.orderBy("user_id").collect()] == [(1, 2, 12.0), (2, 1, 0.0)]


def test_redelivery_comes_out_once(spark, tmp_path):
    folder = write_files(spark, tmp_path, [(1, 0, 1, "view", 1), (2, 1, 1, "view", 1)], [(2, 1, 1, "view", 1), (3, 2, 1, "view", 1)])
    got = sinks.drain_append(live.deduplicated(stream_of(spark, folder)), "d")
    assert [r.event_id for r in got.orderBy("event_id").collect()] == [1, 2, 3]


def test_session_ends_after_the_gap(spark, tmp_path):
    folder = write_files(spark, tmp_path, [(1, 0, 1, "view", 1), (2, 29, 1, "view", 1), (3, 60, 1, "view", 1), (4, 500, 2, "view", 1)])
    got = sinks.drain_append(live.sessions(stream_of(spark, folder)), "v")
    assert [(r.user_id, r.events) for r in got.orderBy("window_start").collect()] == [(1, 2), (1, 1)]


def test_alert_rules(spark):
    events = spark.createDataFrame(
        [(1, T0, 1, "view", 0, "s"), (2, T0, 1, "error", 0, "s"), (3, T0, 1, "error", 0, "s")],
        "event_id long, ts timestamp, user_id long, event_type string, value int, source string",
    )
    out = live.alerts(live.windowed_metrics(events))
    assert sorted(r.rule for r in out.collect()) == ["conversion_low", "errors_high", "revenue_low"]


def test_repeated_batch_of_new_lines(spark, tmp_path):
    """Each batch upserts the days it touches; running a batch again changes nothing."""
    lines = star.sales(spark, SF)
    merge = sinks.DailySummaryMerger(spark, str(tmp_path))
    merge(lines.filter("order_id % 2 = 0"), 0)
    for _ in range(2):
        merge(lines.filter("order_id % 2 = 1"), 1)
    want = daily_sales_summary(order_totals(lines))
    assert rows(merge.table().select(*want.columns), "date") == rows(want, "date")


def test_a_batch_touches_only_its_months(spark, tmp_path):
    """Files of other months are neither rewritten nor read; an order split among batches counts once."""
    lines = star.sales(spark, SF)
    merge = sinks.DailySummaryMerger(spark, str(tmp_path))
    merge(lines.filter("product_id % 2 = 0"), 0)
    late = lines.filter("product_id % 2 = 1 AND order_day >= DATE '2001-05-01'")
    merge(late, 1)
    own = [r.part for r in spark.read.parquet(f"{tmp_path}/processed_data/order_states_parts/load_id=batch-1").collect() if r.load_id == "batch-1"]
    assert own and min(own) >= "2001-05"
    reread = merge.layout.read_parts(spark, *sinks.ORDER_STATES, "batch-1", ["2001-06"])
    assert all("order_month=2001-06" in f for f in reread.inputFiles())
    want = daily_sales_summary(order_totals(lines.filter("product_id % 2 = 0 OR order_day >= DATE '2001-05-01'")))
    assert rows(merge.table().select(*want.columns), "date") == rows(want, "date")
    merge(late.limit(0), 2)
    assert rows(merge.table().select(*want.columns), "date") == rows(want, "date")


def test_merger_as_a_stream(spark, tmp_path):
    raw = staging.load_raw(spark, SF)
    lines = sales_lines(raw.order_items, raw.orders, raw.customers, raw.products)
    lines.repartition(2).write.parquet(str(tmp_path / "in"))
    new = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge = sinks.DailySummaryMerger(spark, str(tmp_path / "out"))
    q = new.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert merge.last == max(p["batchId"] for p in q.recentProgress if p["numInputRows"])
    want = daily_sales_summary(order_totals(lines))
    assert rows(merge.table().select(*want.columns), "date") == rows(want, "date")


def test_triggers():
    assert sinks.live_trigger() == {"processingTime": "5 seconds"}
    assert sinks.until_done() == {"availableNow": True}


def test_idle_users_leave_the_state(spark, tmp_path):
    """Spans restart after a pause, within a batch and across batches; state rows fall once users are idle."""
    day = 24 * 60
    folder = write_files(
        spark, tmp_path,
        [(1, 0, 1, "purchase", 5), (2, 30, 1, "view", 1), (3, 10, 2, "view", 1), (4, 20, 3, "purchase", 2)],
        [(5, 60, 1, "purchase", 7), (6, 100, 4, "view", 1), (7, 3 * day, 4, "purchase", 1)],
        [(8, 3 * day + 5, 2, "purchase", 4), (9, 3 * day + 60, 5, "view", 1)],
    )
    stream = users.user_activity(stream_of(spark, folder), idle_minutes=day)
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = sinks.write_metrics(stream, path, state, sinks.until_done())
    query.awaitTermination()
    got = sinks.newest_per_key(sinks.read_updates(spark, path, stream.schema), ["user_id"]).collect()
    at = {r.user_id: (r.first_seen, r.last_seen, r.events, float(r.spend), r.active) for r in got}

    def minute(m):
        return T0 + dt.timedelta(minutes=m)

    assert at[1] == (minute(0), minute(60), 3, 12.0, False) and at[3] == (minute(20), minute(20), 1, 2.0, False)
    assert at[2] == (minute(3 * day + 5), minute(3 * day + 5), 1, 4.0, True)
    assert at[4] == (minute(3 * day), minute(3 * day), 1, 1.0, True) and at[5][2:] == (1, 0.0, True)
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(held) >= 4 and held[-1] == 3  # users 1 and 3 have left


def test_spans_do_not_hang_on_the_batches(spark, tmp_path):
    rng = random.Random(4)
    events = sorted((rng.randint(0, 6000), rng.randint(1, 4)) for _ in range(200))
    events = [(n, m, u, rng.choice(["view", "purchase"]), 3) for n, (m, u) in enumerate(events)]
    results = []
    for cuts in ((200,), (50, 120, 200)):
        folder = write_files(spark, tmp_path / str(len(cuts)), *[events[a:b] for a, b in zip((0, *cuts), cuts)])
        got = sinks.drain_updates(users.user_activity(stream_of(spark, folder), idle_minutes=90), "u", ["user_id"])
        results.append(rows(got.drop("batch_id"), "user_id"))
    assert results[0] == results[1]


def test_progress_rows(spark, tmp_path):
    folder = write_files(
        spark, tmp_path,
        [(1, 500, 1, "view", 1)],
        [(2, 501, 1, "view", 1)],
        [(3, 5, 1, "view", 1), (4, 6, 1, "view", 1), (5, 502, 1, "view", 1)],
    )
    log = progress.ProgressLog(spark, str(tmp_path / "log"), frozenset({"mine"}))
    with log:
        other = sinks.append_table(stream_of(spark, folder), str(tmp_path / "o"), str(tmp_path / "os"), sinks.until_done(), "other")
        other.awaitTermination()
        once = stream_of(spark, folder).withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
        sinks.append_table(once, str(tmp_path / "d"), str(tmp_path / "ds"), sinks.until_done(), "mine").awaitTermination()
        log.wait()
    batches = rows(log.table().select("query", "batch_id", "input_rows", "dropped_rows").where("input_rows > 0"), "batch_id")
    assert batches == [("mine", 0, 1, 0), ("mine", 1, 1, 0), ("mine", 2, 3, 2)]
    assert progress.totals(log.table()).first().most_state_rows == 3
    log.flush()  # nothing new: no rows are written twice
    assert log.table().where("input_rows > 0").count() == 3


def test_compaction_keeps_the_newest_revision(spark, tmp_path):
    """Folders follow the keys, not the batches; leftovers of a crash change nothing; a rerun gives the same table."""
    schema = spark.createDataFrame([], "k long, v long").schema
    path = str(tmp_path / "t")
    for batch in range(5):
        data = [(k, 10 * batch + k) for k in range(batch, 4)] or [(9, 9)]
        spark.createDataFrame(data, schema).write.parquet(f"{path}/batch_id={batch}")
    want = rows(sinks.newest_per_key(sinks.read_updates(spark, path, schema), ["k"]), "k")
    assert want == [(0, 0), (1, 11), (2, 22), (3, 33), (9, 9)]
    for _ in range(2):
        sinks.compact_updates(spark, path, schema, ["k"], 3)
        assert rows(sinks.newest_per_key(sinks.read_updates(spark, path, schema), ["k"]), "k") == want
    assert sinks._folders(spark, path) == ["batch_id=4"] and sinks._folders(spark, f"{path}-base") == ["upto=3"]
    spark.createDataFrame([(0, -1)], schema).write.parquet(f"{path}/batch_id=2")  # a crash left an old batch
    assert rows(sinks.newest_per_key(sinks.read_updates(spark, path, schema), ["k"]), "k") == want
    sinks.compact_updates(spark, path, schema, ["k"], 4)
    assert rows(sinks.newest_per_key(sinks.read_updates(spark, path, schema), ["k"]), "k") == want
    assert sinks._folders(spark, path) == []


def test_compacted_stream_equals_the_batch(spark, tmp_path):
    folder = write_files(spark, tmp_path, *[[(n, n, n % 2, "purchase", n)] for n in range(6)])
    got = sinks.drain_updates(live.user_state(stream_of(spark, folder)), "u", ["user_id"], compact_every=2)
    assert [(r.user_id, r.events, float(r.spend)) for r in got.orderBy("user_id").collect()] == [(0, 3, 6.0), (1, 3, 9.0)]
