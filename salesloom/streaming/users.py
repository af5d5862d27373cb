"""Running figures per user whose state leaves after an idle time.

The built-in aggregations drop state with a window or never. A user's span has no bounds known beforehand, so an
event-time timer ends it: the one stateful operator here that Spark's own aggregations cannot say.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from salesloom.functions.money import from_cents
from salesloom.streaming.live import DELAY

STATE = "first_ms long, last_ms long, events long, cents long"
OUT = f"user_id long, {STATE}, active boolean"


def _spans(idle_ms: int):
    """The update function; nested, so that workers get it by value."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["user_id", "first_ms", "last_ms", "events", "cents", "active"]
        if state.hasTimedOut:
            gone = state.get
            state.remove()
            yield pd.DataFrame([(key[0], *gone, False)], columns=names)
            return
        rows = pd.concat(list(frames)).sort_values("ms", kind="stable")
        ms, cents = rows["ms"].to_numpy(), rows["cents"].to_numpy()
        # Only the last span counts: the rows after the last pause, and the state if no pause lies between.
        pauses = (ms[1:] - ms[:-1] > idle_ms).nonzero()[0]
        start = int(pauses[-1]) + 1 if len(pauses) else 0
        span = (int(ms[start]), int(ms[-1]), len(ms) - start, int(cents[start:].sum()))
        if state.exists and start == 0 and span[0] - state.get[1] <= idle_ms:
            first, last, events, spent = state.get
            span = (min(first, span[0]), max(last, span[1]), events + span[2], spent + span[3])
        state.update(span)
        state.setTimeoutTimestamp(max(span[1] + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *span, True)], columns=names)

    return update


def user_activity(events: DataFrame, idle_minutes: int = 24 * 60, delay: str = DELAY) -> DataFrame:
    """Update mode: a user's current span of activity after each batch, and once more, inactive, when it has ended.

    A span ends by a pause longer than the idle time; what comes later starts the next one. The state has a row for
    each user seen within the idle time, so it follows the users at work, not all users ever. A batch's events of one
    user are sorted in one task: what bounds them is the batch.
    """
    spent = F.when(F.col("event_type") == "purchase", (F.col("value") * 100).cast("long")).otherwise(F.lit(0).cast("long"))
    slim = events.withWatermark("ts", delay).select(
        "user_id", "ts", F.unix_millis("ts").alias("ms"), F.coalesce(spent, F.lit(0)).cast("long").alias("cents")
    )
    spans = slim.groupBy("user_id").applyInPandasWithState(
        _spans(idle_minutes * 60_000), OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )

    def moment(c: str) -> Column:
        return F.timestamp_millis(c).alias(c.replace("_ms", "_seen"))

    return spans.select(
        "user_id", moment("first_ms"), moment("last_ms"), "events", from_cents("cents").alias("spend"), "active"
    )
