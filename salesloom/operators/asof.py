"""Features as of a moment: for each example the entity's last state before it, so that a training set cannot see ahead.

Both sides are united and sorted by time per entity; an example takes the last state above it. There is no range join.
An entity with very many rows is cut into chunks of time, and each chunk starts from the last state of those before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.money import from_cents


def running_features(totals: DataFrame) -> DataFrame:
    """The state of each customer after each day with orders: orders, money and first day so far."""
    days = totals.groupBy("customer_id", F.col("order_day").alias("known_on")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue_cents").alias("cents")
    )
    so_far = Window.partitionBy("customer_id").orderBy("known_on").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(
        "customer_id",
        "known_on",
        F.sum("orders").over(so_far).alias("frequency"),
        from_cents(F.sum("cents").over(so_far)).alias("monetary"),
        F.min("known_on").over(so_far).alias("first_day"),
    )


def as_of(
    examples: DataFrame,
    states: DataFrame,
    entity: str,
    at: str,
    known: str,
    values: Sequence[str],
    chunk: Column,
    state_chunk: Column,
) -> DataFrame:
    """Every example with ``values`` and the time of the entity's last state strictly before it; nulls if there is none.

    ``at`` and ``known`` are the times of examples and states; ``chunk`` and ``state_chunk`` put a time of either side
    into a whole number that doesn't fall as time rises (a year, a month). Of states with one time the greatest counts.
    """
    state = F.struct(F.col(known).alias("_known"), *values)
    # At one moment examples come first: what becomes known then is not known before.
    asked = examples.select(F.struct(*examples.columns).alias("_row"), F.col(entity).alias("_entity"), F.col(at).alias("_time"),
                            F.lit(0).alias("_side"), chunk.cast("long").alias("_chunk"), F.lit(None).cast(states.select(state).schema[0].dataType).alias("_state"))
    told = states.select(F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col(entity).alias("_entity"), F.col(known).alias("_time"),
                         F.lit(1).alias("_side"), state_chunk.cast("long").alias("_chunk"), state.alias("_state"))
    both = asked.unionByName(told)
    # A row per entity and chunk carries the last state over to later chunks. Chunks of examples are told apart by their
    # two numbers alone: an aggregate that has a struct beside them would sort every example before it shuffles.
    ends = told.groupBy("_entity", "_chunk").agg(F.max("_state").alias("_end"))
    ends = ends.unionByName(asked.select("_entity", "_chunk").distinct(), allowMissingColumns=True)
    earlier = Window.partitionBy("_entity").orderBy("_chunk").rangeBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("_start", F.last("_end", ignorenulls=True).over(earlier)).where("_end IS NULL").drop("_end")
    inside = (
        Window.partitionBy("_entity", "_chunk").orderBy("_time", "_side", "_state").rowsBetween(Window.unboundedPreceding, -1)
    )
    found = both.withColumn("_inside", F.last("_state", ignorenulls=True).over(inside)).where("_side = 0")
    joined = found.join(starts, ["_entity", "_chunk"])
    seen = F.coalesce("_inside", "_start")
    return joined.select("_row.*", seen["_known"].alias(known), *[seen[v].alias(v) for v in values])
