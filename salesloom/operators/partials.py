"""Mergeable partial aggregates: stored state that a load adds its own lines to, without history.

Every column of a state is a sum, a minimum or a maximum, so that two states of disjoint lines merge into that of both.
Distinct counts come from states with a row for each thing counted. Lines arrive by whole orders in a daily load, which
makes a product's order counts additive; a stream, which may split an order, keeps a row per order.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.operators.summaries import ORDER_COLUMNS, order_totals

_HOW = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class State:
    """``part`` is the column a stored state is partitioned by; it follows from the keys."""

    part: str
    keys: tuple[str, ...]
    values: Mapping[str, str]

    def merged(self, *states: DataFrame, part: Column | None = None) -> DataFrame:
        """One state of all; rows of a key meet after a partial aggregation.

        ``part``, in terms of the keys, is put to the merged rows; without it the states have the column.
        """
        keys = self.keys if part is not None else (self.part, *self.keys)
        columns = [*keys, *self.values]
        every = states[0].select(columns)
        for more in states[1:]:
            every = every.unionByName(more.select(columns))
        out = every.groupBy(*keys).agg(*[_HOW[how](c).alias(c) for c, how in self.values.items()])
        return out if part is None else out.withColumn(self.part, part)


CUSTOMER_DAYS = State(
    "order_month",
    ("order_day", "customer_id"),
    {"registration_date": "max", "orders": "sum", "lines": "sum", "revenue_cents": "sum", "profit_cents": "sum"},
)
ORDERS = State(
    "order_month",
    ORDER_COLUMNS,
    {"lines": "sum", "quantity": "sum", "revenue_cents": "sum", "profit_cents": "sum"},
)
CUSTOMERS = State(
    "bucket",
    ("customer_id",),
    {
        "registration_date": "max", "orders": "sum", "lines": "sum", "revenue_cents": "sum", "profit_cents": "sum",
        "first_day": "min", "last_day": "max",
    },
)
PRODUCTS = State(
    "bucket",
    ("product_id",),
    {
        "revenue_cents": "sum", "profit_cents": "sum", "quantity": "sum", "orders": "sum", "margin_points": "sum",
        "margin_lines": "sum", "last_sale_date": "max",
    },
)


def month_of(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of an id, as text of one width."""
    return F.lpad(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"), 4, "0")


def customer_days(sales: DataFrame) -> DataFrame:
    """Each order as a row of the state of days, to be merged."""
    return order_totals(sales).withColumn("orders", F.lit(1).cast("long"))


def orders(sales: DataFrame) -> DataFrame:
    return order_totals(sales).withColumn("order_month", month_of("order_day"))


def customers(days: DataFrame) -> DataFrame:
    """Each customer's day as a row of the state of customers, to be merged."""
    return days.withColumns({"first_day": F.col("order_day"), "last_day": F.col("order_day")})


def parts_of(state: DataFrame, part: str) -> list[str]:
    """The partitions that a state touches: months or buckets, never more than those."""
    return sorted(r[0] for r in state.select(part).distinct().collect())
