"""Additive forecast: a trend, a yearly and a weekly shape, by least squares per category.

The basis is rounded to millionths, so that the normal equations are sums of whole numbers: exact, in whatever order
Spark adds them. They are solved per category by a fixed elimination in column expressions.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.money import dbl

#: Millionths, days that the trend counts as one, and the shapes as (days of a period, waves).
UNIT, TREND_DAYS = 1_000_000, 1000
SHAPES = ((365.25, 2), (7.0, 3))

WHOLE = "decimal(20,0)"


def basis(day: Column, origin: dt.date, shapes: Sequence[tuple[float, int]] = SHAPES) -> list[Column]:
    """Whole millionths of 1, the trend, and a sine and cosine for each wave."""
    t = F.datediff(day, F.lit(origin))
    out = [F.lit(UNIT).cast("long"), (t * (UNIT // TREND_DAYS)).cast("long")]
    for period, waves in shapes:
        for k in range(1, waves + 1):
            angle = dbl(t) * F.lit(2 * math.pi * k / period)
            out += [F.round(fn(angle) * UNIT).cast("long") for fn in (F.sin, F.cos)]
    return out


def normal_equations(rows: DataFrame, key: str, day: str, value: str, origin: dt.date) -> DataFrame:
    """Per key the matrix of X'X beside X'y, as rows of doubles; ``value`` is a whole number."""
    x = basis(F.col(day), origin)
    named = rows.select(key, day, F.col(value).cast(WHOLE).alias("_y"), *[c.cast(WHOLE).alias(f"_x{i}") for i, c in enumerate(x)])
    n = len(x)
    sums = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"_s{i}_y") for i in range(n)]
    found = named.groupBy(key).agg(*sums, F.max(day).alias("last"))

    def entry(i: int, j: int) -> Column:
        return dbl(f"_s{min(i, j)}_{max(i, j)}") / F.lit(float(UNIT) * UNIT)

    matrix = F.array(
        *[F.array(*[entry(i, j) for j in range(n)], dbl(f"_s{i}_y") / F.lit(float(UNIT))) for i in range(n)]
    )
    return found.select(key, "last", matrix.alias("equations"))


def solved(equations: Column, n: int) -> Column:
    """The solution by elimination down the diagonal; X'X is positive definite, so no rows change places.

    A column that hangs on the others (a series shorter than the basis) leaves a zero pivot and gives nulls.
    """

    def step(m: Column, k: Column) -> Column:
        pivot = F.element_at(m, k + 1)
        scale = F.try_divide(F.lit(1.0), F.element_at(pivot, k + 1))

        def row(r: Column, i: Column) -> Column:
            share = F.element_at(r, k + 1) * scale
            return F.when(i == k, F.transform(r, lambda v: v * scale)).otherwise(
                F.zip_with(r, pivot, lambda a, b: a - share * b)
            )

        return F.transform(m, row)

    reduced = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), equations, step)
    return F.transform(reduced, lambda r: F.element_at(r, -1))


def forecast_additive(
    by_category: DataFrame, origin: dt.date, ahead: int = 28, until: dt.date | None = None
) -> DataFrame:
    """Revenue of the ``ahead`` days after the last one, per category.

    ``by_category`` has a row per category and day with ``revenue`` (days without sales as 0); with ``until`` only the
    days before it are learnt from.
    """
    rows = by_category if until is None else by_category.where(F.col("date") < F.lit(until))
    cents = rows.withColumn("_cents", (F.col("revenue") * 100).cast(WHOLE))
    n = len(basis(F.lit(origin), origin))
    fitted = normal_equations(cents, "category", "date", "_cents", origin)
    fitted = fitted.select("category", "last", solved(F.col("equations"), n).alias("weights"))
    steps = fitted.select("category", "weights", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step"), "last")
    days = steps.select("category", "weights", F.date_add("last", F.col("step")).alias("date"))
    terms = [F.col("weights")[i] * dbl(c) / F.lit(float(UNIT)) for i, c in enumerate(basis(F.col("date"), origin))]
    value = reduce(lambda a, b: a + b, terms) / F.lit(100.0)
    return days.select("category", "date", value.cast("decimal(18,2)").alias("forecast"))
