"""Exact money. Tables hold DECIMAL; lines are priced and summed as BIGINT cents.

Decimal division and sums allocate an object per row, integer arithmetic does not. Everything is exact
either way: rounding is half away from zero, products too long for BIGINT take the decimal road, and
an overflowing sum raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.schemas import MONEY, PERCENT, TOTAL

_SAFE = 2_000_000_000  # twice the product of two such factors still fits BIGINT
_HUNDREDTH = ("0.01", "decimal(2,2)")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def money(c: Column | str) -> Column:
    """To DECIMAL(12,2), rounding half up."""
    return col(c).cast(MONEY)


def hundredths(df: DataFrame, column: str) -> Column:
    """A DOUBLE or DECIMAL column as a whole number of hundredths (cents, basis points)."""
    return F.expr(hundredths_sql(column, df.schema[column].dataType))


def hundredths_sql(c: str, kind: T.DataType) -> str:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        size = f"CAST(abs({c}) * 100 + 0.5D AS BIGINT)"
        return f"IF({c} < 0, -{size}, {size})"
    return f"CAST(CAST({c} AS DECIMAL(20,2)) * 100 AS BIGINT)"


def divide_half_up_sql(num: str, den: str) -> str:
    """Integer quotient rounded half away from zero; NULL for a zero divisor."""
    size = f"((abs({num}) * 2 + abs({den})) DIV (nullif(abs({den}), 0) * 2))"
    return f"IF((({num}) < 0) <> (({den}) < 0), -{size}, {size})"


def scaled(amount: str, num: str, den: str) -> Column:
    """``amount * num / den`` over integer SQL expressions, rounded half away from zero.

    NULL for a zero divisor.
    """
    wide = f"CAST(({amount}) AS DECIMAL(19,0)) * CAST(({num}) AS DECIMAL(19,0))"
    exact = f"try_divide(CAST({wide} AS DECIMAL(28,0)), CAST(({den}) AS DECIMAL(19,0)))"
    return F.expr(
        f"IF(abs({amount}) < {_SAFE} AND abs({num}) < {_SAFE}, "
        f"{divide_half_up_sql(f'({amount}) * ({num})', den)}, CAST(round({exact}, 0) AS BIGINT))"
    )


def from_cents(c: Column | str, kind: T.DecimalType = TOTAL) -> Column:
    """Cents (BIGINT or DECIMAL without fraction) as a DECIMAL amount."""
    value, digits = _HUNDREDTH
    return (col(c).cast("decimal(20,0)") * F.lit(value).cast(digits)).cast(kind)


def dollars(c: Column | str) -> Column:
    """Cents as a double amount, for ratios."""
    return dbl(c) / F.lit(100.0)


def grand(c: Column | str) -> Column:
    """Sum of sums: decimal, because a whole warehouse in cents may pass BIGINT."""
    return F.sum(col(c).cast("decimal(20,0)"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` in doubles; NULL where ``den`` is zero or NULL."""
    return F.try_divide(dbl(num), dbl(den))


def ratio_or_zero(num: Column | str, den: Column | str) -> Column:
    """``num / den`` in doubles, 0 where there is nothing to divide by."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def ratio_at_least_one(num: Column | str, den: Column | str) -> Column:
    """``num / max(1, den)``, the rule of daily rows."""
    return dbl(num) / dbl(F.greatest(col(den), F.lit(1)))


def margin_percentage(price: Column | str, cost: Column | str) -> Column:
    """List margin in percent, two digits; NULL for a zero or missing price."""
    p, c = col(price), col(cost)
    return F.round(F.try_divide((p - c) * F.lit(100).cast("decimal(3,0)"), p), 2).cast(PERCENT)


def gigabytes(num_bytes: Column | str) -> Column:
    return dbl(num_bytes) / F.lit(float(1 << 30))


def percent(share: Column | str) -> Column:
    return dbl(share) * F.lit(100.0)
