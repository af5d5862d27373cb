"""Threshold bands of dashboard figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bound and colour, lowest first; the first bound is open below.
REVENUE_BANDS = ((None, "red"), (10000, "yellow"), (50000, "green"))
ORDER_BANDS = ((None, "red"), (100, "yellow"), (500, "green"))
CUSTOMER_BANDS = ((None, "red"), (50, "yellow"), (200, "green"))
CPU_BANDS = ((None, "green"), (70, "yellow"), (90, "red"))


def band(value: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Colour of the highest band whose lower bound ``value`` reaches; NULL for NULL."""
    out = F.lit(bands[0][1])
    for lower, colour in bands[1:]:
        out = F.when(value >= F.lit(lower), F.lit(colour)).otherwise(out)
    return F.when(value.isNotNull(), out)
