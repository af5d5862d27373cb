"""Positions, tiles and running sums in a global order, without a single-task window.

Rows are range-partitioned and sorted once; that frame is written out, because a recomputed range
partitioning may cut elsewhere. One small row per partition then carries what lies before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.session import cut_lineage

_SLOT_BITS = 33  # fixed by monotonically_increasing_id: partition above, row number below


def _placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    slot = F.monotonically_increasing_id()
    placed = ranged.withColumn("_slot", slot)
    placed = placed.withColumns(
        {
            "_part": F.shiftright("_slot", _SLOT_BITS),
            "_row": F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)),
        }
    )
    return cut_lineage(placed.drop("_slot"), "ordered")


def _with_offsets(placed: DataFrame, measure: Column) -> DataFrame:
    """Adds ``_before`` (measure of earlier partitions) and ``_grand``; the joined side has one row per partition."""
    parts = placed.groupBy("_part").agg(measure.alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_part",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy()).alias("_grand"),
    )
    return placed.join(F.broadcast(offsets), "_part")


def with_position(
    df: DataFrame, order: Sequence[Column | str], name: str, start: int = 1, total: str | None = None
) -> DataFrame:
    """Dense position of each row in the order, which must be total (end it with a unique id)."""
    out = _with_offsets(_placed(df, order), F.count(F.lit(1)))
    out = out.withColumn(name, F.col("_before") + F.col("_row") + F.lit(start))
    if total:
        out = out.withColumn(total, F.col("_grand"))
    return out.drop("_part", "_row", "_before", "_grand")


def with_tile(df: DataFrame, order: Sequence[Column | str], tiles: int, name: str) -> DataFrame:
    """The tile 1..``tiles`` of each row, as NTILE gives it; larger tiles come first."""
    out = with_position(df, order, "_n", total="_total")
    n, k = F.col("_n"), F.lit(tiles)
    low = F.floor(F.col("_total") / k)
    extra = F.col("_total") % k
    head = extra * (low + 1)
    in_head = F.floor((n - 1) / (low + 1)) + 1
    in_tail = extra + F.floor((n - 1 - head) / F.greatest(low, F.lit(1))) + 1
    return out.withColumn(name, F.when(n <= head, in_head).otherwise(in_tail).cast("int")).drop("_n", "_total")


def with_running_sum(
    df: DataFrame, order: Sequence[Column | str], value: str, name: str, total: str
) -> DataFrame:
    """Sum of ``value`` up to and including each row, and the grand total on every row."""
    out = _with_offsets(_placed(df, order), F.sum(value))
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn(name, F.col("_before") + F.sum(value).over(inside))
    return out.withColumn(total, F.col("_grand")).drop("_part", "_row", "_before", "_grand")


def assign_keys(df: DataFrame, order: Sequence[Column | str], key: str, start: int = 1) -> DataFrame:
    """Surrogate keys ``start``, ``start + 1``, ... in the given order."""
    out = with_position(df, order, key, start)
    return out.select(key, *df.columns)
