"""Load operators keyed by business ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.session import cut_lineage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key; the filter on the row number lets each task drop copies before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def insert_ignore(
    target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """``target`` plus the source rows whose key it lacks; copies of a new key collapse to the first."""
    fresh = first_per_key(new_rows(target, source, keys), keys, order)
    return target.unionByName(fresh, allowMissingColumns=True)


def new_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return source.join(target.select(*keys), list(keys), "left_anti")


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], update_cols: Sequence[str]
) -> DataFrame:
    """``target`` with ``update_cols`` taken from matching source rows, and unmatched source rows added.

    Other columns keep the target's value. Two source rows with one key raise when the plan runs.
    """
    values = [c for c in source.columns if c not in keys]
    once = (
        source.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_copies"), F.any_value(F.struct(F.lit(True).alias("_hit"), *values)).alias("_s"))
        .withColumn(
            "_s",
            F.when(F.col("_copies") > 1, F.raise_error(F.lit(f"upsert: duplicate key in source ({', '.join(keys)})")))
            .otherwise(F.col("_s")),
        )
        .select(*keys, "_s")
    )
    there = target.withColumn("_kept", F.lit(True))
    joined = there.join(once, list(keys), "full_outer")
    incoming = F.col("_s._hit").isNotNull()
    absent = F.col("_kept").isNull()
    out = []
    for c in target.columns:
        if c in keys or c not in values:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(incoming, F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(absent, F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(out)


def write_partitioned(df: DataFrame, path: str, part: str) -> None:
    """Replaces the partitions that ``df`` has rows of; the files of all others stay as they are."""
    rebalanced = df.hint("rebalance", part)
    rebalanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def touched_parts(target: DataFrame, source: DataFrame, part: str) -> DataFrame:
    """The target's partitions that the source has rows of; the others are pruned from the scan.

    ``part`` is a coarse column (a month, a bucket), whose values in the source are collected.
    """
    parts = [r[0] for r in source.select(part).distinct().collect()]
    return target.where(F.col(part).isin(parts))


def upsert_partitioned(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    part: str,
) -> None:
    """``upsert`` into a stored table, partition by partition.

    ``part`` must follow from the keys and be non-null. The merged rows are staged before the first file is replaced,
    since they are read from the partitions that go; as an upsert sets values, a rerun after a failure gives the same
    table. The source is staged too, being read for its partitions and for its rows.
    """
    staged = cut_lineage(source, "upsert-source")
    target = touched_parts(spark.read.schema(schema).parquet(path), staged, part)
    merged = upsert(target, staged, [*keys, part], update_cols)
    write_partitioned(cut_lineage(merged, "upsert-merged"), path, part)
