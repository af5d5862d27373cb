"""Warehouse tables over JDBC: configuration of Spark's own connector."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def partitioned(column: str, lower: str, upper: str, partitions: int) -> dict[str, str]:
    """Options for a parallel read; without them one task pulls the whole table."""
    if partitions < 1:
        raise ValueError("partitions must be positive")
    return {
        "partitionColumn": column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": str(partitions),
    }


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    options: Mapping[str, str] | None = None,
    split: Mapping[str, str] | None = None,
) -> DataFrame:
    settings = {"url": url, "dbtable": table, "fetchsize": "10000", **(options or {}), **(split or {})}
    return spark.read.format("jdbc").options(**settings).load()


def write_jdbc(
    df: DataFrame, url: str, table: str, mode: str = "append", options: Mapping[str, str] | None = None
) -> None:
    settings = {"url": url, "dbtable": table, "batchsize": "10000", **(options or {})}
    df.write.format("jdbc").options(**settings).mode(mode).save()
