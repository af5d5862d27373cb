"""Tables stored in buckets of a key, so that joins and groupings by that key need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from salesloom.session import scratch_path


def store_bucketed(df: DataFrame, key: str, buckets: int, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a table with one sorted file per bucket of ``key``, and the table read back.

    The rows shuffle once, here, instead of in every join by the key. Tables to be joined take the same number of
    buckets: about their size over what a task should hold. ``path`` defaults to the run's shared folder; the table's
    name is the session catalog's, where a bucketed table must be entered to be read as one.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path or scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)
