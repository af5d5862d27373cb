"""Feeds in any built-in format, conformed to a declared schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.schemas import DEFAULTS


@dataclass(frozen=True)
class Feed:
    """One source of a staging table: a Spark format, where it lies, and reader options."""

    fmt: str
    path: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    schema: T.StructType | None = None


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """Exactly the columns of ``schema``, cast; absent columns are NULL, then defaults fill NULLs."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        c = c.cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(out)


def read_feed(spark: SparkSession, feed: Feed) -> DataFrame:
    reader = spark.read.format(feed.fmt).options(**dict(feed.options))
    if feed.schema is not None:
        reader = reader.schema(feed.schema)
    return reader.load(feed.path) if feed.path else reader.load()


def ingest(
    spark: SparkSession,
    feeds: Iterable[Feed],
    schema: T.StructType,
    defaults: Mapping[str, object] = DEFAULTS,
) -> DataFrame:
    """All feeds of one staging table under one schema."""
    parts = [conform(read_feed(spark, f), schema, defaults) for f in feeds]
    if not parts:
        raise ValueError("no feeds given")
    return reduce(DataFrame.unionByName, parts)


def load_replace(df: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """Full refresh of a staging table: conform, overwrite, read back under the declared schema."""
    conform(df, schema).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
