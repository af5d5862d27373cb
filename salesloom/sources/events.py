"""Event streams: files here, a broker in production; one parser for both."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom import schemas
from salesloom.sources.staging import parse_events


def file_events(spark: SparkSession, folder: str, options: Mapping[str, str] | None = None) -> DataFrame:
    path = f"{folder.rstrip('/')}/events.parquet*"  # a pattern: one file or a folder of files
    raw = spark.readStream.schema(schemas.FILES["events"]).options(**dict(options or {})).parquet(path)
    return parse_events(raw)


def decode_messages(messages: DataFrame) -> DataFrame:
    """Broker messages (``value`` holds JSON) to the file columns; works on batch and stream."""
    body = F.from_json(F.col("value").cast("string"), schemas.FILES["events"])
    return messages.select(body.alias("e")).select("e.*")


def broker_events(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Needs the Kafka connector package on the class path."""
    return parse_events(decode_messages(spark.readStream.format("kafka").options(**dict(options)).load()))


def event_stream(spark: SparkSession, folder: str | None = None, **options: str) -> DataFrame:
    """``folder`` reads files; otherwise the options address a broker."""
    if folder is not None:
        return file_events(spark, folder, options)
    return broker_events(spark, options)
