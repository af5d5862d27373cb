"""Where streams end: Parquet tables in storage all executors share, written so that a retry adds nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from salesloom.operators import partials
from salesloom.operators.load import upsert
from salesloom.operators.summaries import daily_sales_summary
from salesloom.session import cut_lineage, folders_in, remove_folder, scratch_path
from salesloom.sources.layout import Layout

ORDER_STATES = ("processed_data", "order_states")
DAILY_TABLE = ("analytics", "daily_sales_summary")

DAILY_FIGURES = (
    "total_orders",
    "total_revenue",
    "total_profit",
    "total_customers",
    "new_customers",
    "repeat_customers",
    "avg_line_value",
    "avg_order_value",
)


def live_trigger(seconds: int = 5) -> dict[str, str]:
    """The dashboard's refresh."""
    return {"processingTime": f"{seconds} seconds"}


def until_done() -> dict[str, bool]:
    """All data there is now, then stop."""
    return {"availableNow": True}


def append_table(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict, name: str | None = None
) -> StreamingQuery:
    """Append mode into Spark's own exactly-once Parquet sink."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**trigger).start(path)


def write_metrics(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict,
    mode: str = "update",
    keys: Sequence[str] | None = None,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Each batch into its own folder; a repeated batch overwrites itself.

    With ``keys`` and ``compact_every`` the folders are folded together after every so many batches, so that the table
    follows the number of keys, not that of the revisions.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_updates(batch.sparkSession, path, stream.schema, keys or (), batch_id)

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete tables below a path."""
    return folders_in(spark, path, "_SUCCESS")


def read_updates(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All stored revisions with their ``batch_id``: the newest compacted table and the batches after it.

    Batches that the compacted table already holds may still lie there; their rows lose against its own.
    """
    fields = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    bases = sorted(int(n.rpartition("=")[2]) for n in _folders(spark, f"{path}-base"))
    upto = bases[-1] if bases else -1
    later = [n for n in _folders(spark, path) if int(n.rpartition("=")[2]) > upto]
    parts = []
    if later:
        paths = [f"{path}/{n}" for n in later]
        parts.append(spark.read.schema(fields).option("basePath", path).parquet(*paths))
    if bases:
        parts.append(spark.read.schema(fields).parquet(f"{path}-base/upto={upto}"))
    if not parts:
        return spark.createDataFrame([], fields)
    return reduce(DataFrame.unionByName, [p.select(fields.names) for p in parts])


def compact_updates(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], upto: int) -> None:
    """Folds the batches up to ``upto`` into one table with the newest revision of every key.

    The new table is whole before anything goes: until then readers take the old one and the batches, and a crash
    leaves folders that the next compaction removes. A rerun writes the same table.
    """
    every = read_updates(spark, path, schema)
    held = every.where(F.col("batch_id") <= upto)
    values = [c for c in held.columns if c not in keys]
    last = F.max_by(F.struct(*values), "batch_id").alias("_v")
    newest = (held.groupBy(*keys) if keys else held).agg(last).select(*keys, "_v.*").where("batch_id IS NOT NULL")
    merged = cut_lineage(newest.select(every.columns), "compacted")
    merged.write.mode("overwrite").parquet(f"{path}-base/upto={upto}")
    for name in _folders(spark, f"{path}-base"):
        if int(name.rpartition("=")[2]) < upto:
            remove_folder(spark, f"{path}-base/{name}")
    for name in _folders(spark, path):
        if int(name.rpartition("=")[2]) <= upto:
            remove_folder(spark, f"{path}/{name}")


def newest_per_key(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last revision of every key of an update-mode table."""
    values = [c for c in table.columns if c not in keys and c != "batch_id"]
    last = F.max_by(F.struct(*values), "batch_id").alias("_v")
    if not keys:
        return table.agg(last).select("_v.*")
    return table.groupBy(*keys).agg(last).select(*keys, "_v.*")


def drain_append(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode query over the data at hand and read its table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    append_table(stream, path, scratch_path(spark, f"{name}-state"), until_done()).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_updates(
    stream: DataFrame, name: str, keys: Sequence[str], mode: str = "update", compact_every: int | None = None
) -> DataFrame:
    """Run an update-mode query over the data at hand and read the last revision per key."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    write_metrics(stream, path, state, until_done(), mode, keys, compact_every).awaitTermination()
    return newest_per_key(read_updates(spark, path, stream.schema), keys)


def drain_sessions(stream: DataFrame, events: DataFrame, sessions: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sessions of a finished input: those the watermark closed, and those still open over the events left.

    Session windows have no update mode. ``events`` is the input as a batch; a user's events from the end of the last
    closed session on are the ones the stream still held.
    """
    closed = drain_append(sessions(stream), "sessions")
    until = closed.groupBy("user_id").agg(F.max("window_end").alias("_until"))
    left = events.join(until, "user_id", "left").where("_until IS NULL OR ts >= _until").drop("_until")
    return closed.unionByName(sessions(left))


class DailySummaryMerger:
    """``foreachBatch`` function: new sales lines in, the daily summary of the touched months kept up to date.

    The state has a row per order, so that an order's lines may come in different batches. Batch n merges its lines into
    the months that they touch, as batch n - 1 left them, and writes those months of state and summary under its own
    number: a repeated batch gives the same tables, and no line of an earlier batch is read again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.layout, self.last = spark, Layout(root), None

    @staticmethod
    def version(batch_id: int) -> str:
        return f"batch-{batch_id}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, layout, now = self.spark, self.layout, self.version(batch_id)
        before = self.version(batch_id - 1) if batch_id > 0 else None
        delta = cut_lineage(partials.orders(batch), "order-delta")
        touched = partials.parts_of(delta, "order_month")
        states = [delta] if before is None else [delta, layout.read_parts(spark, *ORDER_STATES, before, touched)]
        layout.write_parts(partials.ORDERS.merged(*states), *ORDER_STATES, now, "order_month", before)
        months = layout.read_parts(spark, *ORDER_STATES, now, touched)
        fresh = daily_sales_summary(months).withColumn("order_month", partials.month_of("date"))
        if before is not None:
            known = layout.read_parts(spark, *DAILY_TABLE, before, touched)
            fresh = upsert(known, fresh, ["date", "order_month"], DAILY_FIGURES)
        layout.write_parts(fresh, *DAILY_TABLE, now, "order_month", before)
        self.last = batch_id

    def table(self) -> DataFrame:
        """The summary after the last batch."""
        return self.layout.read(self.spark, *DAILY_TABLE, self.version(self.last))


def drain_daily_summary(lines: DataFrame) -> DataFrame:
    """Run the merger over all lines a stream has at hand and read its table."""
    spark = lines.sparkSession
    merger = DailySummaryMerger(spark, scratch_path(spark, "daily-summary"))
    query = lines.writeStream.foreachBatch(merger).option("checkpointLocation", scratch_path(spark, "daily-state"))
    query.trigger(**until_done()).start().awaitTermination()
    return merger.table()
