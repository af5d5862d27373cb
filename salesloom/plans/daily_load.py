"""The daily load: staging to star, summaries and features, each stage a table of its own.

Dimensions are written whole per load; the fact is append-only, one folder per load below which it is partitioned by
month. Summaries and features rest on stored partial aggregates (``operators.partials``): a load merges what its own
lines add, and rewrites the months and buckets that they touch. Of earlier lines it reads the order ids of the months
that its feed has orders in, no others. A load that runs twice replaces its own folders, so nothing is counted twice.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from salesloom.operators import dimensions, facts, features, partials, products, summaries
from salesloom.operators.calendar import dim_date_of
from salesloom.operators.load import upsert
from salesloom.operators.partials import State
from salesloom.sources.layout import Layout
from salesloom.sources.staging import Staging
from salesloom.streaming.sinks import DAILY_FIGURES

LOAD_ID = re.compile(r"[A-Za-z0-9_-]+")
CHAIN = "position int, load_id string"
FEATURE, VALUE = ("feature_name",), ("feature_value",)

PERFORMANCE_FIGURES = (
    "total_sales",
    "total_quantity",
    "total_orders",
    "profit_margin",
    "last_sale_date",
)


def _records(seen: Observation) -> int:
    """Rows of a write that has ended; a plan that turned out empty while it ran reports none."""
    try:
        return seen.get["records"]
    except Py4JJavaError:
        return 0


@dataclass(frozen=True)
class DailyLoad:
    layout: Layout
    load_id: str
    load_date: dt.date
    previous: str | None = None
    buckets: int = 64  # parts of customers and of products; the same for all loads of a layout

    def __post_init__(self) -> None:
        for name in (self.load_id, self.previous):
            if name is not None and not LOAD_ID.fullmatch(name):
                raise ValueError(f"a load id has letters, digits, _ and - only: {name!r}")
        if self.previous == self.load_id:
            raise ValueError("a load cannot follow itself")

    def run(self, spark: SparkSession, staging: Staging) -> DataFrame:
        """All stages in order; the result is one row per stage with the records it wrote."""
        counts: list[tuple[str, int]] = []
        earlier = self._earlier(spark)
        self.layout.write(
            spark.createDataFrame([(n, i) for n, i in enumerate([*earlier, self.load_id])], CHAIN),
            "processed_data", "load_chain", self.load_id,
        )
        buyers = self._store(spark, counts, "processed_data", "dim_customers", self._customers(spark, staging))
        goods = self._store(spark, counts, "processed_data", "dim_products", self._products(spark, staging))
        self._store(spark, counts, "processed_data", "dim_date", dim_date_of(self._days(spark, staging), "day"))

        placed = facts.placed_orders(staging.orders, dimensions.current(buyers), tax=staging.order_tax)
        if self.previous is not None:
            placed = self._unseen(spark, staging, placed, earlier)
        batch = facts.priced_lines(staging.order_items, dimensions.current(goods)).join(placed, "order_id")
        batch = facts.fact_of(batch).withColumn("order_month", partials.month_of("order_day"))
        new = self._store(spark, counts, "processed_data", "fact_sales", batch, ["order_month"])

        lines = facts.with_cents(new)
        month = partials.month_of("order_day")
        own = partials.CUSTOMER_DAYS.merged(partials.customer_days(lines), part=month)
        self.layout.write(own, "processed_data", "load_customer_days", self.load_id)  # days and customers are summed from it
        own = self.layout.read(spark, "processed_data", "load_customer_days", self.load_id)
        days = self._add(spark, counts, "customer_days", partials.CUSTOMER_DAYS, own, own, month)
        fresh = summaries.daily_of_customer_days(days).withColumn("order_month", partials.month_of("date"))
        self._merge(spark, counts, "analytics", "daily_sales_summary", fresh, "order_month", ["date"], DAILY_FIGURES)

        bucket = partials.bucket_of("product_id", self.buckets)
        sold = self._add(spark, counts, "product_totals", partials.PRODUCTS, lines, products.product_sums(lines), bucket)
        fresh = products.product_performance_of(sold, dimensions.current(goods)).withColumn("bucket", bucket)
        self._merge(
            spark, counts, "analytics", "product_performance", fresh, "bucket", ["product_id"], PERFORMANCE_FIGURES
        )
        fresh = features.product_features_of(sold).withColumn("bucket", bucket)
        self._merge(spark, counts, "ml_features", "product_features", fresh, "bucket", ["product_id", *FEATURE], VALUE)

        bucket = partials.bucket_of("customer_id", self.buckets)
        bought = self._add(spark, counts, "customer_totals", partials.CUSTOMERS, own, partials.customers(own), bucket)
        fresh = features.customer_features_of(bought).withColumn("bucket", bucket)
        self._merge(spark, counts, "ml_features", "customer_features", fresh, "bucket", ["customer_id", *FEATURE], VALUE)
        stages = spark.createDataFrame(
            [(self.load_id, stage, "written", n) for stage, n in counts],
            "load_id string, pipeline_stage string, status string, records long",
        )
        return stages.withColumn("ts", F.current_timestamp())

    def fact(self, spark: SparkSession) -> DataFrame:
        """Every line of this load and those before."""
        return self._lines(spark, [*self._earlier(spark), self.load_id])

    def _earlier(self, spark: SparkSession) -> list[str]:
        """The loads before this one, oldest first, as the previous load wrote them down (one row per load)."""
        if self.previous is None:
            return []
        path = self.layout.path("processed_data", "load_chain", self.previous)
        chain = [r.load_id for r in spark.read.schema(CHAIN).parquet(path).orderBy("position").collect()]
        if self.load_id in chain:
            raise ValueError(f"load {self.load_id} already lies before {self.previous}")
        return chain

    def _lines(self, spark: SparkSession, loads: Sequence[str]) -> DataFrame:
        """Fact lines of the named loads: their folders by path, with ids declared as text and never compared."""
        paths = [self.layout.path("processed_data", "fact_sales", i) for i in loads]
        fields = self.layout.schema(spark, "processed_data", "fact_sales", loads[-1]).add("load_id", "string")
        return spark.read.schema(fields).option("basePath", paths[0].rpartition("/")[0]).parquet(*paths)

    def _days(self, spark: SparkSession, staging: Staging) -> DataFrame:
        """Days of this load's orders and of the calendar so far."""
        days = staging.orders.select(F.to_date("order_date").alias("day"))
        if self.previous is None:
            return days
        known = self.layout.read(spark, "processed_data", "dim_date", self.previous)
        return days.unionAll(known.select("full_date"))

    def _customers(self, spark: SparkSession, staging: Staging) -> DataFrame:
        if self.previous is None:
            return dimensions.dim_customers(staging.customers)
        known = self.layout.read(spark, "processed_data", "dim_customers", self.previous)
        rows = dimensions.customer_rows(staging.customers)
        return dimensions.extend_dimension(known, rows, "customer_id", "customer_key", ["registration_date", "name"])

    def _products(self, spark: SparkSession, staging: Staging) -> DataFrame:
        if self.previous is None:
            return dimensions.dim_products(staging.products, self.load_date)
        known = self.layout.read(spark, "processed_data", "dim_products", self.previous)
        rows = dimensions.product_rows(staging.products, self.load_date)
        return dimensions.extend_dimension(known, rows, "product_id", "product_key", ["effective_date", "product_name"])

    def _unseen(self, spark: SparkSession, staging: Staging, placed: DataFrame, earlier: Sequence[str]) -> DataFrame:
        """Orders that no earlier load holds; only the months of the feed's orders are read back."""
        held = self.earlier_orders(spark, staging, earlier)
        return placed.join(held, "order_id", "left_anti")

    def earlier_orders(self, spark: SparkSession, staging: Staging, earlier: Sequence[str]) -> DataFrame:
        """Ids of stored orders, of the feed's months."""
        dated = staging.orders.select(F.to_date("order_date").alias("day")).where("day IS NOT NULL")
        months = partials.parts_of(dated.select(partials.month_of("day").alias("month")), "month")
        return self._lines(spark, earlier).where(F.col("order_month").isin(months)).select("order_id").distinct()

    def _store(
        self,
        spark: SparkSession,
        counts: list[tuple[str, int]],
        layer: str,
        table: str,
        df: DataFrame,
        partition_by: Sequence[str] = (),
    ) -> DataFrame:
        seen = Observation(table)
        counted = df.observe(seen, F.count(F.lit(1)).alias("records"))
        self.layout.write(counted, layer, table, self.load_id, partition_by)
        counts.append((table, _records(seen)))
        return self.layout.read(spark, layer, table, self.load_id)

    def _keep(
        self, spark: SparkSession, counts: list[tuple[str, int]], layer: str, table: str, df: DataFrame, part: str
    ) -> None:
        seen = Observation(table)
        counted = df.observe(seen, F.count(F.lit(1)).alias("records"))
        self.layout.write_parts(counted, layer, table, self.load_id, part, self.previous)
        counts.append((table, _records(seen)))

    def _add(
        self,
        spark: SparkSession,
        counts: list[tuple[str, int]],
        table: str,
        state: State,
        keyed: DataFrame,
        delta: DataFrame,
        part: Column,
    ) -> DataFrame:
        """Adds this load's rows of state to the stored ones; gives back the touched parts, whole.

        Which parts those are is read off the keys that ``keyed`` has, so that ``delta`` is summed once.
        """
        states, touched = [delta], None
        if self.previous is not None:
            touched = partials.parts_of(keyed.select(part.alias(state.part)), state.part)
            states.append(self.layout.read_parts(spark, "processed_data", table, self.previous, touched))
        self._keep(spark, counts, "processed_data", table, state.merged(*states, part=part), state.part)
        return self.layout.read_parts(spark, "processed_data", table, self.load_id, touched)

    def _merge(
        self,
        spark: SparkSession,
        counts: list[tuple[str, int]],
        layer: str,
        table: str,
        fresh: DataFrame,
        part: str,
        keys: Sequence[str],
        update_cols: Sequence[str],
    ) -> None:
        """Upserts whole touched parts. ``fresh`` has a row for each stored one, and replaces what has no other columns."""
        if self.previous is not None and {*fresh.columns} - {*keys, part, *update_cols}:
            before = self.layout.read_parts(spark, layer, table, self.previous, partials.parts_of(fresh, part))
            fresh = upsert(before, fresh, [*keys, part], update_cols)
        self._keep(spark, counts, layer, table, fresh, part)
