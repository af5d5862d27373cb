"""What the analytics endpoints answer, as DataFrames over the stored star.

Request parameters are arguments; ``to_json_rows`` turns a result into JSON. Nothing here serves HTTP.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from salesloom.operators import facts, metrics, models, products, segments, summaries
from salesloom.operators.dimensions import current
from salesloom.plans.daily_load import DailyLoad
from salesloom.streaming import live


@dataclass(frozen=True)
class Endpoints:
    """``sales`` is the fact with amounts in cents, ``goods`` the current product rows."""

    sales: DataFrame
    goods: DataFrame
    events: DataFrame | None = None

    @classmethod
    def of_load(cls, spark: SparkSession, load: DailyLoad, events: DataFrame | None = None) -> Endpoints:
        goods = current(load.layout.read(spark, "processed_data", "dim_products", load.load_id))
        return cls(facts.with_cents(load.fact(spark)), goods, events)

    def _between(self, start: dt.date | None, end: dt.date | None) -> DataFrame:
        return summaries.in_range(self.sales, "order_day", start, end)

    def sales_summary(
        self, start: dt.date | None = None, end: dt.date | None = None, statuses: Sequence[str] | None = None
    ) -> DataFrame:
        return summaries.sales_summary(summaries.order_totals(self._between(start, end)), statuses=statuses)

    def sales_trends(
        self, granularity: str = "daily", start: dt.date | None = None, end: dt.date | None = None
    ) -> DataFrame:
        return summaries.sales_trend(summaries.order_totals(self._between(start, end)), granularity)

    def top_products(
        self, metric: str = "revenue", limit: int = 10, start: dt.date | None = None, end: dt.date | None = None
    ) -> DataFrame:
        return products.top_products(self._between(start, end), self.goods, metric, limit)

    def customer_segments(self, as_of: dt.date) -> DataFrame:
        table = segments.customer_segments(summaries.order_totals(self.sales), as_of)
        return segments.customer_segment_summary(table)

    def realtime_metrics(self) -> DataFrame:
        return live.realtime_metrics(self._events())

    def recent_events(self, limit: int = 100) -> DataFrame:
        return metrics.recent_events(self._events(), limit)

    def predict(self, rows: DataFrame, root: str, model_name: str) -> DataFrame:
        return models.predict(rows, root, model_name)

    def model_status(self, scored: DataFrame, model_name: str) -> DataFrame:
        return models.evaluate(scored, model_name)

    def _events(self) -> DataFrame:
        if self.events is None:
            raise ValueError("no event table given")
        return self.events
