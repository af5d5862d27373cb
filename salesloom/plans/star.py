"""The star over a folder of Parquet files, assembled lazily."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.operators import facts, summaries
from salesloom.sources import staging


def sales(spark: SparkSession, folder: str, with_tax: bool = False) -> DataFrame:
    """Sales lines with order and customer columns."""
    return facts.sales_lines(
        staging.order_items(spark, folder),
        staging.orders(spark, folder),
        staging.buyers(spark, folder),
        staging.products(spark, folder),
        tax=staging.order_tax(spark, folder) if with_tax else None,
    )


def order_totals(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order."""
    return summaries.order_totals_of(
        facts.priced_lines(staging.order_items(spark, folder), staging.products(spark, folder)),
        facts.dated_orders(staging.orders(spark, folder)),
        facts.buyers(staging.buyers(spark, folder)),
    )


def product_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly product states taken from the lines: the band of the highest unit price paid."""
    items = staging.order_items(spark, folder)
    orders = staging.orders(spark, folder).select("order_id", "order_date")
    top = (
        items.join(orders, "order_id")
        .groupBy("product_id", F.trunc("order_date", "quarter").alias("snapshot_date"))
        .agg(F.max("unit_price").alias("unit_price"))
    )
    price = F.col("unit_price")
    band = F.when(price < 5000, "low").when(price < 20000, "middle").otherwise("high")
    return top.select("product_id", "snapshot_date", band.alias("price_band"))


def registered_before(customers: DataFrame, day: dt.date) -> DataFrame:
    return customers.filter(F.col("registration_date") < F.lit(day))
