"""Feature store rows: long by entity and name, wide on request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions.money import dollars, from_cents, ratio
from salesloom.operators.summaries import per_customer
from salesloom.schemas import FEATURE

CUSTOMER_FEATURES = ("total_spent", "total_orders", "avg_order_value")
PRODUCT_FEATURES = ("total_sales", "total_quantity_sold")


def to_long(wide: DataFrame, entity: str, names: Sequence[str]) -> DataFrame:
    typed = wide.select(entity, *[F.col(n).cast(FEATURE).alias(n) for n in names])
    return typed.unpivot([entity], list(names), "feature_name", "feature_value")


def to_wide(features: DataFrame, entity: str, names: Sequence[str]) -> DataFrame:
    """The name list is given, so no job runs to find it."""
    return features.groupBy(entity).pivot("feature_name", list(names)).agg(F.first("feature_value"))


def customer_features(totals: DataFrame) -> DataFrame:
    """One aggregation for all three features; the average is per line, as the feature is defined."""
    return customer_features_of(per_customer(totals))


def customer_features_of(customers: DataFrame) -> DataFrame:
    """The features from one row of sums per customer."""
    wide = customers.select(
        "customer_id",
        from_cents("revenue_cents").alias("total_spent"),
        F.col("orders").alias("total_orders"),
        ratio(dollars("revenue_cents"), "lines").alias("avg_order_value"),
    )
    return to_long(wide, "customer_id", CUSTOMER_FEATURES)


def product_features(sales: DataFrame) -> DataFrame:
    return product_features_of(
        sales.groupBy("product_id").agg(F.sum("total_cents").alias("revenue_cents"), F.sum("quantity").alias("quantity"))
    )


def product_features_of(sums: DataFrame) -> DataFrame:
    """The features from one row of sums per product."""
    wide = sums.select(
        "product_id", from_cents("revenue_cents").alias("total_sales"), F.col("quantity").alias("total_quantity_sold")
    )
    return to_long(wide, "product_id", PRODUCT_FEATURES)
