"""Customer and product dimensions, and versioned history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.money import margin_percentage
from salesloom.operators.load import first_per_key, new_rows
from salesloom.operators.ordering import assign_keys


def customer_rows(customers: DataFrame) -> DataFrame:
    """Dimension rows before keys."""
    registered = F.to_date("registration_date")
    return customers.select(
        "customer_id",
        "name",
        "state",
        "country",
        "customer_segment",
        registered.alias("registration_date"),
        F.lit(True).alias("is_active"),
        registered.alias("effective_date"),
        F.lit(None).cast("date").alias("expiry_date"),
        F.lit(True).alias("current_flag"),
    )


def product_rows(products: DataFrame, load_date: dt.date) -> DataFrame:
    """Dimension rows before keys; products without a creation time take effect on the load date."""
    return products.select(
        "product_id",
        "product_name",
        "category",
        "brand",
        "price",
        "cost",
        margin_percentage("price", "cost").alias("margin_percentage"),
        "is_active",
        F.coalesce(F.to_date("created_at"), F.lit(load_date)).alias("effective_date"),
        F.lit(None).cast("date").alias("expiry_date"),
        F.lit(True).alias("current_flag"),
    )


def dim_customers(customers: DataFrame) -> DataFrame:
    rows = first_per_key(customer_rows(customers), ["customer_id"], ["registration_date", "name"])
    return assign_keys(rows, ["customer_id"], "customer_key")


def dim_products(products: DataFrame, load_date: dt.date) -> DataFrame:
    rows = first_per_key(product_rows(products, load_date), ["product_id"], ["effective_date", "product_name"])
    return assign_keys(rows, ["product_id"], "product_key")


def current(dim: DataFrame) -> DataFrame:
    return dim.filter(F.col("current_flag"))


def extend_dimension(
    dim: DataFrame, rows: DataFrame, business_id: str, key: str, order: Sequence[Column | str]
) -> DataFrame:
    """Insert if absent: known rows keep their key, new ones continue after the highest."""
    fresh = first_per_key(new_rows(current(dim), rows, [business_id]), [business_id], order)
    top = dim.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return dim.unionByName(assign_keys(fresh, [business_id], key, int(top) + 1))


def scd2(
    snapshots: DataFrame, business_id: str, as_of: str, attributes: Sequence[str]
) -> DataFrame:
    """Validity intervals from dated snapshots: a version starts only where an attribute changes."""
    by_id = Window.partitionBy(business_id).orderBy(as_of)
    state = F.struct(*attributes)
    changed = snapshots.withColumn("_same", state.eqNullSafe(F.lag(state).over(by_id)))
    versions = changed.filter(~F.col("_same")).select(
        business_id, *attributes, F.col(as_of).alias("effective_date")
    )
    until = F.lead("effective_date").over(Window.partitionBy(business_id).orderBy("effective_date"))
    return versions.withColumn("expiry_date", until).withColumn(
        "current_flag", F.col("expiry_date").isNull()
    )
