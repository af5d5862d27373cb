"""Data-quality checks. Every check is an aggregate: rows ``rule, checked, failed`` or figures per table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.money import hundredths, ratio
from salesloom.session import cut_lineage
from salesloom.sources.staging import Staging


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """Counted after DISTINCT, so no task holds the whole set."""
    seen = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return seen.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")


def overview(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Order records and the distinct customers, products and orders; products come from the lines."""
    figures = _stack(
        [
            orders.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total_records").alias("what"), "n"),
            _distinct_count(orders, "customer_id", "unique_customers"),
            _distinct_count(items, "product_id", "unique_products"),
            _distinct_count(orders, "order_id", "unique_orders"),
        ]
    )
    return _overview_row([figures])


def _overview_row(parts: Sequence[DataFrame]) -> DataFrame:
    figures = _stack(parts)
    names = ("total_records", "unique_customers", "unique_products", "unique_orders")
    return figures.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names]).select(
        F.lit("Data Quality Check").alias("check_type"), *names
    )


def full_report(raw: Staging, rules: DataFrame, as_of: dt.date, max_age_days: int) -> DataFrame:
    """The report over all tables from one aggregate per table and key, each taken once and read by every check.

    The lines are read three times: per order and shipping time, per product, and for their rules (``rules``, which
    has those of all tables). Every later step sees a row per key.
    """

    def keyed(df: DataFrame, key: str) -> DataFrame:
        return cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), f"dq-{key}")

    shipped = cut_lineage(shipments(raw.order_items), "dq-shipments")
    sold, orders = keyed(raw.order_items, "product_id"), keyed(raw.orders, "order_id")
    buyers, customers = keyed(raw.orders, "customer_id"), keyed(raw.customers, "customer_id")
    products, events, users = keyed(raw.products, "product_id"), keyed(raw.events, "event_id"), keyed(raw.events, "user_id")

    def many(df: DataFrame, key: str, what: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")

    figures = _overview_row(
        [
            orders.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total_records").alias("what"), "n"),
            many(buyers, "customer_id", "unique_customers"),
            many(sold, "product_id", "unique_products"),
            many(orders, "order_id", "unique_orders"),
        ]
    )
    duplicates = duplicate_keys(
        {
            "customers": (customers, "customer_id"),
            "products": (products, "product_id"),
            "orders": (orders, "order_id"),
            "events": (events, "event_id"),
        },
        "n",
    )
    missing = orphans(
        [
            Reference("orders.customer", buyers, "customer_id", customers, "customer_id", "n"),
            Reference("order_items.order", shipped, "order_id", orders, "order_id", "n"),
            Reference("order_items.product", sold, "product_id", products, "product_id", "n"),
            Reference("orders.has_items", orders, "order_id", shipped, "order_id", "n"),
            Reference("events.user", users, "user_id", customers, "customer_id", "n"),
        ]
    )
    fresh = freshness(
        {
            "orders": (raw.orders, "order_date"),
            "order_items": (shipped, "ship_date"),
            "customers": (raw.customers, "registration_date"),
        },
        as_of,
        max_age_days,
    )
    every = rules.unionByName(consistency_of(raw.orders, shipped, raw.customers))
    return report(duplicates, missing, every, fresh, figures)


def duplicate_keys(tables: Mapping[str, tuple[DataFrame, str]], weight: str | None = None) -> DataFrame:
    """Rows, NULL keys, keys held more than once, and surplus rows, per table and its key.

    With ``weight`` the tables have a row per key, and that column its rows.
    """
    parts = []
    for table, (df, key) in tables.items():
        k = F.col(key).alias("k")
        per_key = df.select(k, F.col(weight).alias("n")) if weight else df.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
        known = F.col("k").isNotNull()
        parts.append(
            per_key.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
                F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_keys"),
                F.count_if(known & (F.col("n") > 1)).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
            ).select(F.lit(table).alias("table_name"), F.lit(key).alias("key_name"), "*")
        )
    return _stack(parts)


@dataclass(frozen=True)
class Reference:
    name: str
    child: DataFrame
    child_key: str
    parent: DataFrame
    parent_key: str
    weight: str | None = None  # of a child counted beforehand: the column of its rows


def orphans(references: Sequence[Reference]) -> DataFrame:
    """Child rows without a parent; children are counted per key before they meet the parents."""
    parts = []
    for r in references:
        children = (
            r.child.filter(F.col(r.child_key).isNotNull())
            .groupBy(F.col(r.child_key).alias("k"))
            .agg((F.sum(r.weight) if r.weight else F.count(F.lit(1))).alias("n"))
        )
        parents = r.parent.select(F.col(r.parent_key).alias("k")).distinct().withColumn("_found", F.lit(True))
        parts.append(
            children.join(parents, "k", "left")
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
                F.coalesce(F.sum(F.when(F.col("_found").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
            )
            .select(F.lit(r.name).alias("relation"), "*")
        )
    return _stack(parts)


def check_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """All rules of one table in one pass. A rule is a condition that must not be false; NULL passes."""
    failed = {name: F.count_if(~condition) for name, condition in rules.items()}
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in failed.items()])
    return one.unpivot(["_rows"], [f"`{n}`" for n in rules], "rule", "failed").select(
        "rule", F.col("_rows").alias("checked"), "failed"
    )


STATUSES = ("Completed", "Pending", "Cancelled")


def order_rules() -> dict[str, Column]:
    return {
        "orders.status_known": F.col("order_status").isin(*STATUSES),
        "orders.total_not_negative": F.col("total_amount") >= 0,
        "orders.shipping_not_negative": F.col("shipping_cost") >= 0,
        "orders.currency_three_letters": F.length("currency") == 3,
    }


def item_rules() -> dict[str, Column]:
    return {
        "order_items.quantity_positive": F.col("quantity") > 0,
        "order_items.total_not_negative": F.col("total_price") >= 0,
        "order_items.discount_in_percent": F.col("discount_percentage").between(0, 100),
    }


def product_rules() -> dict[str, Column]:
    margin = F.try_divide((F.col("price") - F.col("cost")) * 100, F.col("price"))
    return {
        "products.price_positive": F.col("price") > 0,
        "products.margin_fits": F.abs(margin) < F.lit(1000),
    }


def review_rules() -> dict[str, Column]:
    return {"reviews.rating_in_range": F.col("rating").between(1, 5)}


def text_length_rules(table: str, limits: Mapping[str, int]) -> dict[str, Column]:
    return {f"{table}.{c}_fits": F.length(c) <= n for c, n in limits.items()}


def not_null_rules(table: str, df: DataFrame) -> dict[str, Column]:
    return {f"not_null.{table}.{c}": F.col(f"`{c}`").isNotNull() for c in df.columns}


def domain(tables: Sequence[tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    return _stack([check_rules(df, rules) for df, rules in tables])


def completeness(tables: Mapping[str, DataFrame]) -> DataFrame:
    """NULLs per column, one pass per table."""
    parts = []
    for table, df in tables.items():
        one = df.agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns],
        )
        parts.append(
            one.unpivot(["_rows"], list(df.columns), "column_name", "nulls").select(
                F.lit(table).alias("table_name"),
                "column_name",
                F.col("_rows").alias("checked"),
                "nulls",
                F.coalesce(ratio("nulls", "_rows"), F.lit(0.0)).alias("null_ratio"),
            )
        )
    return _stack(parts)


def consistency(orders: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """Shipping before ordering, order totals against their lines, orders before registration.

    Lines are summed per order and shipping time, meet their order once, and both line rules come from
    that one pass.
    """
    return consistency_of(orders, shipments(items), customers)


def shipments(items: DataFrame) -> DataFrame:
    """Lines and cents per order and shipping time."""
    return items.groupBy("order_id", "ship_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hundredths(items, "total_price")).alias("cents")
    )


def consistency_of(orders: DataFrame, lines: DataFrame, customers: DataFrame) -> DataFrame:
    """The same from lines that were summed before."""
    due = orders.select("order_id", "order_date", hundredths(orders, "total_amount").alias("due_cents"))
    early = F.when(F.col("ship_date") < F.col("order_date"), F.col("n")).otherwise(0)
    per_order = (
        lines.join(due, "order_id")
        .groupBy("order_id", "due_cents")
        .agg(F.sum("n").alias("n"), F.sum(early).alias("early"), F.sum("cents").alias("cents"))
    )
    one = per_order.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("_lines"),
        F.coalesce(F.sum("early"), F.lit(0)).alias("_early"),
        F.count(F.lit(1)).alias("_orders"),
        F.count_if(F.col("cents") != F.col("due_cents")).alias("_off"),
    )

    def rule(name: str, checked: str, failed: str) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.col(checked).alias("checked"), F.col(failed).alias("failed"))

    line_rules = one.select(
        F.explode(
            F.array(
                rule("order_items.shipped_after_order", "_lines", "_early"),
                rule("orders.total_is_sum_of_items", "_orders", "_off"),
            )
        ).alias("r")
    ).select("r.*")
    known = orders.join(customers.select("customer_id", "registration_date"), "customer_id")
    registered = known.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.to_date("order_date") < F.col("registration_date")).alias("failed"),
    ).select(F.lit("orders.customer_registered_before").alias("rule"), "*")
    return _stack([line_rules, registered])


def freshness(tables: Mapping[str, tuple[DataFrame, str]], as_of: dt.date, max_age_days: int) -> DataFrame:
    """Age of the newest row per table."""
    parts = []
    for table, (df, column) in tables.items():
        newest = F.to_date(F.max(column))
        parts.append(df.agg(newest.alias("newest")).select(F.lit(table).alias("table_name"), "newest"))
    age = F.date_diff(F.lit(as_of), "newest")
    return _stack(parts).select(
        "table_name", "newest", age.alias("age_days"), F.coalesce(age <= max_age_days, F.lit(False)).alias("fresh")
    )


def report(
    duplicates: DataFrame, missing: DataFrame, rules: DataFrame, fresh: DataFrame, figures: DataFrame | None = None
) -> DataFrame:
    """Every check as ``rule, checked, failed, passed``; of an overview's figures, that none is 0."""
    name = F.concat_ws
    overviews = []
    if figures is not None:
        counts = [c for c in figures.columns if c != "check_type"]
        named = figures.unpivot([], counts, "what", "checked")
        nothing = (F.col("checked") == 0).cast("bigint").alias("failed")
        overviews = [named.select(name(".", F.lit("overview"), "what").alias("rule"), "checked", nothing)]
    rows = _stack(
        [
            *overviews,
            duplicates.select(
                name(".", F.lit("unique"), "table_name", "key_name").alias("rule"),
                "checked",
                (F.col("null_keys") + F.col("surplus_rows")).alias("failed"),
            ),
            missing.select(name(".", F.lit("parent"), "relation").alias("rule"), "checked", F.col("orphans").alias("failed")),
            rules.select("rule", "checked", "failed"),
            fresh.select(
                name(".", F.lit("fresh"), "table_name").alias("rule"),
                F.lit(1).cast("bigint").alias("checked"),
                (~F.col("fresh")).cast("bigint").alias("failed"),
            ),
        ]
    )
    return rows.withColumn("passed", F.col("failed") == 0)
