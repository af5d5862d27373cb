"""The sales fact."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.dates import date_key
from salesloom.functions.money import dbl, from_cents, hundredths, scaled
from salesloom.schemas import MONEY, PERCENT

# Columns of the fact that consumers see; the stored fact also keeps business ids, so that summaries
# need no key lookup.
FACT_COLUMNS = (
    "order_id",
    "customer_key",
    "product_key",
    "date_key",
    "quantity",
    "unit_price",
    "total_amount",
    "cost_amount",
    "profit_amount",
    "margin_percentage",
    "discount_amount",
    "tax_amount",
    "shipping_cost",
    "order_date",
)


def _present(df: DataFrame, *columns: str) -> list[str]:
    return [c for c in columns if c in df.columns]


# Amounts of a line in cents, and the contract column and type each becomes.
AMOUNTS = {
    "unit_cents": ("unit_price", MONEY),
    "total_cents": ("total_amount", MONEY),
    "cost_cents": ("cost_amount", MONEY),
    "profit_cents": ("profit_amount", MONEY),
    "margin_points": ("margin_percentage", PERCENT),
    "discount_cents": ("discount_amount", MONEY),
}


def priced_lines(items: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines of known products, each amount rounded to the cent.

    The list cost ratio is applied to the paid total; the discount is informational, revenue includes it.
    """
    goods = products.select(
        "product_id",
        hundredths(products, "price").alias("_price"),
        hundredths(products, "cost").alias("_cost"),
        *_present(products, "product_key"),
    )
    lines = items.withColumns(
        {
            "unit_cents": hundredths(items, "unit_price"),
            "total_cents": hundredths(items, "total_price"),
            "_discount": hundredths(items, "discount_percentage"),
        }
    )
    goods = goods.withColumn("margin_points", scaled("_price - _cost", "10000", "_price"))
    return lines.join(goods, "product_id").select(
        "order_id",
        "product_id",
        *_present(products, "product_key"),
        "quantity",
        "unit_cents",
        "total_cents",
        scaled("total_cents", "_cost", "_price").alias("cost_cents"),
        scaled("total_cents", "_price - _cost", "_price").alias("profit_cents"),
        "margin_points",
        scaled("total_cents", "_discount", "10000").alias("discount_cents"),
    )


def with_amounts(lines: DataFrame) -> DataFrame:
    """Cents to the DECIMAL columns of the fact."""
    return lines.withColumns({name: from_cents(c, kind) for c, (name, kind) in AMOUNTS.items()}).drop(*AMOUNTS)


def with_cents(fact: DataFrame) -> DataFrame:
    """The fact's DECIMAL columns back to cents, for summing.

    Through doubles, which allocate less than decimal products: of 12 digits they miss a whole cent by far less than half.
    """
    cents = {c: F.rint(dbl(name) * 100).cast("long") for c, (name, _) in AMOUNTS.items()}
    return fact.withColumns(cents).drop(*[name for name, _ in AMOUNTS.values()])


def dated_orders(orders: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Orders within the calendar. It has no gaps, so joining to it is a range, which reaches the scan."""
    out = orders.withColumn("order_day", F.to_date("order_date")).filter(F.col("order_day").isNotNull())
    if start is not None:
        out = out.filter(F.col("order_day") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("order_day") <= F.lit(end))
    return out


def buyers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id",
        F.to_date("registration_date").alias("registration_date"),
        *_present(customers, "customer_key"),
    )


def sales_lines(
    items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    tax: DataFrame | None = None,
) -> DataFrame:
    """One row per order line that has an order, a customer and a product.

    ``customers`` and ``products`` are staging tables, or current dimension rows, whose keys then come
    along. ``tax`` holds order-level tax where the orders lack it; it joins on the key the lines join on
    next, so it costs no shuffle of the orders. Lines meet their order last.
    """
    return priced_lines(items, products).join(placed_orders(orders, customers, start, end, tax), "order_id")


def placed_orders(
    orders: DataFrame,
    customers: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    tax: DataFrame | None = None,
) -> DataFrame:
    """One row per order within the calendar that has a customer."""
    placed = dated_orders(orders, start, end).join(buyers(customers), "customer_id")
    if tax is not None:
        placed = placed.drop("tax_amount").join(tax, "order_id", "left")
    return placed.select(
        "order_id",
        "customer_id",
        *_present(customers, "customer_key"),
        "order_day",
        "order_date",
        "order_status",
        "registration_date",
        "tax_amount",
        "shipping_cost",
    )


def fact_sales(
    items: DataFrame,
    orders: DataFrame,
    dim_customers: DataFrame,
    dim_products: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    tax: DataFrame | None = None,
) -> DataFrame:
    """The fact with surrogate keys of the current dimension rows, the date key, and the business ids."""
    lines = sales_lines(
        items, orders, dim_customers.filter("current_flag"), dim_products.filter("current_flag"), start, end, tax
    )
    return fact_of(lines)


def fact_of(lines: DataFrame) -> DataFrame:
    """The fact from lines that have met their orders."""
    return with_amounts(lines).withColumn("date_key", date_key("order_day"))


def append_facts(fact: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds the lines of orders the fact does not hold yet, so a rerun of a batch adds nothing."""
    return fact.unionByName(batch.join(fact.select("order_id").distinct(), "order_id", "left_anti"))


def point_in_time(sales: DataFrame, versions: DataFrame, business_id: str) -> DataFrame:
    """Each line with the version that was valid on its order day."""
    v = versions.withColumnRenamed(business_id, "_id")
    valid = (F.col("order_day") >= F.col("effective_date")) & (
        F.col("order_day") < F.coalesce("expiry_date", F.lit(dt.date(9999, 12, 31)))
    )
    return sales.join(v, (F.col(business_id) == F.col("_id")) & valid).drop("_id")


def allocate_order_cost(sales: DataFrame, amount: str, name: str) -> DataFrame:
    """Spreads an order-level amount over the lines by their share of the order's total.

    A line gets the rounded share of the lines up to it less that of the lines before, so that an order's parts add up
    to its amount. Lines stand by product and amount; those of one order lie in one task.
    """
    order = Window.partitionBy("order_id")
    along = order.orderBy("product_id", "total_cents").rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        sales.withColumn("_amount_cents", hundredths(sales, amount))
        .withColumn("_order_cents", F.sum("total_cents").over(order))
        .withColumn("_up_to", F.sum("total_cents").over(along))
    )
    joined = joined.withColumn("_shares", scaled("_amount_cents", "_up_to", "_order_cents"))
    joined = joined.withColumn("_before", scaled("_amount_cents", "_up_to - total_cents", "_order_cents"))
    part = from_cents(F.col("_shares") - F.col("_before"), MONEY)
    return joined.withColumn(name, part).drop("_order_cents", "_amount_cents", "_up_to", "_shares", "_before")

