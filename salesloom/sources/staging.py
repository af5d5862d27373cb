"""Staging relations over the Parquet files: scan, cast, rename."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom import schemas
from salesloom.functions.money import divide_half_up_sql, from_cents, hundredths_sql, money

# Order status codes of the files.
STATUS_NAMES = {"F": "Completed", "O": "Pending", "P": "Cancelled"}


@dataclass(frozen=True)
class Staging:
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame
    events: DataFrame
    order_tax: DataFrame | None = None


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(schemas.FILES[table]).parquet(f"{folder.rstrip('/')}/{table}.parquet")


def buyers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without their address, for what needs no place."""
    registered = F.date_add(F.lit("1994-07-01").cast("date"), ((F.col("c_custkey") * 37) % 1500).cast("int"))
    return scan(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation_id"),
        F.col("c_mktsegment").alias("customer_segment"),
        registered.alias("registration_date"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    nation = scan(spark, folder, "nation")
    region = scan(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    return (
        buyers(spark, folder)
        .join(places, F.col("nation_id") == F.col("n_nationkey"), "left")
        .select(
            "customer_id",
            "name",
            F.col("n_name").alias("state"),
            F.col("r_name").alias("country"),
            "customer_segment",
            "registration_date",
        )
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(10,2)")
    cost = price * (F.lit(40) + F.col("p_size")).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")
    return scan(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        price.alias("price"),
        cost.cast("decimal(10,2)").alias("cost"),
        (F.col("p_partkey") % 10 != 0).alias("is_active"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as the files hold them, totals still DOUBLE; the unit price follows from total and quantity."""
    unit = F.expr(divide_half_up_sql(hundredths_sql("l_extendedprice", schemas.DOUBLE), "CAST(l_quantity AS BIGINT)"))
    return scan(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        from_cents(unit, schemas.MONEY).alias("unit_price"),
        F.col("l_extendedprice").alias("total_price"),
        (F.col("l_discount") * 100).alias("discount_percentage"),
        F.col("l_shipdate").alias("ship_date"),
    )


def order_tax(spark: SparkSession, folder: str) -> DataFrame:
    """Order-level tax: the files carry a rate per line."""
    paid = hundredths_sql("l_extendedprice", schemas.DOUBLE)
    rate = hundredths_sql("l_tax", schemas.DOUBLE)
    sums = scan(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"))
    return sums.agg(F.sum(F.expr(f"{paid} * {rate}")).alias("_tax")).select(
        "order_id", from_cents(F.expr(divide_half_up_sql("_tax", "100")), schemas.MONEY).alias("tax_amount")
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without their tax, which ``order_tax`` sums from the lines."""
    status = F.col("o_orderstatus")
    for code, name in STATUS_NAMES.items():
        status = F.when(F.col("o_orderstatus") == code, F.lit(name)).otherwise(status)
    return scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        status.alias("order_status"),
        F.col("o_orderpriority").alias("payment_method"),
        money("o_totalprice").alias("total_amount"),
        F.lit(None).cast(schemas.MONEY).alias("tax_amount"),
        (F.lit(5) + F.col("o_orderkey") % 20).cast("decimal(10,2)").alias("shipping_cost"),
        F.lit("USD").alias("currency"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return parse_events(scan(spark, folder, "events"))


def parse_events(raw: DataFrame) -> DataFrame:
    """Event rows, batch or stream: event time as TIMESTAMP, exact value, source from the properties."""
    source = F.concat(F.lit("src"), (F.get_json_object("props", "$.k").cast("int") % 4).cast("string"))
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        money("value").alias("value"),
        source.alias("source"),
    )


def load_raw(spark: SparkSession, folder: str) -> Staging:
    return Staging(
        customers=customers(spark, folder),
        products=products(spark, folder),
        orders=orders(spark, folder),
        order_items=order_items(spark, folder),
        events=events(spark, folder),
        order_tax=order_tax(spark, folder),
    )
