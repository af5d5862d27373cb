"""Declared schemas: files are never inferred, and each load casts to one of these."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
TOTAL = T.DecimalType(20, 2)
PERCENT = T.DecimalType(9, 2)
FEATURE = T.DecimalType(18, 6)
PRICE = T.DecimalType(10, 2)
INT, BIGINT, DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
TEXT, BOOL, DATE = T.StringType(), T.BooleanType(), T.DateType()
TIME, TIME_NTZ = T.TimestampType(), T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Files as they lie on disk.
FILES = {
    "region": _struct(r_regionkey=INT, r_name=TEXT),
    "nation": _struct(n_nationkey=INT, n_name=TEXT, n_regionkey=INT),
    "customer": _struct(c_custkey=BIGINT, c_name=TEXT, c_nationkey=INT, c_acctbal=DOUBLE, c_mktsegment=TEXT),
    "part": _struct(p_partkey=BIGINT, p_name=TEXT, p_brand=TEXT, p_type=TEXT, p_size=INT, p_retailprice=DOUBLE),
    "orders": _struct(
        o_orderkey=BIGINT, o_custkey=BIGINT, o_orderstatus=TEXT, o_totalprice=DOUBLE,
        o_orderdate=TIME_NTZ, o_orderpriority=TEXT,
    ),
    "lineitem": _struct(
        l_orderkey=BIGINT, l_partkey=BIGINT, l_suppkey=BIGINT, l_linenumber=INT, l_quantity=DOUBLE,
        l_extendedprice=DOUBLE, l_discount=DOUBLE, l_tax=DOUBLE, l_returnflag=TEXT, l_linestatus=TEXT,
        l_shipdate=TIME_NTZ,
    ),
    "events": _struct(event_id=BIGINT, ts=TIME_NTZ, user_id=BIGINT, event_type=TEXT, value=DOUBLE, props=TEXT),
}

# Staging tables.
CUSTOMERS = _struct(
    customer_id=BIGINT, name=TEXT, state=TEXT, country=TEXT, customer_segment=TEXT,
    registration_date=DATE,
)
PRODUCTS = _struct(
    product_id=BIGINT, product_name=TEXT, category=TEXT, brand=TEXT, price=PRICE, cost=PRICE,
    is_active=BOOL, created_at=TIME_NTZ,
)
ORDERS = _struct(
    order_id=BIGINT, customer_id=BIGINT, order_date=TIME_NTZ, order_status=TEXT,
    payment_method=TEXT, total_amount=MONEY, tax_amount=MONEY, shipping_cost=PRICE, currency=TEXT,
)
ORDER_ITEMS = _struct(
    order_id=BIGINT, product_id=BIGINT, quantity=INT, unit_price=MONEY, total_price=MONEY,
    discount_percentage=PERCENT, ship_date=TIME_NTZ,
)
REVIEWS = _struct(
    review_id=BIGINT, product_id=BIGINT, customer_id=BIGINT, rating=INT, review_text=TEXT,
    review_date=TIME_NTZ, is_verified=BOOL, helpful_votes=INT,
)
EVENTS = _struct(event_id=BIGINT, ts=TIME, user_id=BIGINT, event_type=TEXT, value=MONEY, source=TEXT)

# Defaults that staging columns take when a feed leaves them out.
DEFAULTS = {
    "currency": "USD",
    "is_active": True,
    "is_verified": False,
    "helpful_votes": 0,
}
