"""Product performance, rankings and category figures.

Lines are summed per product before product attributes are joined, so the wide join sees one row per
sold product and a hot product is already one partial sum per task when it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.money import dollars, from_cents, grand, ratio
from salesloom.operators.ordering import with_running_sum

METRICS = ("revenue", "quantity", "orders", "profit")


def product_sums(sales: DataFrame) -> DataFrame:
    """What per-product figures are made of; sums of two sets of whole orders add up to those of both.

    An order's first line of a product stands for it in the count of orders. Counting distinct ids instead holds a row
    per product and order in three hash tables of a task.
    """
    nth = F.row_number().over(Window.partitionBy("order_id", "product_id").orderBy("order_id"))
    first = sales.withColumn("_first", (nth == 1) & F.col("order_id").isNotNull())
    return first.groupBy("product_id").agg(
        F.sum("total_cents").alias("revenue_cents"),
        F.sum("profit_cents").alias("profit_cents"),
        F.sum("quantity").alias("quantity"),
        F.count_if("_first").alias("orders"),
        F.sum("margin_points").alias("margin_points"),
        F.count("margin_points").alias("margin_lines"),
        F.max("order_day").alias("last_sale_date"),
    )


def per_product(sales: DataFrame) -> DataFrame:
    return per_product_of(product_sums(sales))


def per_product_of(sums: DataFrame) -> DataFrame:
    return sums.select(
        "product_id",
        "revenue_cents",
        from_cents("revenue_cents").alias("revenue"),
        from_cents("profit_cents").alias("profit"),
        "quantity",
        "orders",
        ratio(dollars("margin_points"), "margin_lines").alias("avg_margin"),
        "last_sale_date",
    )


def review_stats(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_id").agg(
        F.round(F.avg(F.col("rating").cast("decimal(3,0)")), 2).cast("decimal(3,2)").alias("avg_rating"),
        F.count("rating").alias("total_reviews"),
    )


def product_performance(
    sales: DataFrame, products: DataFrame, reviews: DataFrame | None = None
) -> DataFrame:
    out = product_performance_of(product_sums(sales), products)
    if reviews is None:
        return out
    rated = out.join(review_stats(reviews), "product_id", "left")
    return rated.withColumn("total_reviews", F.coalesce("total_reviews", F.lit(0)))


def product_performance_of(sums: DataFrame, products: DataFrame) -> DataFrame:
    """The performance table from one row of sums per product."""
    out = per_product_of(sums).join(products.select("product_id", "product_name", "category"), "product_id")
    return out.select(
        "product_id",
        "product_name",
        "category",
        F.col("revenue").alias("total_sales"),
        F.col("quantity").alias("total_quantity"),
        F.col("orders").alias("total_orders"),
        F.col("avg_margin").alias("profit_margin"),
        "last_sale_date",
    )


def product_sales(sales: DataFrame, products: DataFrame) -> DataFrame:
    """The view over sold products, unordered; consumers sort."""
    return (
        per_product(sales)
        .join(products.select("product_id", "product_name", "category", "brand"), "product_id")
        .select(
            "product_id",
            "product_name",
            "category",
            "brand",
            F.col("revenue").alias("total_revenue"),
            F.col("quantity").alias("total_quantity"),
            F.col("orders").alias("total_orders"),
            "avg_margin",
        )
    )


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")


def _best_first(metric: str) -> list[Column]:
    return [F.col(metric).desc(), F.col("product_id").asc()]


def top_products(sales: DataFrame, products: DataFrame, metric: str = "revenue", limit: int = 10) -> DataFrame:
    """The leading products; ties go to the lower id. Attributes are looked up for those only."""
    _check_metric(metric)
    best = per_product(sales).orderBy(*_best_first(metric)).limit(limit)
    return best.join(products.select("product_id", "product_name", "category", "brand"), "product_id").select(
        "product_id", "product_name", "category", "brand", "revenue", "quantity", "orders", "profit"
    )


def top_products_per_category(
    sales: DataFrame, products: DataFrame, metric: str = "revenue", limit: int = 3
) -> DataFrame:
    """Rank within category; the bound on the rank lets each task keep only its own leaders."""
    _check_metric(metric)
    ranked = per_product(sales).join(products.select("product_id", "product_name", "category"), "product_id")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(*_best_first(metric)))
    return (
        ranked.withColumn("rank", rank)
        .filter(F.col("rank") <= limit)
        .select("category", "rank", "product_id", "product_name", F.col(metric).alias("metric_value"))
    )


def slow_movers(sales: DataFrame, products: DataFrame, limit: int = 20) -> DataFrame:
    """Least revenue first, products without a sale included."""
    sold = sales.groupBy("product_id").agg(
        F.sum("total_cents").alias("_cents"), F.sum("quantity").alias("quantity")
    )
    return (
        products.select("product_id", "product_name", "category")
        .join(sold, "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "category",
            from_cents(F.coalesce("_cents", F.lit(0))).alias("revenue"),
            F.coalesce("quantity", F.lit(0)).alias("quantity"),
        )
        .orderBy("revenue", "product_id")
        .limit(limit)
    )


def revenue_by_category(
    sales: DataFrame,
    products: DataFrame,
    categories: Sequence[str] | None = None,
    top_n: int | None = None,
) -> DataFrame:
    """Revenue and share per category over all products, or over the ``top_n`` best sellers."""
    sold = sales.groupBy("product_id").agg(F.sum("total_cents").alias("cents"))
    if top_n is not None:
        sold = sold.orderBy(F.col("cents").desc(), "product_id").limit(top_n)
    kinds = products.select("product_id", "category")
    if categories is not None:
        kinds = kinds.filter(F.col("category").isin(list(categories)))
    out = sold.join(kinds, "product_id").groupBy("category").agg(grand("cents").alias("_cents"))
    every = F.sum("_cents").over(Window.partitionBy())  # one row per category reaches this window
    return out.select(
        "category", from_cents("_cents").alias("revenue"), ratio(dollars("_cents"), dollars(every)).alias("share")
    )


def abc_products(
    sales: DataFrame, products: DataFrame, a_percent: int = 80, b_percent: int = 95
) -> DataFrame:
    """Class by cumulative revenue share, largest product first."""
    sold = sales.groupBy("product_id").agg(F.sum("total_cents").cast("decimal(20,0)").alias("cents"))
    run = with_running_sum(sold, [F.col("cents").desc(), F.col("product_id")], "cents", "_cum", "_all")
    reached = F.col("_cum") * 100
    grade = (
        F.when(reached <= F.col("_all") * a_percent, "A")
        .when(reached <= F.col("_all") * b_percent, "B")
        .otherwise("C")
    )
    graded = run.select(
        "product_id",
        from_cents("cents").alias("revenue"),
        ratio(dollars("_cum"), dollars("_all")).alias("cumulative_share"),
        grade.alias("abc_class"),
    )
    return graded.join(products.select("product_id", "category"), "product_id")
