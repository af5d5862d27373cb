"""Products bought together, for every product: frequent itemsets by FP-growth, and rules over its pairs.

The bound is the least support, not a choice of anchors: FP-trees hold what is frequent, dealt by groups of items, and
no pair is formed that no branch of a tree has.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions.money import dbl
from salesloom.session import cut_lineage


def transactions(lines: DataFrame, item: str = "product_id") -> DataFrame:
    """One row per order with its distinct items; an order's items are the one array that the trees need."""
    return lines.groupBy("order_id").agg(F.collect_set(item).alias("items"))


def frequent_itemsets(lines: DataFrame, min_support: float, item: str = "product_id") -> tuple[DataFrame, int]:
    """(items, orders) for every set of items in at least ``min_support`` of the orders, and the number of orders."""
    if not 0 < min_support <= 1:
        raise ValueError("min_support is a share of the orders")
    baskets = cut_lineage(transactions(lines, item), "baskets")
    orders = baskets.count()
    if not orders:
        kind = lines.schema[item].dataType.simpleString()
        return lines.sparkSession.createDataFrame([], f"items array<{kind}>, orders long"), 0
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(baskets)
    found = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("orders"))
    return cut_lineage(found, "itemsets"), orders


def frequent_pairs(itemsets: DataFrame) -> DataFrame:
    """The sets of two, the smaller id first."""
    items = F.col("items")
    return itemsets.where(F.size(items) == 2).select(
        items[0].alias("product_id"), items[1].alias("other_id"), "orders"
    )


def association_rules(itemsets: DataFrame, orders: int, min_confidence: float = 0.0) -> DataFrame:
    """Both directions of every frequent pair with support, confidence and lift.

    Members of a frequent pair are frequent themselves, so the single sets hold all counts that a rule needs.
    """
    single = itemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("id"), F.col("orders").alias("n"))
    pairs = frequent_pairs(itemsets)
    both = pairs.union(pairs.select("other_id", "product_id", "orders")).toDF("antecedent", "consequent", "together")
    total = F.lit(float(orders))
    rules = (
        both.join(single.withColumnsRenamed({"id": "antecedent", "n": "_if"}), "antecedent")
        .join(single.withColumnsRenamed({"id": "consequent", "n": "_then"}), "consequent")
        .withColumn("confidence", dbl("together") / dbl("_if"))
    )
    return rules.where(F.col("confidence") >= min_confidence).select(
        "antecedent",
        "consequent",
        F.col("together").alias("orders"),
        (dbl("together") / total).alias("support"),
        "confidence",
        (F.col("confidence") / (dbl("_then") / total)).alias("lift"),
    )
