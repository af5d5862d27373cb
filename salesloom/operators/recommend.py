"""Product recommendations.

Bought-together figures are taken for a given table of anchor products, of any length. Each basket then yields one row per
(anchor in it, other product in it): linear in the lines, where all pairs would be quadratic in a basket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.functions.money import dbl
from salesloom.session import cut_lineage, find_package, shared_root


def _revenue(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id").agg(F.sum("total_cents").alias("_cents"))


def best_sellers(sales: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` products with the most revenue, as anchors."""
    best = _revenue(sales).orderBy(F.col("_cents").desc(), "product_id").limit(limit)
    return best.select(F.col("product_id").alias("anchor_id"))


def baskets(sales: DataFrame) -> DataFrame:
    return sales.select("order_id", "product_id").distinct()


def copurchases(basket: DataFrame, anchors: DataFrame) -> DataFrame:
    """Orders shared by each anchor and every product bought with it."""
    held = basket.join(anchors, F.col("product_id") == F.col("anchor_id")).select("order_id", "anchor_id")
    return (
        basket.join(held, "order_id")
        .filter(F.col("product_id") != F.col("anchor_id"))
        .groupBy("anchor_id", "product_id")
        .agg(F.count(F.lit(1)).alias("orders_together"))
    )


def recommend_copurchase(basket: DataFrame, anchors: DataFrame, limit: int = 5) -> DataFrame:
    """Best companions per anchor with support, confidence and lift."""
    total = basket.agg(F.count_distinct("order_id")).scalar()
    single = basket.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    by_count = Window.partitionBy("anchor_id").orderBy(F.col("orders_together").desc(), F.col("product_id"))
    best = (
        copurchases(basket, anchors)
        .withColumn("rank", F.row_number().over(by_count))
        .filter(F.col("rank") <= limit)
    )
    anchor_n = single.select(F.col("product_id").alias("anchor_id"), F.col("n").alias("_anchor_n"))
    product_n = single.select("product_id", F.col("n").alias("_product_n"))
    together, anchor, product = dbl("orders_together"), dbl("_anchor_n"), dbl("_product_n")
    return (
        best.join(anchor_n, "anchor_id")
        .join(product_n, "product_id")
        .withColumn("_total", total)
        .select(
            "anchor_id",
            "rank",
            "product_id",
            "orders_together",
            (together / dbl("_total")).alias("support"),
            (together / anchor).alias("confidence"),
            (together * dbl("_total") / (anchor * product)).alias("lift"),
        )
    )


def purchase_counts(sales: DataFrame) -> DataFrame:
    """Implicit ratings: lines per customer and product. ALS wants INT ids; larger ones raise."""
    return sales.groupBy(
        F.col("customer_id").cast("int").alias("customer_id"), F.col("product_id").cast("int").alias("product_id")
    ).agg(F.count(F.lit(1)).cast("float").alias("rating"))


def score_pairs(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """The model's score of each given (customer, product) pair, whatever table the caller has."""
    return model.transform(pairs.select("customer_id", "product_id")).select(
        "customer_id", "product_id", F.col("prediction").cast("double").alias("score")
    )


#: Ratings that a block of the factor model holds about. A task holds a whole block several times over and can't spill it;
#: each side has ten blocks at least.
BLOCK_RATINGS = 12_000_000


def fit_als(ratings: DataFrame, seed: int = 42, block_ratings: int = BLOCK_RATINGS) -> ALSModel:
    """``ratings`` is read several times.

    With the ratings blocks grow in number, not in size; beyond ten the number has no small divisor, as rows go to blocks
    by the remainders of their ids. More blocks send more factors to each other, so what an iteration
    shuffled goes once its item factors are written to the checkpoint folder, and blocks lie on disk, not in the heap.
    """
    shared_root(ratings.sparkSession)
    blocks = max(10, -(-ratings.count() // block_ratings))
    while blocks > 10 and math.gcd(blocks, 30) > 1:
        blocks += 1
    return ALS(
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=1,
        intermediateStorageLevel="DISK_ONLY",
        userCol="customer_id",
        itemCol="product_id",
        ratingCol="rating",
        implicitPrefs=True,
        rank=8,
        maxIter=5,
        seed=seed,
        coldStartStrategy="drop",
    ).fit(ratings)


def recommend_als(sales: DataFrame, limit: int = 5, seed: int = 42) -> DataFrame:
    """Factor model on purchase counts; every pair that was bought is scored, each customer's best products are ranked."""
    ratings = cut_lineage(purchase_counts(sales))
    order = Window.partitionBy("customer_id").orderBy(F.col("score").desc(), F.col("product_id"))
    return (
        score_pairs(fit_als(ratings, seed), ratings)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("customer_id", "rank", "product_id", "score")
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


#: Entries of the block of scores that a task holds at once, and what a group of the search holds: items, and customers
#: with what they bought.
BLOCK, SLICE, PART = 1 << 18, 50_000, 20_000


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows, summed entry by entry, so that equal vectors score alike in whatever block."""
    out = np.zeros((len(left), len(right)))
    for k in range(left.shape[1]):
        out += np.multiply.outer(left[:, k], right[:, k])
    return out


def _leaders(scores: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's greatest entries, greatest first, ties by column; what is -inf never leads."""
    held = scores > -np.inf
    if scores.shape[1] > limit:
        held &= scores >= np.partition(scores, -limit, axis=1)[:, -limit, None]
    row, column = np.nonzero(held)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < limit
    return row[first], column[first]


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)


def _best_of_slice(limit: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best items of a slice for each customer that looks into it, without those in its list ``held``."""
    out = pa.schema([("customer_id", pa.int32()), ("product_id", pa.int32()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        right = right.sort_by("product_id")
        ids, items = right.column("product_id").to_numpy(), _matrix(right.column("vector"))
        rows, found = max(1, BLOCK // len(ids)), []
        for start in range(0, left.num_rows, rows):
            block = left.slice(start, rows)
            scores = _products(_matrix(block.column("vector")), items)
            held = block.column("held").combine_chunks()
            of = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
            scores[of, np.searchsorted(ids, held.flatten().to_numpy(zero_copy_only=False))] = -np.inf
            row, column = _leaders(scores, limit)
            found.append((block.column("customer_id").to_numpy()[row], ids[column], scores[row, column]))
        return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], schema=out)

    return run


def _listed_by_name(stored: DataFrame) -> DataFrame:
    """A stored table whose rows always come in one order: of files of one size Spark reads that first which a folder lists
    first, and k-means starts otherwise with every order."""
    files = sorted(map(unquote, stored.inputFiles()))
    return stored.sparkSession.read.schema(stored.schema).parquet(*files)


@dataclass(frozen=True)
class CandidateIndex:
    """Item factors in cells, so that a customer is scored against the cells nearest to its own factors only.

    The largest inner product becomes the nearest neighbour when item vectors get one more entry that brings all of them
    to the length of the longest. Cells are the nearest of ``centres``, which are fitted by k-means; every item is in
    one cell. A customer looks into ``probes`` cells.
    """

    centres: tuple[tuple[float, ...], ...]
    longest: float
    probes: int

    @classmethod
    def fit(
        cls, items: DataFrame, probes: int = 16, per_root: float = 2.0, seed: int = 42, of_cell: int = 100
    ) -> CandidateIndex:
        """``items`` has product_id and vector; there are ``per_root`` cells for each unit of the root of the items, and a
        single one below 64 items. The centres learn from a sample of about ``of_cell`` items for each cell, taken by
        hash, where there are more; all items are put into cells."""
        size, longest = items.agg(F.count(F.lit(1)), F.max(_norm(F.col("vector")))).first()
        cells = 1 if size < 64 else math.ceil(per_root * math.sqrt(size))
        some = items
        if size > cells * of_cell > of_cell:
            some = items.filter(F.pmod(F.xxhash64("product_id"), F.lit(size)) < cells * of_cell)
        lifted = some.select(array_to_vector(cls._lifted(F.col("vector"), longest)).alias("features"))
        model = KMeans(k=cells, seed=seed, maxIter=15).fit(lifted) if cells > 1 else None
        centres = [lifted.first().features] if model is None else model.clusterCenters()
        return cls(tuple(tuple(map(float, c)) for c in centres), longest, probes)

    @staticmethod
    def _lifted(vector: Column, longest: float) -> Column:
        scaled = F.transform(vector, lambda v: v / F.lit(longest or 1.0))
        rest = F.greatest(F.lit(0.0), F.lit(1.0) - _dot(scaled, scaled))
        return F.concat(scaled, F.array(F.sqrt(rest)))

    def _nearest(self, rows: DataFrame, at: Column, cells: int) -> DataFrame:
        """``rows`` with the numbers of the cells whose centres are nearest to ``at``, which is as long as the centres."""
        centres = np.array(self.centres)
        squares = np.array([sum(x * x for x in c) for c in self.centres])
        step = max(1, BLOCK // len(centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    block = batch.slice(start, step)
                    near = 2 * _products(_matrix(block.column("_at")), centres) - squares
                    found = _leaders(near, cells)[1].astype(np.int32)
                    lists = pa.FixedSizeListArray.from_arrays(found, min(cells, len(centres))).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*block.columns[:-1], lists], names=[*block.schema.names[:-1], "cells"])

        kinds = T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
        find_package(rows.sparkSession)
        return rows.select("*", at.alias("_at")).mapInArrow(run, kinds)

    def cell_of_items(self, items: DataFrame) -> DataFrame:
        lifted = self._lifted(F.col("vector"), self.longest)
        return self._nearest(items, lifted, 1).withColumn("cell", F.col("cells")[0]).drop("cells")

    def cells_of_customers(self, customers: DataFrame) -> DataFrame:
        vector = F.col("vector")
        length = F.greatest(_norm(vector), F.lit(1e-300))
        unit = F.concat(F.transform(vector, lambda v: v / length), F.array(F.lit(0.0)))
        return self._nearest(customers, unit, self.probes).withColumn("cell", F.explode("cells")).drop("cells")


def _parts(weight: Column, size: int) -> Column:
    return F.ceil(F.sum(weight) / F.lit(size)).cast("int")


def _each(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _dealt(key: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(parts)).cast("int")


def recommend_new(
    sales: DataFrame, limit: int = 5, probes: int = 16, part_rows: int = PART, slice_rows: int = SLICE, seed: int = 42
) -> DataFrame:
    """Each customer's best products among those it has not bought, by the factor model.

    Customers meet the items of the cells they look into, never all items. A cell of many items is cut into slices of
    about ``slice_rows``, and the customers that look into one into parts of about ``part_rows``, to each of which the
    slice goes. A part is scored block by block: no pair is ever a row, and only the leaders leave the task. What a customer bought in
    a slice comes with the customer and is left out there.
    """
    ratings = cut_lineage(purchase_counts(sales), "ratings")
    model = fit_als(ratings, seed)

    def vectors(factors: DataFrame, name: str) -> DataFrame:
        return factors.select(F.col("id").alias(name), F.col("features").cast("array<double>").alias("vector"))

    items = _listed_by_name(cut_lineage(vectors(model.itemFactors, "product_id"), "items"))
    customers = cut_lineage(vectors(model.userFactors, "customer_id"), "customers")
    index = CandidateIndex.fit(items, probes, seed=seed)
    slim = F.col("vector").cast("array<float>").alias("vector")  # as the model has it
    placed = cut_lineage(index.cell_of_items(items).select("product_id", slim, "cell"), "cells")
    cells = placed.groupBy("cell").agg(_parts(F.lit(1), slice_rows).alias("slices"))
    placed = placed.join(cells, "cell").withColumn("slice", _dealt("product_id", "slices"))
    looks = index.cells_of_customers(customers).select("customer_id", slim, "cell").join(cells, "cell")
    looks = looks.withColumn("slice", _each("slices"))
    held = (
        ratings.join(placed.select("product_id", "cell", "slice"), "product_id")
        .groupBy("customer_id", "cell", "slice")
        .agg(F.collect_list("product_id").alias("held"))
    )
    asked = looks.join(held, ["customer_id", "cell", "slice"], "left").select(
        "customer_id", "vector", "cell", "slice", F.coalesce("held", F.array().cast("array<int>")).alias("held")
    )
    asked = cut_lineage(asked, "asked")
    slot = ["cell", "slice"]
    parts = cut_lineage(asked.groupBy(slot).agg(_parts(1 + F.size("held"), part_rows).alias("parts")), "parts")
    left = asked.join(parts, slot).withColumn("part", _dealt("customer_id", "parts")).drop("parts")
    right = placed.drop("slices").join(parts, slot).withColumn("part", _each("parts")).drop("parts")
    group = [*slot, "part"]
    best = left.groupBy(group).cogroup(right.groupBy(group)).applyInArrow(
        _best_of_slice(limit), "customer_id int, product_id int, score double"
    )
    order = Window.partitionBy("customer_id").orderBy(F.col("score").desc(), F.col("product_id"))
    return (
        cut_lineage(best, "best")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("customer_id", "rank", "product_id", "score")
    )
