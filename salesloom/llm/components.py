"""Connected components of links between ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import staged

#: Rounds after which the links are taken to be broken; the rounds needed grow with the logarithm of the ids.
MAX_ROUNDS = 60


#: Parts that the links of one id are cut into where they meet its smallest neighbour.
SALTS = 16


def part_of(key: str) -> Column:
    """The part that a row goes to, by the column ``key``."""
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def parts_met(part: Column) -> Column:
    """An aggregate: the parts that occur in a group, as the bits of a number."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), part))


def each_part(met: str) -> Column:
    """A row for each part in ``met``."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda p: F.getbit(met, p) == 1)).alias("part")


def _with_low(links: DataFrame, low: DataFrame) -> DataFrame:
    """Links (a, b) beside the smallest id around a.

    An id in the middle of very many links would bring them all to one task: they are dealt by the other id too, and
    the one row that they wait for goes to every part that has some. Spark takes that side for as small as before its
    rows were multiplied and would broadcast it, hence the hint.
    """
    every = low.select("a", "low", each_part("met")).hint("merge")
    return links.select("a", "b", part_of("b").alias("part")).join(every, ["a", "part"])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of an id is linked to the smallest id around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = parts_met(F.when(F.col("b") > F.col("a"), part_of("b"))).alias("met")
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), met)
    return _with_low(both.where("b > a"), low).select(F.col("b"), F.col("low")).toDF("a", "b").where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of an id, and the id, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"), parts_met(part_of("b")).alias("met"))
    joined = _with_low(down, low).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return joined.union(low.select("a", F.col("low").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (a, b) that isn't the smallest of its component.

    Each round is written out; it ends when a round changes nothing, told by a count and a sum of hashes.
    Partial minima meet before the shuffle, and a hub's links may be split among tasks.
    """
    now = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = staged(_small_star(_large_star(now)).distinct(), "links")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if mark == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        seen = mark
    raise RuntimeError("components did not settle")
