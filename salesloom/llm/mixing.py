"""Mixing sources to target weights: Sainte-Lague apportionment of equal blocks of words, then seeded block selection.

The words that a mix takes come in blocks. Sainte-Lague gives blocks to sources by highest quotient
``target / (2 s - 1)`` for the s-th block, and again a source's blocks to its shards by their sizes. In a shard the
documents stand in a seeded order and their words form a ring; the shard's quota runs along the ring from a seeded
block on, at most twice around. What a quota has above that goes to the source's other shards. Nothing is enumerated by
block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import WORD, quoted, staged, whole_text, words_of, wrapped


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix; weights repeat along the sources in code-point order, a null source last."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most_repeats: int = 2
    block: int = 32
    seed: int = 20
    shard_rows: int = 256
    most_shards: int = 4096


def sainte_lague(rows: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: the seats of each group dealt to its rows by highest quotient weight / (2 s - 1).

    Rounding every exact share gives the seats above some quotient. What is missing (or too many) is then found among
    the next (or last) seats of each row; a share of x times the mean moves by ceil(x) + 1 seats at most, so that
    the candidates stay in proportion to the rows. Equal quotients go to the smaller key.
    """
    w, s = F.col(weight).cast("double"), F.col(seats).cast("double")
    whole = Window.partitionBy(*group)
    exact = F.when(F.col("_sum") > 0, s * w / F.col("_sum")).otherwise(F.lit(0.0))
    based = (
        rows.withColumn("_sum", F.sum(w).over(whole))
        .withColumn("_n", F.sum((w > 0).cast("long")).over(whole))
        .withColumn("_x", exact)
        .withColumn("_a", F.floor(F.col("_x") + 0.5))
        .withColumn("_short", F.when(F.col("_sum") > 0, F.col(seats) - F.sum("_a").over(whole)).otherwise(F.lit(0)))
    )
    reach = F.ceil(F.col("_x") * F.col("_n") / s) + 1
    open_ = based.where((F.col("_short") != 0) & (w > 0))
    steps = F.when(F.col("_short") > 0, reach).otherwise(F.least(reach, F.col("_a")))
    seat = F.when(F.col("_short") > 0, F.col("_a") + F.col("_k")).otherwise(F.col("_a") - F.col("_k") + 1)
    tried = (
        open_.where(steps >= 1)
        .withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), steps)))
        .withColumn("_quotient", w / (2 * seat - 1))
    )
    sign = F.signum("_short")
    ranked = tried.withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy(*group).orderBy((-sign * F.col("_quotient")), (sign * 1), key, "_k")),
    ).where(F.col("_rank") <= F.abs("_short"))
    moved = ranked.groupBy(*group, key).agg(F.sum(sign).cast("long").alias("_moved"))
    return (
        based.join(moved, [*group, key], "left")
        .withColumn("quota", (F.col("_a") + F.coalesce("_moved", F.lit(0))).cast("long"))
        .drop("_sum", "_n", "_x", "_a", "_short", "_moved")
    )


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Adds each source's ``target``: its weight's part of the words wanted, at most ``most_repeats`` times its size.

    The excess goes to the others by weight until none is above; with the sources ordered by cap / weight those at
    their cap come first, and all others get their weight times one common level. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(mix.weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), place + 1)
    cap = F.col("source_size").cast("double") * mix.most_repeats
    rows = (
        sources.withColumn("_one", F.lit(0))
        .withColumn("_weight", weight)
        .withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy("_one")) * F.lit(mix.share))
    )
    along = Window.partitionBy("_one").orderBy("_ratio", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("_cap").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_total") - capped) / left)
    level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(Window.partitionBy("_one"))
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_weight"), F.col("_cap")))
    return rows.withColumn("target", target).drop("_weight", "_cap", "_ratio", "_level")


def within_caps(cells: DataFrame, mix: Mix) -> DataFrame:
    """Adds each cell's ``words``: its quota of blocks, at most ``most_repeats`` times its size.

    The excess of a source fills its other cells up in a seeded order; the last one gets a part of a block.
    """
    whole = Window.partitionBy("source_key")
    along = whole.orderBy(F.xxhash64("source_key", "shard", F.lit(mix.seed + 1)), "shard")
    wanted, cap = F.col("quota") * mix.block, F.col("cell_size") * mix.most_repeats
    excess = F.sum("_excess").over(whole)
    before = F.sum("_room").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_room")
    return (
        cells.withColumn("_excess", F.greatest(wanted - cap, F.lit(0)))
        .withColumn("_room", F.greatest(cap - wanted, F.lit(0)))
        .withColumn("_more", F.greatest(F.lit(0), F.least(F.col("_room"), excess - before)))
        .withColumn("words", F.least(wanted, cap) + F.col("_more"))
        .drop("_excess", "_room", "_more")
    )


def _overlap(start: Column, end: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(end, high) - F.greatest(start, low))


def allocate(docs: DataFrame, mix: Mix = Mix(), keys: tuple[Column, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, and what is taken.

    ``copies`` is how often the whole document is taken, ``pieces`` the word ranges (start, words) taken besides.
    A null text has no word and a source of its own is the null one; a source without words has target 0. Repeated
    rows are documents of their own. The result depends on the rows alone, not on their order or partitions. ``keys`` go
    along.
    """
    names = [f"row_key{k}" for k in range(len(keys))]
    shards = max(1, min(mix.most_shards, -(-docs.count() // mix.shard_rows)))
    sized = staged(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            docs["source"].cast("string").alias("source"),
            F.regexp_count(whole_text(docs), F.lit(WORD)).cast("long").alias("size"),
            *[key.alias(name) for key, name in zip(keys, names)],
        )
        .withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("draw", F.xxhash64("doc_id", "size", F.lit(mix.seed)))
        .withColumn("shard", F.pmod(F.xxhash64("draw"), F.lit(shards)).cast("int")),
        "sized",
    )
    cells = sized.groupBy("source_key", "source", "shard").agg(F.sum("size").alias("cell_size"))
    sources = cells.groupBy("source_key", "source").agg(F.sum("cell_size").alias("source_size"))
    aimed = targets(sources, mix).withColumn("_seats", F.round(F.col("_total") / mix.block).cast("long"))
    by_source = sainte_lague(aimed, ["_one"], "source_key", "target", "_seats").select(
        "source_key", "source_size", "target", F.col("quota").alias("source_quota")
    )
    by_cell = sainte_lague(
        cells.drop("source").join(by_source, "source_key"), ["source_key"], "shard", "cell_size", "source_quota"
    )
    words, size = F.col("words"), F.col("cell_size")
    passes = F.when(size > 0, F.least(F.floor(words / size), F.lit(mix.most_repeats))).otherwise(F.lit(0))
    plan = staged(
        within_caps(by_cell, mix).withColumn("copies", passes.cast("long"))
        .withColumn(
            "run", F.when((size > 0) & (F.col("copies") < mix.most_repeats), words - F.col("copies") * size).otherwise(0)
        )
        .withColumn(
            "low", F.pmod(F.xxhash64("source_key", "shard", F.lit(mix.seed)), F.ceil(size / mix.block)) * mix.block
        )
        .select("source_key", "shard", "source_size", "target", "cell_size", "copies", "run", "low"),
        "quotas",
    )
    order = Window.partitionBy("source_key", "shard").orderBy("draw", F.col("doc_id").asc_nulls_last(), *names)
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    laid = sized.select("doc_id", "size", "source_key", "shard", "draw", *names).withColumn("end", end)
    laid = laid.withColumn("start", F.col("end") - F.col("size"))
    high = F.coalesce(F.col("low"), F.lit(0)) + F.col("run")
    low = F.coalesce(F.col("low"), F.lit(0))
    first = _overlap(F.col("start"), F.col("end"), low, F.least(high, F.col("cell_size")))
    again = _overlap(F.col("start"), F.col("end"), F.lit(0).cast("long"), high - F.col("cell_size"))
    pieces = F.array(
        F.struct((F.greatest(low, F.col("start")) - F.col("start")).alias("start"), first.alias("words")),
        F.struct(F.lit(0).cast("long").alias("start"), again.alias("words")),
    )
    return (
        laid.join(plan, ["source_key", "shard"])
        .withColumn("pieces", F.filter(pieces, lambda p: p["words"] > 0))
        .withColumn("taken", F.col("copies") * F.col("size") + first + again)
        .select("doc_id", "size", "source_size", "target", "taken", "copies", "pieces", *names)
    )


def _row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits that tell rows apart by all their columns, nulls too."""
    columns = [docs[quoted(f.name)] for f in docs.schema if f.dataType.typeName() not in ("map", "variant", "void")]
    nulls = F.array(*[c.isNull() for c in columns])
    return F.xxhash64(F.lit(1), nulls, *columns), F.xxhash64(F.lit(2), nulls, *columns)


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix: a row for every copy of a document that is taken, and one for every piece, which has its words alone.

    Columns are those of ``docs``; a piece has its words joined by blanks, and ``n_chars``, if there, follows the text.
    Each row takes its own parts, whatever its doc_id. Of rows that are equal throughout one lends its columns to the parts
    of all: parts are rows from the start, and never gathered.
    """
    keys = _row_keys(docs)
    chosen = allocate(docs, mix, keys).where("taken > 0")
    whole = F.filter(F.col("pieces"), lambda p: p["words"] == F.col("size"))
    times = F.array_repeat(
        F.struct(F.lit(-1).cast("long").alias("start"), F.col("size").alias("words")),
        (F.col("copies") + F.size(whole)).cast("int"),
    )
    parts = F.filter(F.col("pieces"), lambda p: p["words"] < F.col("size"))
    key = F.struct(F.col("row_key0").alias("a"), F.col("row_key1").alias("b")).alias("key")
    taken = chosen.select(key, F.explode(F.concat(times, parts)).alias("part"))
    rows = wrapped(docs, key=F.struct(keys[0].alias("a"), keys[1].alias("b")))
    found = rows.groupBy("key").agg(F.first("row").alias("row")).join(taken, "key")
    part, text = F.col("part"), F.col("row")["text"]
    cut = F.array_join(
        F.slice(words_of(text), (part["start"] + 1).cast("int"), part["words"].cast("int")), " "
    )
    new = {"text": F.when(part["start"] < 0, text).otherwise(cut)}
    if "n_chars" in docs.columns:
        n = F.when(part["start"] < 0, F.col("row")["n_chars"]).otherwise(F.length(new["text"]))
        new["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
