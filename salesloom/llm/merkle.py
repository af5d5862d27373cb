"""Merkle manifest of a dataset: a 16-way tree per source, one tree over the sources, proofs and their check.

A level is a table of nodes (tree, i): a node's siblings have the indices of its run of 16 that its own slot is shifted
to, and one equijoin on (tree, run, slot) brings them. The rows of slot zero then emit the run's parent. Digests are
32 bytes in tables and shuffles, and hex text where they are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.llm.common import staged
from salesloom.operators.ordering import with_position

#: Nodes per run, and which documents are tampered with.
FAN, TAMPERED_EVERY = 16, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Leaves whose source is looked up by one key, so that no source is a hot one.
STRETCH = 1 << 12

#: Id of the tree over the sources; trees of sources are numbered from 0.
TOP = -1

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: binary, right: binary>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*values: Column) -> Column:
    """SHA-256 of joined texts, as bytes."""
    return F.unhex(F.sha2(F.concat(*values), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def parent_of(*digests: Column) -> Column:
    """SHA-256 of joined digests, which are hashed as hex text."""
    return F.unhex(F.sha2(as_hex(F.concat(*digests)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, forged): forged is the leaf of the tampered document where there is one."""
    rows = docs.select(*[docs[f].alias(f) for f in FIELDS])
    head = [field(F.col(f)) for f in FIELDS[:-1]]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        digest_of(*head, field(F.col("text"))).alias("leaf"),
        F.when(hit, digest_of(*head, field(lowered))).alias("forged"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """(doc_id, forged, tree, i, m, digest): trees numbered in the order of the sources, leaves within by doc_id.

    One sort orders all sources; where a source starts and how many leaves it has is found per stretch of the sorted
    rows, so that the rows of a large source meet these figures under many keys.
    """
    numbered = staged(rows.withColumn("slot", F.monotonically_increasing_id()), "leaves")
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf", "forged", "slot")]
    there = with_position(numbered, order, "position", start=0).withColumn(
        "stretch", F.expr(f"position div {STRETCH}")
    )
    # A struct is never null, so that rows without source meet under a key of their own.
    there = there.withColumn("owner", F.struct("source"))
    parts = there.groupBy("stretch", "owner").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("rows"))
    trees = parts.groupBy("owner").agg(F.min("first").alias("tree"), F.sum("rows").alias("m"))
    where = parts.select("stretch", "owner").join(trees, "owner")
    out = there.join(where, ["stretch", "owner"]).select(
        "doc_id", "forged", "tree", (F.col("position") - F.col("tree")).alias("i"), "m", F.col("leaf").alias("digest")
    )
    return staged(out, "placed")


@contextmanager
def cut_by_run(spark: SparkSession) -> Iterator[None]:
    """While it holds, tables cut by (tree, run) serve joins and groupings that have the slot as a further key."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def families(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, i, run, slot, m, digest, left, right, carried): every node with its siblings on either side.

    Asking rows (each slot shifted by 1 to 15) and answering ones are both cut by run before they multiply, so that under
    ``cut_by_run`` neither the join on the sibling's slot nor the grouping by node shuffles. A run has 16 nodes at most.
    """
    slot = F.col("i") % FAN
    dealt = nodes.withColumns({"run": F.expr(f"i div {FAN}"), "slot": slot}).repartition("tree", "run")
    size = F.least(F.lit(FAN), F.col("m") - F.col("run") * FAN)
    shifts = F.sequence(F.lit(1), F.lit(FAN - 1))
    asked = dealt.select(
        "tree", "run", "slot",
        F.explode(F.transform(shifts, lambda s: (F.col("slot") + s) % FAN)).alias("there"),
        size.alias("size"),
    ).where("there < size")
    answers = dealt.select("tree", "run", F.col("slot").alias("there"), F.col("digest").alias("sibling"))
    found = (
        asked.join(answers, ["tree", "run", "there"])
        .groupBy("tree", "run", "slot")
        .agg(F.array_sort(F.collect_list(F.struct("there", "sibling"))).alias("siblings"))
    )
    nothing = F.lit(b"")

    def side(keep) -> Column:
        chosen = F.filter(F.coalesce("siblings", F.array().cast("array<struct<there: long, sibling: binary>>")), keep)
        return F.aggregate(chosen, nothing, lambda so_far, s: F.concat(so_far, s["sibling"]))

    return dealt.join(found, ["tree", "run", "slot"], "left").select(
        "tree", "i", "run", "slot", "m", "digest", *carried,
        side(lambda s: s["there"] < F.col("slot")).alias("left"),
        side(lambda s: s["there"] > F.col("slot")).alias("right"),
    )


def grow(nodes: DataFrame, largest: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The families of every level, from the leaves up, and the root of every tree as (tree, m, digest).

    ``largest`` is the most leaves of any tree. A tree of one node stands on no level but the first, where it has
    no siblings. Here m is a tree's number of nodes on the level.
    """
    levels, roots, now = [], [], nodes
    while True:
        roots.append(now.where("m = 1").select("tree", "digest", F.lit(len(levels)).alias("height")))
        if levels and largest <= 1:
            break
        now = now if not levels else now.where("m > 1")
        with cut_by_run(nodes.sparkSession):
            levels.append(staged(families(now, carried if not levels else []), f"level-{len(levels)}"))
        parent = parent_of(F.col("digest"), F.col("right")).alias("digest")
        firsts = levels[-1].where("slot = 0 AND m > 1")
        now = firsts.select("tree", F.col("run").alias("i"), F.expr(f"(m + {FAN - 1}) div {FAN} AS m"), parent)
        largest = -(-largest // FAN)
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return levels, every


def descend(levels: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """Leaves with their path: the siblings of the leaf, of its parent and so on up to the root, then what lies above.

    ``above`` has (tree, height, path) for every root. From the top level down a node's path is its own siblings and
    then its parent's path, which all its siblings share.
    """
    paths = None
    for k in reversed(range(len(levels))):
        done = above.where(F.col("height").isin([0, 1] if k == 0 else [k + 1]))
        done = done.select("tree", F.lit(0).cast("long").alias("i"), "path")
        over = done if paths is None else paths.unionByName(done)
        over = over.select("tree", F.col("i").alias("run"), F.col("path").alias("rest"))
        own = F.when(F.col("m") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast(PATH))
        paths = levels[k].join(over, ["tree", "run"]).select(
            "tree", "i", F.concat(own, "rest").alias("path"), *(["digest", *carried] if k == 0 else [])
        )
    return paths


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, s: parent_of(s["left"], node, s["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows with a null doc_id stand first in their source and are not tampered with; documents without source are a
    source of their own, the first. Rows that share doc_id and source stand by their leaf; repeated rows are a leaf
    each. An empty text is not a null one. Without siblings (one document in all) the proof is the digest of nothing,
    and the leaf is subroot and root. An empty table gives an empty one.
    """
    nodes = placed(leaves(docs))
    largest = nodes.agg(F.max("m")).first()[0] or 0
    levels, subroots = grow(nodes, largest, ["doc_id", "forged"])
    subroots = staged(subroots, "subroots")
    trees = subroots.count()
    ordered = with_position(subroots, ["tree"], "i", start=0)
    top = ordered.select(
        F.lit(TOP).cast("long").alias("tree"), "i", F.lit(trees).cast("long").alias("m"), "digest",
        F.col("tree").alias("of"), "height",
    )
    top_levels, roots = grow(top, trees, ["of", "height"])
    root = roots.select("digest").first()
    root = F.lit(None if root is None else bytes(root[0])).cast("binary")
    end = F.array().cast(PATH)
    over = descend(top_levels, roots.select("tree", "height", end.alias("path")), ["of", "height"])
    above = staged(over.select(F.col("of").alias("tree"), "height", "path", F.col("digest").alias("subroot")), "above")
    # The subroot travels as the first step of what lies above, so that it needs no join of its own.
    led = above.select(
        "tree", "height",
        F.concat(F.array(F.struct(F.col("subroot").alias("left"), F.lit(None).cast("binary").alias("right"))), "path").alias("path"),
    )
    found = descend(levels, led, ["doc_id", "forged"])
    mark = F.filter("path", lambda s: s["right"].isNull())
    steps = F.filter("path", lambda s: s["right"].isNotNull())
    proved = found.select(
        "doc_id", "forged", "digest", F.element_at(mark, 1)["left"].alias("subroot"), steps.alias("steps")
    )
    siblings = F.array_join(F.transform("steps", lambda s: as_hex(F.concat(s["left"], s["right"]))), "")
    folded = fold(F.coalesce("forged", "digest"), F.col("steps"))
    return proved.select(
        "doc_id",
        as_hex(F.col("digest")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        as_hex(root).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        as_hex(folded).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
