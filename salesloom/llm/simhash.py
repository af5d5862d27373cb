"""SimHash near-duplicates: fingerprints within three bits of each other, found through segment bit counts.

A fingerprint is 32 segments of two bits. The vector of its segments' bit counts is a point, and the Manhattan
distance of two points is at most the Hamming distance of the fingerprints. The points are joined on a grid of unit
cells: of six groups of segments, three differing bits leave at least three groups with equal counts, so that two
close points share a cell of one of the 20 grids made of three groups. What shares a cell is tested by the Manhattan
distance first and then by the exact one.

A point is held in thermometer code (the bits of each segment sorted), where the Manhattan distance is the number of
differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import id_and_text, one_per_key, row_key, staged, whole_text, wrapped
from salesloom.llm.components import components, each_part, part_of, parts_met

#: Fixed values of the fingerprint.
SHINGLE, SEED, DISTANCE = 3, 42, 3

#: Segments per group; three groups make a grid.
GROUPS = (6, 6, 5, 5, 5, 5)

#: Fingerprints of a cell that one task compares with as many others at a time.
BLOCK = 1024

_ODD = 0x5555555555555555


def fingerprint(text: str) -> int:
    """Bits that are set in over half of the shingles' hashes, repeats counted; 0 without words."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):  # a very long text doesn't unpack at once
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) per row, both hashes as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            columns = [batch.column(0), batch.column(2), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    rows = id_and_text(docs)
    return rows.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def thermometer(fp: Column) -> Column:
    """The bit counts of the segments, each as two sorted bits."""
    low, high = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    return F.shiftleft(low.bitwiseOR(high), 1).bitwiseOR(low.bitwiseAND(high))


def grid_masks() -> list[int]:
    """For each choice of three groups, the bits of their segments, as signed longs."""
    masks, start = [], 0
    for n in GROUPS:
        masks.append(((1 << 2 * n) - 1) << start)
        start += 2 * n
    chosen = [a | b | c for a, b, c in combinations(masks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _cell_links(cells: DataFrame) -> DataFrame:
    """Links inside sorted runs of (cell, side, fp, point, id): a forest that connects what is close.

    A run holds two blocks of one cell at most (side 0 and 1), or one (side 0).
    """

    def links_of(side, fps, points, ids):
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if side.any() else a
        near = np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= DISTANCE
        i, j = np.nonzero(near)
        exact = np.bitwise_count(fps[a[i]] ^ fps[b[j]]) <= DISTANCE
        i, j = a[i[exact]], b[j[exact]]
        return forest(i, j, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now[3:5] = (c.view(np.uint64) for c in now[3:5])  # of a negative number numpy counts another's bits
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            new = (rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])
            ends = np.flatnonzero(new) + 1  # the last run may go on in the next batch
            if len(ends):
                yield table(rest, np.concatenate([[0], ends]))
                rest = [c[ends[-1] :] for c in rest]
        if rest is not None and len(rest[0]):
            yield table(rest, np.array([0, len(rest[0])]))

    def table(c, bounds):
        found = []
        sizes = np.diff(bounds)
        two = bounds[:-1][(sizes == 2)]
        if len(two):  # most runs are pairs, all of which go at once
            close = np.bitwise_count(c[3][two] ^ c[3][two + 1]).astype(np.int64) <= DISTANCE
            close &= np.bitwise_count(c[4][two] ^ c[4][two + 1]) <= DISTANCE
            found.append((c[5][two[close]], c[5][two[close] + 1]))
        for s, e in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist()):
            found.append(links_of(c[2][s:e], c[3][s:e], c[4][s:e], c[5][s:e]))
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells.select("cell", "pair", "side", "fp", "point", "id").mapInArrow(run, "a long, b long")


def forest(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between rows i and j, links of every row to the smallest id that it reaches."""
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    order = np.argsort(ids, kind="stable")
    smallest = np.empty(len(ids), np.int64)
    smallest[root[order][::-1]] = ids[order][::-1]
    far = smallest[root] != ids
    return ids[far], smallest[root][far]


def close_links(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the ids of ``points`` (id, fp, one row per fingerprint) that connect the close ones.

    Cells with one point go. A cell of n points is cut by hash into ceil(n / block) parts, and each pair of parts
    is one piece of work, so that no task holds more than two parts and no pair becomes a row.
    """
    coded = points.select("id", "fp", thermometer(F.col("fp")).alias("point"))
    masks = grid_masks()
    cell = F.explode(
        F.array(*[F.xxhash64(F.lit(k), F.col("point").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)])
    )
    celled = coded.withColumn("cell", cell)
    many = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes the cells for as few as the points and would broadcast them.
    shared = celled.join(many.hint("merge"), "cell").withColumn("parts", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    work = (
        shared.withColumn("own", own)
        .withColumn("other", other)
        .withColumn("pair", F.least("own", "other").cast("long") * F.col("parts") + F.greatest("own", "other"))
        .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    )
    keyed = work.repartition(F.col("cell"), F.col("pair")).sortWithinPartitions("cell", "pair")
    return _cell_links(keyed)


def classed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, label, component_id) per row: the smallest fingerprint and doc_id of its component.

    Fingerprints are what is linked, not ids, which texts without a link may share.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    points = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "points")
    found = components(close_links(points.where("id IS NOT NULL").select(F.col("fp").alias("id"), "fp")))
    found = found.select(F.col("id").alias("fp"), F.col("component_id").alias("label"))
    labelled = points.join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labelled = staged(labelled.withColumn("part", part_of("fp")), "labelled")
    # The points of a large component wait for its one row in several parts; it may be taken for too small, as in components.
    smallest = labelled.groupBy("label").agg(F.min("id").alias("component_id"), parts_met(F.col("part")).alias("met"))
    smallest = smallest.select("label", "component_id", each_part("met")).hint("merge")
    classes = labelled.join(smallest, ["label", "part"]).select("fp", "label", "component_id")
    return prints.join(classes, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null texts are empty texts; texts without a word share fingerprint zero. Rows without doc_id get the component
    of their fingerprint if that has ids, else null. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    return classed(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of every component, that with its smallest id, and all documents without an id.

    Of several rows with that id in the component the text of least hash stays, and of rows that repeat both the one whose
    columns hash lowest.
    """
    named = classed(docs).where("doc_id = component_id")
    kept = named.groupBy("label", "component_id").agg(F.min("text_hash").alias("text_hash"))
    kept = staged(kept.select(row_key(F.col("component_id"), F.col("text_hash")).alias("key")).distinct(), "kept")
    known = docs["doc_id"].isNotNull()
    rows = wrapped(docs.where(known), key=row_key(docs["doc_id"].cast("long"), F.xxhash64(whole_text(docs))))
    chosen = one_per_key(rows.join(kept, "key", "left_semi"), docs).select("row.*")
    return chosen.unionByName(wrapped(docs.where(~known)).select("row.*"))
