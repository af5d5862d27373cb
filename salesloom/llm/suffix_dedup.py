"""Removes every byte that lies in a 100-byte string which also starts earlier in the corpus.

Windows of 100 bytes are not sorted one by one. The 24-byte string of least hash in a window is its anchor, wherever
the window occurs; successive windows with one anchor make a run, about one for every 40 bytes. Runs of equal anchor
text meet in one task. A run whose bytes are those of an earlier run goes whole. What is left are different runs
around an equal anchor: there the contexts right and left of the anchors are sorted as suffixes (``suffix_sort``), and
shared prefixes tell which windows occur earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import id_and_text, staged
from salesloom.llm.suffix_sort import repeated_windows
from salesloom.operators.ordering import with_position

WINDOW = 100
ANCHOR = 24

OUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

#: Bytes that are hashed at once, and text whose runs are compared before the shuffle.
PIECE, GATHERED = 1 << 20, 16 << 20

#: Different runs around one anchor that a task sorts; those of a more frequent anchor are cut into windows, which are
#: aggregated by their digests.
CROWD = 5000

_FACTOR = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each ANCHOR-byte string, by doubling lengths."""
    done, size, part, length, bits = None, 0, b.astype(np.uint64) + np.uint64(1), 1, ANCHOR
    while True:
        if bits & 1:
            if done is None:
                done, size = part, length
            else:
                n = len(b) - size - length + 1
                done = done[:n] * np.uint64(pow(_FACTOR, length, 1 << 64)) + part[size : size + n]
                size += length
        bits >>= 1
        if not bits:
            break
        n = len(part) - length
        part = part[:n] * np.uint64(pow(_FACTOR, length, 1 << 64)) + part[length : length + n]
        length *= 2
    for _ in range(2):
        done = (done ^ (done >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return done ^ (done >> np.uint64(32))


def _window_least(packed: np.ndarray, width: int) -> np.ndarray:
    length = 1
    while 2 * length <= width:
        packed = np.minimum(packed[:-length], packed[length:])
        length *= 2
    rest = width - length
    return np.minimum(packed[:-rest], packed[rest:]) if rest else packed


def _runs_of_piece(buffer: bytes, starts: np.ndarray, ends: np.ndarray):
    """Runs (start, count, anchor, anchor hash) of the texts that lie at [start, end) of the buffer."""
    long = ends - starts >= WINDOW
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return None
    hashes = _gram_hashes(np.frombuffer(buffer, np.uint8))
    # the hash's upper bits, then the position: the leftmost of the least
    place = np.uint64((1 << 22) - 1)
    packed = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_window_least(packed, WINDOW - ANCHOR + 1) & place).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int32)
    inside[starts] += 1
    np.add.at(inside, ends - WINDOW + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[starts] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor))
    first, last = first[inside[first]], last[inside[first]]
    text = np.searchsorted(ends, first, side="right")
    last = np.minimum(last, ends[text] - WINDOW + 1)
    return first, last - first, anchor[first], hashes[anchor[first]]


def _pieces(texts: list[bytes]):
    """(text number, offset, bytes): whole texts, or parts of long ones that overlap by a window less one byte."""
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            yield k, at, t[at : at + PIECE + WINDOW - 1]


def runs_of(ids: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """Columns key, same, doc_id, place of all runs of the texts.

    ``same`` identifies a run's bytes among those of its key. ``place`` packs start, count and lead (of the anchor). A run
    that repeats an earlier one of these texts is marked (bit 15) and has a key of its own: it goes, whoever else has it.
    """
    out: list[list[np.ndarray]] = []
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not held:
            return
        buffer = b"".join(p for _, _, p in held)
        ends = np.cumsum([len(p) for _, _, p in held])
        starts = ends - np.array([len(p) for _, _, p in held])
        found = _runs_of_piece(buffer, starts, ends)
        if found:
            first, count, anchor, key = found
            lead = anchor - first
            piece = np.searchsorted(ends, first, side="right")
            digest = xxhash.xxh3_64_intdigest
            same = np.array(
                [digest(buffer[s:e], a) for s, e, a in zip(first.tolist(), (first + count + WINDOW - 1).tolist(), lead.tolist())],
                np.uint64,
            )
            doc = ids[np.array([k for k, _, _ in held])[piece]]
            start = first - starts[piece] + np.array([at for _, at, _ in held])[piece]
            out.append([key.view(np.int64), same.view(np.int64), doc, (start << 16) | (count << 8) | lead])
        held.clear()

    size = 0
    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[2])
        if size >= PIECE:
            flush()
            size = 0
    flush()
    if not out:
        return [np.zeros(0, np.int64)] * 4
    key, same, doc, place = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((place, doc, same, key))
    key, same, doc, place = key[order], same[order], doc[order], place[order]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (same[1:] != same[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
    again = (doc != doc[first]) | (place != place[first])
    with np.errstate(over="ignore"):
        own = (doc * np.int64(0x2545F4914F6CDD1D)) ^ (place * np.int64(0x369DEA0F31A53F85)) ^ same
    return [np.where(again, own, key), same, doc, np.where(again, place | (1 << 15), place)]


def all_runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        texts: list[bytes] = []
        size = 0

        def table() -> pa.RecordBatch:
            with np.errstate(over="ignore"):
                columns = runs_of(np.concatenate(ids), texts)
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "same", "doc_id", "place"])

        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            for t in batch.column(1).to_pylist():
                texts.append(t.encode("utf-8"))
                size += len(texts[-1])
            if size >= GATHERED:
                yield table()
                size = 0
        if ids:
            yield table()

    return docs.mapInArrow(run, "key long, same long, doc_id long, place long")


def _sorted_out(runs: DataFrame) -> DataFrame:
    """(doc_id, start, count) of windows that occur earlier among different runs of one key, at most CROWD of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list | None = None

        def table(c: list, n: int) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate([[True], c[0][1:n] != c[0][: n - 1]]))
            strings, lead, count = c[5][:n], c[4][:n], c[3][:n]
            place = np.stack([c[1][:n], c[2][:n]], axis=1)
            repeated = repeated_windows(WINDOW, group, strings, lead, count, place)
            edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            return pa.RecordBatch.from_arrays(
                [pa.array(c[1][row]), pa.array(c[2][row] + begin), pa.array(end - begin)], ["doc_id", "start", "count"]
            )

        for batch in batches:
            now: list = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            now.append(batch.column(5).to_pylist())
            if rest is not None:
                now = [np.concatenate([a, b]) for a, b in zip(rest[:5], now[:5])] + [rest[5] + now[5]]
            new = now[0][1:] != now[0][:-1]
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0  # the last group may go on
            if last >= 4096:
                yield table(now, last)
                now = [c[last:] for c in now]
            rest = now
        if rest is not None and len(rest[0]):
            yield table(rest, len(rest[0]))

    columns = ["key", "doc_id", "start", "count", "lead", "bytes"]
    return runs.select(columns).mapInArrow(run, "doc_id long, start long, count long")


def _aggregated(runs: DataFrame) -> DataFrame:
    """The same for the runs of crowded keys: each window by itself.

    A task's windows are aggregated before they shuffle, by 128 bits of SHA-256; only digests that occur in two places
    are joined back, and no group is ever held by a task.
    """
    step = F.col("i")
    windows = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).select(
        F.substring(
            F.unhex(F.sha2(F.substring(F.col("bytes"), step.cast("int") + 1, F.lit(WINDOW)), 256)), 1, 16
        ).alias("digest"),
        "doc_id",
        (F.col("start") + step).alias("start"),
    )
    place = F.struct("doc_id", "start")
    repeated = (
        windows.groupBy("digest")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    return windows.join(repeated, "digest").where(place != F.col("first")).select(
        "doc_id", "start", F.lit(1).cast("long").alias("count")
    )


def _cleaned(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode("utf-8")
                kept, at, removed, n = hashlib.sha256(), 0, 0, 0
                merged: list[list[int]] = []
                for place in sorted(spans or []):
                    start, end = place >> 32, (place >> 32) + (place & 0xFFFFFFFF) + WINDOW - 1
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                for start, end in merged:
                    kept.update(raw[at:start])
                    removed, at, n = removed + end - start, end, n + 1
                kept.update(raw[at:])
                for column, value in zip(out, (len(raw), removed, n, kept.hexdigest())):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(out, types)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty. Documents come in order of doc_id; rows that repeat an id and its text are one document and get
    the same result. Rows with one id and different texts are documents of their own, in the order of the texts' hashes.
    A row without doc_id takes no part: nothing is removed from it, or elsewhere because of it. An empty table gives an
    empty one.
    """
    rows = id_and_text(docs)
    named, nameless = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    hashed = named.select("doc_id", F.xxhash64("text").alias("text_hash"))
    low, high = F.min("text_hash").alias("low"), F.max("text_hash").alias("high")
    if hashed.groupBy("doc_id").agg(low, high).where("low <> high").isEmpty():
        done = _removed(named, crowd)
    else:  # ids are numbered anew, in their order, a number for each text
        numbers = staged(with_position(hashed.distinct(), ["doc_id", "text_hash"], "number"), "numbers")
        known = named.withColumn("text_hash", F.xxhash64("text")).join(numbers, ["doc_id", "text_hash"])
        own = _removed(staged(known.select(F.col("number").alias("doc_id"), "text"), "numbered"), crowd)
        named_again = numbers.select(F.col("number"), F.col("doc_id").alias("own_id"))
        done = own.join(named_again, F.col("doc_id") == F.col("number")).select(F.col("own_id").alias("doc_id"), *OUT[1:])
    return done.unionByName(_cleaned(nameless.withColumn("spans", F.lit(None).cast("array<long>"))))


def _removed(texts: DataFrame, crowd: int) -> DataFrame:
    """The result for rows whose doc_id is never null and has one text."""
    runs = all_runs(texts).repartition("key")  # once, for both windows
    start, count = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(127))
    lead, marked = F.col("place").bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(1 << 15)) != 0
    of_class = Window.partitionBy("key", "same").orderBy("doc_id", "place")
    ranked = runs.withColumn("rank", F.rank().over(of_class)).withColumn("row", F.row_number().over(of_class))
    classes = F.sum((F.col("row") == 1).cast("int")).over(Window.partitionBy("key"))
    ranked = ranked.withColumn("classes", classes).withColumn("goes", marked | (F.col("rank") > 1))
    found = staged(
        ranked.where(F.col("goes") | ((F.col("row") == 1) & (F.col("classes") > 1))).select(
            "key", "doc_id", start.alias("start"), count.alias("count"), lead.alias("lead"), "classes", "goes"
        ),
        "runs",
    )
    bytes_of = F.substring(F.col("text").cast("binary"), F.col("start").cast("int") + 1, F.col("count").cast("int") + WINDOW - 1)
    different = (
        found.where("NOT goes")
        .join(texts, "doc_id")
        .select("key", "doc_id", "start", "count", "lead", "classes", bytes_of.alias("bytes"))
    )
    crowded = F.col("classes") > crowd
    grouped = different.where(~crowded).repartition("key").sortWithinPartitions("key")
    gone = found.where("goes").select("doc_id", "start", "count").unionByName(_sorted_out(grouped))
    if not found.where(~F.col("goes") & crowded).isEmpty():
        gone = gone.unionByName(_aggregated(different.where(crowded)))
    packed = F.shiftleft("start", 32).bitwiseOR(F.col("count"))
    spans = gone.groupBy("doc_id").agg(F.collect_list(packed).alias("spans"))  # bounded by one text
    return _cleaned(texts.join(spans, "doc_id", "left"))
