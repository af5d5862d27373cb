"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel, so that a linear fit on them is a kernel fit on the statistics. The fit
needs only sums over rows: each partition adds up its normal equations, and the driver solves their total.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import id_and_text, staged

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>@^~_=+/\\{}[]"
_STOPS = b".,;:!?"

FEATURES = 13

#: Texts labelled 1 are predicted from this score on.
GOOD = 0.3


def features_of(text: str) -> list[float]:
    """Statistics of a whole text, none growing faster than the logarithm of its length."""
    raw = text.encode("utf-8")
    words = raw.split()  # at ASCII white space
    n, size = len(words), max(1, len(raw))
    lines = [line for line in raw.split(b"\n") if line.strip()]

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    per_word = 1 / max(1, n)
    letters = sum(map(len, words))
    return [
        math.log1p(n),
        letters * per_word,
        len(set(words)) * per_word,
        len(set(zip(words, words[1:], words[2:]))) * per_word,
        sum(map(bytes.__eq__, words, words[1:])) * per_word,
        share(_SYMBOLS),
        raw.count(b"!") / size,
        share(_UPPER),
        share(_DIGITS),
        share(_STOPS),
        (len(raw) - len(text)) / size,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        math.log1p(letters / max(1, len(lines))),
    ]


@dataclass(frozen=True)
class Fit:
    """``sample`` bounds the labelled rows learned from; one in ``calibrate`` of them calibrates, the rest fit."""

    sample: int = 50_000
    components: int = 256
    width: float = 2.5
    ridge: float = 1e-3
    calibrate: int = 4
    seed: int = 7
    bins: int = 400


def projection(how: Fit) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(how.seed)
    return (
        rng.normal(size=(FEATURES, how.components)) / how.width,
        rng.uniform(0, 2 * np.pi, how.components),
    )


def fourier(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, how: Fit) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    weights, phase = projection(how)
    z = np.clip((x - centre) / scale, -6, 6)
    waves = np.sqrt(2 / how.components) * np.cos(z @ weights + phase)
    return np.hstack([waves, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float).reshape(-1, FEATURES)


def isotonic(at: np.ndarray, good: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing shares closest to good / rows, in order of ``at``."""
    blocks: list[list[float]] = []
    for g, n in zip(good[np.argsort(at)], rows[np.argsort(at)]):
        blocks.append([g, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + n, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), g / n) for g, n, k in blocks]) if blocks else np.zeros(0)


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    how: Fit

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.centre, self.scale, self.how) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: the checksum of the id as text is divisible by 5. A null id's text is empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) per row: the features of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, x array<double>")


def _summed(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, how: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Normal equations of (x, label) rows: one pair of sums per partition, added up."""
    d = how.components + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            f = fourier(_matrix(batch.column(0)), centre, scale, how)
            gram += f.T @ f
            target += f.T @ np.array(batch.column(1).to_pylist(), dtype=float)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([target.tobytes()])], ["gram", "target"])

    gram, target = np.zeros((d, d)), np.zeros(d)
    for r in rows.select("x", "label").mapInArrow(run, "gram binary, target binary").collect():  # a few partitions
        gram += np.frombuffer(r["gram"]).reshape(d, d)
        target += np.frombuffer(r["target"])
    return gram, target


def fit(stats: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model | None:
    """The model, from labelled rows that aren't held out; None without any. The sample has the smallest hashes."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("label")
    )
    sample = staged(
        stats.join(marked.where(~held_out(F.col("doc_id"))), "doc_id")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(how.seed)), F.lit(how.calibrate)))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(how.sample)
        .repartition(4),
        "labelled",
    )
    each = [F.col("x")[k] for k in range(FEATURES)]
    row = sample.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in each]).alias("centre"),
        F.array(*[F.stddev_pop(c) for c in each]).alias("scale"),
    ).first()
    if not row["n"]:
        return None
    centre, scale = np.array(row["centre"]), np.array(row["scale"])
    scale = np.where(scale > 1e-9, scale, 1.0)
    fitted, calibrating = sample.where("part > 0"), sample.where("part = 0")
    gram, target = _summed(fitted, centre, scale, how)
    weights = np.linalg.solve(gram + how.ridge * max(1.0, gram[-1, -1]) * np.eye(len(gram)), target)
    raw = Model(centre, scale, weights, np.zeros(1), np.zeros(1), how)
    bins = _calibration(calibrating, raw) or _calibration(sample, raw)
    at, good, n = (np.array(c, dtype=float) for c in zip(*sorted(bins)))
    return Model(centre, scale, weights, at, isotonic(at, good, n), how)


def _calibration(rows: DataFrame, model: Model) -> list[tuple[float, float, float]]:
    """(raw score, rows labelled 1, rows) by bin of the raw score."""
    bins = model.how.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column(0))), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(raw * bins).astype(np.int64)), batch.column(1)], ["bin", "label"])

    counted = rows.select("x", "label").mapInArrow(run, "bin long, label int").groupBy("bin").agg(
        F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")
    )
    return [(r["bin"] / bins, r["good"], r["n"]) for r in counted.collect()]  # 3 * bins rows at most


def score_documents(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other. Without labels to learn from every score is 0.5. Repeated rows
    give repeated rows; an empty table gives an empty one.
    """
    stats = staged(statistics(docs), "features")
    model = fit(stats, labels, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            score = model.score(x) if model and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )
