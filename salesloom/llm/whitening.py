"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

The scatter is summed per partition and then per row of the matrix; what the driver gets is one matrix of the vectors'
dimension. With V = L L', rotating the columns of L until they are orthogonal leaves the eigenvalues as their squared
norms and the components as the columns over their norms: V itself is never rotated, so that small eigenvalues keep
their relative accuracy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import staged

#: Steps of the integer grid per unit, and the components returned.
STEPS, COMPONENTS = 256, 4

#: Columns whose cosine is below this are orthogonal, and a pivot below this share of the largest is rounding.
EPSILON = 2.0**-52

#: Sweeps after which the rotations are taken not to settle; they settle quadratically, in about ten.
MAX_SWEEPS = 60

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def on_grid(vector: Column) -> Column:
    """floor(256 c) of every entry; null if the vector is null or any entry is null or not finite."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long")))


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is sound."""
    own = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].alias("v"))
    return own.select("vec_id", on_grid(F.col("v")).alias("x")).where("x IS NOT NULL AND size(x) > 0")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums; of entries whose sum might not fit a long, by integers of any length."""
    far = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    return [int(s) for s in (x if far * len(x) < 1 << 62 else x.astype(object)).sum(axis=0)]


def column_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of each dimension: a row per dimension and task is summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, [0] * width
        for batch in batches:
            x = matrix(batch.column(0), width)
            count += len(x)
            sums = [a + b for a, b in zip(sums, exact_sums(x))]
        yield pa.RecordBatch.from_pydict(
            {
                "dim": pa.array([*range(width), width], pa.int32()),
                "total": pa.array([str(s) for s in [*sums, count]], pa.string()),
            }
        )

    parts = fit.select("x").mapInArrow(run, "dim int, total string")
    totals = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r.dim: int(r.total) for r in totals}
    return found[width], [found[k] for k in range(width)]


@dataclass(frozen=True)
class Centre:
    """The mean S / n as a whole part and a remainder, so that large entries lose nothing when it is taken off."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = [s // self.n for s in self.sums]
        rest = np.array([s % self.n / self.n for s in self.sums])
        safe = max(map(abs, whole)) < 1 << 61 and (len(x) == 0 or np.abs(x.astype(np.float64)).max() < 2.0**61)
        off = x - np.array(whole, np.int64) if safe else x.astype(object) - np.array(whole, object)
        return off.astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per vector the sum of (n x - S)^2; null where it exceeds a long."""
        sums = np.array(self.sums, object)
        far = self.n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(abs(s) for s in self.sums)
        if far * far * x.shape[1] < 2.0**62:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def centred_scatter(fit: DataFrame, centre: Centre) -> np.ndarray:
    """The sum of (x - S/n)(x - S/n)' over the fit list.

    A task gives one row for each row of its matrix. Those of one row of the matrix meet in one task, which adds them
    one after the other, in the order of the tasks they come from.
    """
    width = len(centre.sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            c = centre.centred(matrix(batch.column(0), width))
            total += c.T @ c
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(width, dtype=np.int32)),
                pa.array(np.full(width, part, np.int32)),
                pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64())),
            ],
            ["dim", "part", "entries"],
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for dim, entries in zip(batch.column(0).to_pylist(), matrix(batch.column(1), width)):
                if dim != now:
                    if now is not None:
                        yield line(now, total)
                    now, total = dim, np.zeros(width)
                total = total + entries
        if now is not None:
            yield line(now, total)

    def line(dim: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "entries": pa.array([total.tolist()])})

    parts = fit.select("x").mapInArrow(partial, "dim int, part int, entries array<double>")
    ordered = parts.repartition("dim").sortWithinPartitions("dim", "part").select("dim", "entries")
    found = ordered.mapInArrow(added, "dim int, entries array<double>").collect()  # one row for each dimension
    out = np.zeros((width, width))
    for r in found:
        out[r.dim] = r.entries
    return (out + out.T) / 2


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L' and L lower triangular with one column per rank.

    Each step takes the largest diagonal entry left; it ends where that is rounding.
    """
    rest, size = v.copy(), len(v)
    order = np.arange(size)
    factor = np.zeros((size, size))
    largest = max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(size):
        p = k + int(np.argmax(rest.diagonal()[k:]))
        pivot = rest[p, p]
        if pivot <= size * EPSILON * largest:
            return factor[:, :k], order
        for a in (rest, factor):
            a[[k, p]] = a[[p, k]]
        rest[:, [k, p]] = rest[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(pivot)
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def rounds_of(columns: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns so that every two meet once in a sweep, and the pairs of a round are disjoint."""
    seats = [*range(columns), *([-1] if columns % 2 else [])]
    rounds = []
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], reversed(seats)) if a >= 0 and b >= 0]
        rounds.append(tuple(np.array(side, int) for side in zip(*pairs)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor's columns rotated pairwise until all are orthogonal; the columns span the same scatter."""
    a = factor.copy()
    if a.shape[1] < 2:
        return a
    rounds = rounds_of(a.shape[1])
    for _ in range(MAX_SWEEPS):
        turned = False
        for p, q in rounds:
            left, right = a[:, p], a[:, q]
            alpha, beta = (left * left).sum(0), (right * right).sum(0)
            gamma = (left * right).sum(0)
            skew = np.abs(gamma) > EPSILON * np.sqrt(alpha * beta)
            if not skew.any():
                continue
            turned = True
            p, q, left, right = p[skew], q[skew], left[:, skew], right[:, skew]
            zeta = (beta[skew] - alpha[skew]) / (2 * gamma[skew])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * left - c * t * right, c * t * left + c * right
        if not turned:
            return a
    return a


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    components: np.ndarray  # a column for each
    eigenvalues: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def decompose(covariance: np.ndarray, centre: Centre, most: int) -> Whitening:
    """The leading components, by falling eigenvalue; of either sign the one whose largest entry is positive."""
    factor, order = pivoted_cholesky(covariance)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    first = np.argsort(-norms, kind="stable")[:most]
    unit = np.zeros((len(covariance), len(first)))
    unit[order] = rotated[:, first] / norms[first]
    if len(first):
        unit *= np.sign(unit[np.abs(unit).argmax(0), np.arange(len(first))])
    return Whitening(centre, unit, norms[first] ** 2, float(np.trace(covariance)))


def identity_error(fit: DataFrame, made: Whitening) -> float:
    """The largest entry of whitened's covariance minus the identity, measured over the fit list."""
    width, count = made.components.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = made.project(matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(count)], [f"w{k}" for k in range(count)])

    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    whitened = fit.select("x").mapInArrow(run, ", ".join(f"w{k} double" for k in range(count)))
    found = whitened.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()  # covar_pop centres first
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs))


def fitted(rows: DataFrame, most: int = COMPONENTS) -> tuple[DataFrame, DataFrame, Whitening | None, Callable[[], float]]:
    """The sound rows, the fit list, the whitening over it (None without a component), and the identity error."""
    sound = vectors(rows)
    distinct = staged(sound.select("x").distinct(), "fit")
    widths = distinct.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    usual = widths.orderBy(F.col("n").desc(), F.col("width").desc()).first()
    if usual is None:
        return sound, distinct, None, lambda: 0.0
    sound, fit = (df.where(F.size("x") == usual.width) for df in (sound, distinct))
    n, sums = column_sums(fit, usual.width)
    centre = Centre(n, tuple(sums))
    made = decompose(centred_scatter(fit, centre) / n, centre, most)
    if not len(made.eigenvalues):
        return sound, fit, None, lambda: 0.0
    return sound, fit, made, lambda: identity_error(fit, made)


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per sound row of ``rows`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or has a null or non-finite entry go. All vectors should have one length: of
    several, the one that most distinct vectors have is the table's (the longer one in a tie), and rows of another go.
    Rows that repeat a vector count once in the fit and are returned each; a null vec_id stays. There are as many
    components as the covariance has rank, so that equal vectors alone, a single one, or an empty table give no row.
    Entries beyond 2^55 stand at the ends of long; a deviation that exceeds a long is null.
    """
    sound, _, made, error = fitted(rows, most)
    if made is None:
        return rows.sparkSession.createDataFrame([], f"{OUT}, identity_error double")
    width, count = made.components.shape
    explained = made.eigenvalues / made.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            rows_in = len(x)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(rows_in), count))),
                    "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows_in)),
                    "n": pa.array(np.full(rows_in * count, made.centre.n)),
                    "deviation": pa.array([d for d in made.centre.deviations(x) for _ in range(count)], pa.int64()),
                    "whitened": pa.array(made.project(x).ravel()),
                    "explained": pa.array(np.tile(explained, rows_in)),
                }
            )

    return sound.mapInArrow(run, OUT).withColumn("identity_error", F.lit(error()))
