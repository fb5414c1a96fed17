"""Whitened embeddings by a one-sided Jacobi singular value decomposition.

Entries c become whole numbers floor(64 * c) + 1,000,000, so counts and sums are exact whatever the order. Each task
centres its rows by the exact means and keeps, block by block, the triangular factor R of what it has seen (QR of R above
the next block); the tasks' factors are combined the same way, a fixed number at a time, until one is left: R'R is n times
the covariance, without squaring anything. On R, a dims x dims matrix, plane rotations make the columns orthogonal,
disjoint pairs at once; the accumulated rotations are the components, and the columns' lengths over sqrt(n) the standard
deviations, accurate even where small ones are far below the large ones.

Defined cases: rows are left out whose vector is null, empty, holds null or non-finite entries, or entries of 2^55 or more
(which a long can't hold 64 times), or whose length isn't the most frequent one (ties: the longest). A null vec_id and
repeated rows are rows like others. Components without variance (a standard deviation below 1e-12 of the largest) have a
null whitened value; without any variance explained is null too, and identity_error is null if no component has any. A deviation beyond a long
is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

SCALE, SHIFT = 64, 1_000_000
TOO_LARGE = float(2**55)
BLOCK = 4096
#: Factors of tasks that are combined at once take at most so many bytes.
COMBINED = 1 << 28


def valid(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector can be used, those of the most frequent length, as doubles in the column v."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= TOO_LARGE))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))).select("vec_id", v.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (lengths["d"] if lengths else 0))


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    """rows x dims."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, dims)


@dataclass
class Means:
    """The exact means of whole numbers: n rows, and their sums as Python integers."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.floor = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % self.n for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """By row the sum of (n * x - sum)^2, exact."""
        near = x - self.floor
        size = ((self.n * np.abs(near).astype(np.float64) + self.rest) ** 2).sum(1)
        fits = size < 2.0**62
        d = self.n * near[fits] - self.rest
        out: list[int | None] = [None] * len(x)
        for i, s in zip(np.flatnonzero(fits), (d * d).sum(1), strict=True):
            out[i] = int(s)
        for i in np.flatnonzero(~fits & (size < 2.0**64)):
            s = sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(near[i], self.rest, strict=True))
            out[i] = s if s < 2**63 else None
        return out


def exact_means(rows: DataFrame, dims: int) -> Means:
    """A task's sums are split in high and low halves, so that neither they nor their sums overflow."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for b in batches:
            x = whole_numbers(b.column(0), dims)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array([n] * dims, pa.int64()), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    sums = rows.select("v").mapInArrow(add, "i int, n long, high long, low long").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))
    found = sorted(sums.collect(), key=lambda r: r["i"])
    return Means(found[0]["n"], [(r["high"] << 32) + r["low"] for r in found])


def combined(rows: DataFrame, start: Callable[[Iterator[np.ndarray]], np.ndarray], join: Callable[[list[np.ndarray]], np.ndarray], dims: int, width: int) -> np.ndarray:
    """A matrix for each task of rows' vectors, and these combined a bounded number at a time until one is left.

    Matrices have `width` columns. Each level is written, so a lost executor costs its own part only.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = start(whole_numbers(b.column(0), dims) for b in batches if b.num_rows)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["task", "m"])

    def matrices(t: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(m, dtype=np.float64).reshape(-1, width) for m in t.sort_by("task")["m"].to_pylist()]

    fan = int(max(2, min(64, COMBINED // (8 * width * width))))

    def merge(t: pa.Table) -> pa.Table:
        return pa.table({"task": pa.array([min(t["task"].to_pylist()) // fan], pa.int64()), "m": pa.array([join(matrices(t)).tobytes()], pa.binary())})

    level = durable(rows.select("v").mapInArrow(each, "task long, m binary"), "matrices")
    while level.count() > 1:
        level = durable(level.groupBy(F.floor(F.col("task") / fan).alias("to")).applyInArrow(merge, "task long, m binary"), "matrices")
    return matrices(level.toArrow())[0]


def triangle(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    """The R of all rows of blocks."""
    r = np.zeros((0, width))
    for b in blocks:
        for at in range(0, len(b), BLOCK):
            r = np.linalg.qr(np.vstack([r, b[at : at + BLOCK]]), mode="r")
    return r


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as columns.

    One-sided: pairs of columns are rotated until all are orthogonal. Pairs come by the circle method: every round has
    each column once, a sweep has every pair once.
    """
    d = r.shape[1]
    a, v = np.array(r, dtype=np.float64), np.eye(d)
    circle = [*range(d), *([-1] if d % 2 else [])]
    for _ in range(sweeps):
        turned = False
        for _ in range(len(circle) - 1):
            half = len(circle) // 2
            p, q = np.array([(i, j) for i, j in zip(circle[:half], circle[half:][::-1], strict=True) if i >= 0 and j >= 0], dtype=np.int64).reshape(-1, 2).T
            alpha, beta, gamma = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0), (a[:, p] * a[:, q]).sum(0)
            turn = np.abs(gamma) > 2 * np.finfo(float).eps * np.sqrt(alpha * beta)
            if turn.any():
                turned = True
                p, q = p[turn], q[turn]
                z = (beta - alpha)[turn] / (2 * gamma[turn])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            circle = [circle[0], circle[-1], *circle[1:-1]]
        if not turned:
            break
    sigma = np.sqrt((a**2).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


@dataclass
class Whitening:
    """What a fit gives: means, components as columns, standard deviations (0: without variance), shares of the variance."""

    means: Means
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray | None

    def of(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of whole numbers; 0 for components without variance."""
        scale = np.divide(1.0, self.deviations, out=np.zeros_like(self.deviations), where=self.deviations > 0)
        return (self.means.centred(x) @ self.components) * scale


def fit(rows: DataFrame, dims: int, most: int = 32) -> Whitening:
    means = exact_means(rows, dims)
    r = combined(rows, lambda xs: triangle((means.centred(x) for x in xs), dims), lambda ms: triangle(iter(ms), dims), dims, dims)
    sigma, v = jacobi(r)
    total = float((sigma**2).sum())
    deviations = np.where(sigma > 1e-12 * max(sigma.max(), 1e-300), sigma, 0.0) / np.sqrt(means.n)
    return Whitening(means, v[:, :most], deviations[:most], (sigma**2 / total)[:most] if total > 0 else None)


def whiten(vectors: DataFrame, column: str = "embedding", most: int = 32) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) by row and component."""
    rows = valid(vectors, column)
    spark, schema = vectors.sparkSession, "component int, deviation long, whitened double, explained double"
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        empty = rows.select("vec_id").limit(0)
        return empty.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in zip(("component", "n", "deviation", "whitened", "explained", "identity_error"), ("int", "long", "long", "double", "double", "double"), strict=True)))
    dims = first["d"]
    model = fit(rows, dims, most)
    k, live = model.components.shape[1], model.deviations > 0

    def products(xs: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((k, k))
        for x in xs:
            w = model.of(x)
            out += w.T @ w
        return out

    covariance = combined(rows, products, lambda ms: np.sum(ms, axis=0), dims, k) / model.means.n
    error = float(np.abs(covariance - np.eye(k))[live][:, live].max()) if live.any() else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = [None] * k if model.explained is None else model.explained.tolist()
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = whole_numbers(b.column(1), dims)
                w = pa.array(model.of(x).ravel(), mask=np.tile(~live, len(x)))
                back = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(back), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(model.means.deviations(x), pa.int64()).take(back), w, pa.array(share * len(x), pa.float64())],
                    names=["vec_id", "component", "deviation", "whitened", "explained"],
                )

    id_type = rows.schema["vec_id"].dataType.simpleString()
    out = rows.select("vec_id", "v").mapInArrow(project, f"vec_id {id_type}, {schema}")
    return out.select("vec_id", "component", F.lit(model.means.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
