"""Operator 12, embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Vectors are quantised to whole numbers and stored packed, about a byte an entry. The fit is made on the distinct ones: exact
sums, then the scatter centred before it is multiplied, both as partial results of tasks. A pivoted Cholesky factor of the
scatter has as many columns as the scatter has rank. Plane rotations make its columns orthogonal; then their squared norms
are the eigenvalues and the columns, normalised, the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import pin

SCALE, SHIFT = 64, 1_000_000
MOST = 1 << 31  #: quantised entries beyond this count as this
TASKS = 1024  #: at most so many tasks make partial scatters, which bounds their exchange
WIDEST = 8192  #: the scatter of a vector's dimensions goes to the driver: 512 MB at this width


def _pack(q: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes, each with the least width of 1, 2, 4 or 8 bytes that holds it, named in its first byte."""
    low, high = q.min(axis=1), q.max(axis=1)
    width = np.full(len(q), 8)
    for w in (4, 2, 1):
        width[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
    out: list[bytes] = [b""] * len(q)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        data, step, head = q[rows].astype(f"<i{w}").tobytes(), w * q.shape[1], bytes([w])
        for k, row in enumerate(rows.tolist()):
            out[row] = head + data[k * step : (k + 1) * step]
    return out


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    if not rows:
        return np.empty((0, dim), np.int64)
    width = np.fromiter((r[0] for r in rows), np.int64, len(rows))
    out = np.empty((len(rows), dim), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        data = b"".join(rows[i][1:] for i in at.tolist())
        out[at] = np.frombuffer(data, f"<i{w}").reshape(len(at), dim)
    return out


def quantise(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, dim, x: the rows whose vector has only finite entries, each entry c as floor(64 * c), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = part.column(1)
                size = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
                flat = lists.flatten()
                numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL entries become NaN
                ends = np.cumsum(size)
                for dim in np.unique(size[size > 0]).tolist():
                    rows = np.flatnonzero(size == dim)
                    c = numbers[(ends[rows] - dim)[:, None] + np.arange(dim)]
                    fine = np.isfinite(c).all(axis=1)
                    rows, c = rows[fine], c[fine]
                    if not len(rows):
                        continue
                    with np.errstate(over="ignore"):
                        q = np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(_pack(q), pa.binary())],
                        names=["vec_id", "dim", "x"],
                    )

    narrow = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return narrow.where(F.col("v").isNotNull()).mapInArrow(run, "vec_id long, dim int, x binary")


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L' = a for a symmetric matrix without negative eigenvalues; as many columns as `a` has rank.

    The largest diagonal entry left is the next pivot; the factor ends where that is rounding error alone.
    """
    a = np.array(a, np.float64)
    d = np.diag(a).copy()
    least = 4 * len(d) * np.finfo(np.float64).eps * d.max(initial=0.0)
    columns: list[np.ndarray] = []
    open_ = np.ones(len(d), bool)
    while open_.any():
        pivot = int(np.argmax(np.where(open_, d, -1.0)))
        if d[pivot] <= least:
            break
        column = a[:, pivot].copy()
        if columns:
            made = np.array(columns)
            column -= made[:, pivot] @ made
        column[~open_] = 0.0
        root = np.sqrt(d[pivot])
        column /= root
        column[pivot] = root
        d -= column * column
        open_[pivot] = False
        columns.append(column)
    return np.array(columns).reshape(len(columns), len(d)).T


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of factor factor' in falling order and its unit eigenvectors as rows, by rotating the factor's columns.

    A sweep meets all pairs of columns once, in rounds of disjoint pairs; it ends when no pair is further from orthogonal than
    rounding.
    """
    w = np.array(factor.T, np.float64)  # columns as rows
    r = len(w)
    if r == 0:
        return np.empty(0), np.empty((0, factor.shape[0]))
    ring = list(range(r + r % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(i, j) for i, j in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]) if max(i, j) < r]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            a, b, g = (w[i] ** 2).sum(1), (w[j] ** 2).sum(1), (w[i] * w[j]).sum(1)
            off = np.abs(g) / np.sqrt(a * b)
            turn = off > 1e-15
            worst = max(worst, float(off.max()))
            i, j, a, b, g = i[turn], j[turn], a[turn], b[turn], g[turn]
            z = (b - a) / (2 * g)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            w[i], w[j] = c[:, None] * w[i] - s[:, None] * w[j], s[:, None] * w[i] + c[:, None] * w[j]
        if worst <= 4e-15:
            break
    norms = (w**2).sum(1)
    order = np.argsort(-norms, kind="stable")
    units = w[order] / np.sqrt(norms[order])[:, None]
    top = units[np.arange(r), np.abs(units).argmax(1)]
    return norms[order], units * np.where(top < 0, -1.0, 1.0)[:, None]


@dataclass(frozen=True)
class Fit:
    """What whitening needs; `sums` are of the quantised entries without their shift."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, q: np.ndarray) -> np.ndarray:
        """Distance from the mean: whole part exactly, then the rest of the mean, which is under 1."""
        whole = self.sums // max(self.n, 1)
        return (q - whole).astype(np.float64) - (self.sums - self.n * whole) / max(self.n, 1)

    def whiten(self, q: np.ndarray) -> np.ndarray:
        return self.centred(q) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviation(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of (n x - S)^2, exact, and where it is beyond a 64-bit number."""
        about = ((self.n * q.astype(np.float64) - self.sums) ** 2).sum(axis=1)
        away = np.int64(self.n) * q - self.sums
        return (away * away).sum(axis=1), about > 9.2e18


def _few(df: DataFrame) -> DataFrame:
    """At most TASKS tasks, by joining input parts without a shuffle."""
    return df.coalesce(TASKS)


def fit(rows: DataFrame, components: int = 16) -> tuple[Fit | None, DataFrame]:
    """The fit on the distinct vectors of the most frequent dimension (the larger of equally frequent ones), and its rows.

    `rows` is a stored table as `quantise` makes it. Vectors of other dimensions are left out. None if there is no vector.
    """
    top = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if top is None:
        return None, rows
    dim = top["dim"]
    if dim > WIDEST:
        raise ValueError(f"vectors of {dim} entries; the scatter of at most {WIDEST} fits on the driver")
    rows = rows.where(F.col("dim") == dim)
    distinct = pin(rows.select("x").distinct())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            q = _unpack(batch.column(0), dim)
            total, n = total + q.sum(axis=0), n + len(q)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    parts = _few(distinct).mapInArrow(sums, "n long, sums array<long>").select("n", F.posexplode("sums").alias("at", "part"))
    per_entry = parts.groupBy("at").agg(F.sum("part").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()
    n, whole = per_entry[0]["n"], np.array([r["total"] for r in per_entry], np.int64)
    empty = Fit(n, whole, np.empty(0), np.empty((0, dim)), 0.0)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                y = empty.centred(_unpack(batch.column(0).slice(at, 8192), dim))
                total += y.T @ y
        cells = pa.ListArray.from_arrays(np.arange(0, dim * dim + 1, dim, dtype=np.int32), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), cells], names=["row", "cells"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(dim)
        for chunk in table.column("cells").chunks:
            total += chunk.flatten().to_numpy().reshape(-1, dim).sum(axis=0)
        return pa.table({"row": table.column("row").slice(0, 1), "cells": pa.array([total], pa.list_(pa.float64()))})

    partial = _few(distinct).mapInArrow(scatter, "row int, cells array<double>")
    table = partial.groupBy("row").applyInArrow(added, "row int, cells array<double>").toArrow().sort_by("row")
    v = np.array(table.column("cells").to_pylist()) / n
    v = (v + v.T) / 2
    values, units = one_sided_jacobi(pivoted_cholesky(v))
    found = Fit(n, whole, values[:components], units[:components], float(np.trace(v)))
    return Fit(n, whole, found.eigenvalues, found.components, found.trace, _identity_error(distinct, found)), rows


def _identity_error(distinct: DataFrame, found: Fit) -> float:
    """Largest entry of the whitened fit list's covariance less the identity; tasks centre their own rows, then add up."""
    dim, k = found.dim, len(found.eigenvalues)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = found.whiten(_unpack(batch.column(0), dim))
            if not len(w):
                continue
            here = w.mean(axis=0)
            step, both = here - mean, n + len(w)
            m += (w - here).T @ (w - here) + np.outer(step, step) * (n * len(w) / both)
            mean, n = mean + step * (len(w) / both), both
        row = [pa.array([n], pa.int64()), *[pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (mean, m)]]
        yield pa.RecordBatch.from_arrays(row, names=["n", "mean", "m"])

    n, mean, m = 0, np.zeros(k), np.zeros((k, k))
    for row in _few(distinct).mapInArrow(moments, "n long, mean array<double>, m array<double>").collect():  # TASKS small rows
        if row["n"]:
            step, both = np.array(row["mean"]) - mean, n + row["n"]
            m += np.array(row["m"]).reshape(k, k) + np.outer(step, step) * (n * row["n"] / both)
            mean, n = mean + step * (row["n"] / both), both
    return float(np.abs(m / max(n, 1) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Dropped: NULL and empty vectors, those with a NULL or non-finite entry, and those of another dimension than the most
    frequent one. There are as many components as the covariance has rank in double precision, `components` at most, so one distinct
    vector gives no rows; neither does an empty table. Repeated rows, NULL and repeated ids are kept as rows and count once in the fit.
    Entries beyond 2^31 / 64 count as that; a deviation beyond 64 bits is NULL. Other columns aren't read.
    """
    stored = pin(quantise(vectors, key, vector))
    found, rows = fit(stored, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    k, dim = len(found.eigenvalues), found.dim
    explained = found.eigenvalues / found.trace
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                q = _unpack(part.column(1), dim)
                deviation, beyond = found.deviation(q)
                m = len(q)
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, found.n, np.int64)),
                    pa.array(np.repeat(deviation, k), mask=np.repeat(beyond, k)),
                    pa.array(found.whiten(q).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, found.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select("vec_id", "x").mapInArrow(run, schema)
