"""Embedding whitening by cyclic Jacobi rotations.

Entries become whole numbers, equal vectors count once, and the centred scatter of
what is left is summed in the tasks.  The driver holds only one matrix for each
length of vector: it applies symmetric Jacobi rotations until every off-diagonal
entry is negligible beside its two diagonal ones, which gives small eigenvalues to
high relative accuracy.  The whitening matrix goes back to the tasks with the map.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, parts

#: An entry c counts as floor(SCALE * c).
SCALE = 256
SWEEPS = 100
_EPS = float(np.finfo(float).eps)
_LONG = 2**63


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows.

    Pairs (p, q) are rotated row by row, again and again, until a sweep finds no
    |a[p, q]| above the rounding error of sqrt(a[p, p] * a[q, q]).  Equal
    eigenvalues keep the order of their place; an eigenvector's largest entry (the
    first of equals) is positive.
    """
    a, d = a.astype(float, copy=True), len(a)
    v = np.eye(d)
    for _ in range(SWEEPS):
        rotated = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                x = a[p, q]
                if x == 0 or abs(x) <= _EPS * math.sqrt(abs(a[p, p])) * math.sqrt(abs(a[q, q])):
                    continue
                rotated = True
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = math.copysign(1, theta) / (abs(theta) + math.hypot(theta, 1))
                c = 1 / math.hypot(t, 1)
                s = t * c
                app, aqq = a[p, p] - t * x, a[q, q] + t * x
                left, right = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q], a[:, p], a[:, q] = left, right, left, right
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0, 0
                v[p], v[q] = c * v[p] - s * v[q], s * v[p] + c * v[q]
        if not rotated:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    vectors = v[order]
    signs = np.sign(vectors[np.arange(d), np.abs(vectors).argmax(1)])
    return values[order], vectors * signs[:, None]


@dataclass
class Fit:
    """What is known of all vectors of one length."""

    n: int
    sums: list[int]
    largest: int
    whole: np.ndarray
    fraction: np.ndarray
    matrix: np.ndarray | None = None
    explained: list[float | None] | None = None
    error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is taken off exactly, where it fits, and then what is left."""
        if self.largest < 2**61:
            return (x - self.whole.astype(np.int64)) - self.fraction
        return (x.astype(float) - self.whole.astype(float)) - self.fraction

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - S)^2; None where a long can't hold it."""
        most = self.n * self.largest + max(map(abs, self.sums))
        if most * most * len(self.sums) < _LONG:
            gap = x * self.n - np.array(self.sums, np.int64)
            return (gap * gap).sum(1).tolist()
        y = self.centred(x) * float(self.n)
        out: list[int | None] = [None] * len(x)
        for i in np.flatnonzero((y * y).sum(1) < _LONG * (1 + 1e-6)).tolist():
            total = sum((self.n * c - s) ** 2 for c, s in zip(x[i].tolist(), self.sums, strict=True))
            out[i] = total if total < _LONG else None
        return out

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.matrix.T


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length in a batch whose last column is the vectors: its rows' places and their matrix."""
    x = batch.column(batch.num_columns - 1)
    sizes = np.asarray(x.value_lengths())
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        own = x if len(at) == len(sizes) else x.take(pa.array(at))
        yield dim, at, own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _moments(fit: DataFrame) -> dict[int, Fit]:
    """Counts, sums and largest entries by length: each task sends one row for each
    dimension, and one row for each is left on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        most: dict[int, list[int]] = {}
        for batch in batches:
            for dim, at, x in _by_length(batch):
                high, low = (x >> 20).sum(0).tolist(), (x & 0xFFFFF).sum(0).tolist()
                n[dim] = n.get(dim, 0) + len(at)
                sums[dim] = [s + (h << 20) + t for s, h, t in zip(sums.get(dim, [0] * dim), high, low, strict=True)]
                largest = np.maximum(x.max(0), -(x.min(0) + 1)).tolist()  # of a negative entry one less, which a long holds
                most[dim] = [max(a, b + 1) for a, b in zip(most.get(dim, [0] * dim), largest, strict=True)]
        for dim in n:
            rows = [[dim] * dim, list(range(dim)), [n[dim]] * dim, [Decimal(s) for s in sums[dim]], [Decimal(m) for m in most[dim]]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["dim", "i", "n", "total", "most"])

    sent = fit.mapInArrow(run, "dim int, i int, n long, total decimal(38,0), most decimal(38,0)")
    found: dict[int, list] = {}
    for r in sent.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most")).collect():
        found.setdefault(r["dim"], []).append((r["i"], r["n"], int(r["total"]), int(r["most"])))
    fits = {}
    for dim, rows in found.items():
        rows.sort()
        n, sums = rows[0][1], [r[2] for r in rows]
        fits[dim] = Fit(n, sums, max(r[3] for r in rows), np.array([s // n for s in sums], object), np.array([s % n / n for s in sums]))
    return fits


def _scatter(fit: DataFrame, rows_of: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each length the sum of y' y over the rows y that rows_of makes of its
    vectors; a task sends its upper triangle once, and as many tasks read as the
    session has shuffle partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_length(batch):
                y = rows_of(dim, x)
                held[dim] = held[dim] + y.T @ y if dim in held else y.T @ y
        for dim, total in held.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["dim", "i", "j", "v"])

    spark = fit.sparkSession
    sent = fit.coalesce(parts(spark)).mapInArrow(run, "dim int, i int, j int, v double")
    entries: dict[int, list] = {}
    for r in sent.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        entries.setdefault(r["dim"], []).append((r["i"], r["j"], r["v"]))
    out = {}
    for dim, rows in entries.items():
        size = max(r[1] for r in rows) + 1
        out[dim] = np.zeros((size, size))
        for i, j, v in rows:
            out[dim][i, j] = out[dim][j, i] = v
    return out


def fit_whitening(vectors: DataFrame, components: int = 4) -> dict[int, Fit]:
    """A fit for each length of the vectors in the column ``x`` (of longs), each
    distinct vector once.  A component is empty (a row of NaN) where the variance
    along it is nothing but rounding error."""
    once = cut(vectors.select("x").distinct())
    fits = _moments(once)
    for dim, total in _scatter(once, lambda dim, x: fits[dim].centred(x)).items():
        fit = fits[dim]
        values, own = jacobi(total / fit.n)
        trace, values, own = float(np.trace(total / fit.n)), values[:components], own[:components]
        real = values > dim * _EPS * max(float(values[0]), 0.0)
        fit.matrix = np.where(real[:, None], own / np.sqrt(np.where(real, values, 1))[:, None], np.nan)
        fit.explained = [max(float(e), 0.0) / trace if trace > 0 else None for e in values]
    for dim, total in _scatter(once, lambda dim, x: np.nan_to_num(fits[dim].whitened(x))).items():
        real = ~np.isnan(fits[dim].matrix[:, 0])
        gap = (total / fits[dim].n - np.eye(len(total)))[np.ix_(real, real)]
        fits[dim].error = float(np.abs(gap).max()) if real.any() else None
    return fits


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for
    each row and each of the first ``components`` components.

    Rows whose vector is null or holds null, NaN or infinite entries are left out.
    Vectors of each length are fitted on their own; an empty vector has no
    component and so no row, one of fewer entries than ``components`` has that many.
    Repeated rows each have their rows; a null id stays null.  A component without
    variance has a null ``whitened`` (all, if the vectors are all equal, and then
    ``explained`` and ``identity_error`` are null too).  ``deviation`` is null where
    a long can't hold it.  Entries beyond the range of a long count as its ends.
    An empty table gives an empty result; other columns are ignored.
    """
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = good.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))))
    rows = good.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    fits = fit_whitening(rows, components)
    kinds = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_length(batch):
                fit = fits[dim]
                k, m = len(fit.matrix), len(at)
                w = fit.whitened(x).ravel()
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                columns = [ids, np.tile(np.arange(1, k + 1), m), np.full(m * k, fit.n), np.repeat(np.array(fit.deviation(x), object), k), pa.array(w, mask=np.isnan(w)), fit.explained * m, [fit.error] * (m * k)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind.type) for c, kind in zip(columns, kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
