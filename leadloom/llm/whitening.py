"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

The fit list is each different vector once, its numbers made whole (``floor(scale * c)``). Counts,
sums and the scatter about a whole-number centre are exact whole numbers, so they are the same
whatever the partitions; the covariance follows from them in whole numbers too and is rounded once.
Its pivoted Cholesky factor L (rows in pivot order, ``V = L L'``) is rotated from the right until
its columns are orthogonal: their squared norms are the eigenvalues, the columns themselves, made
unit, the components. No product of L with itself is ever formed, so small eigenvalues keep their
digits.

The driver holds one matrix for each length of vectors, its size set by that length and not by
the number of rows.

Null vectors, and vectors with null or non-finite numbers or without any, give no rows. Repeated
rows give rows each, but count once in the fit. Vectors of different lengths are whitened each
with their own length's fit. A component without variance (all fitted vectors alike, or fewer of
them than components) has a null ``whitened`` and ``explained`` 0, or null if nothing varies; it
takes no part in ``identity_error``, which is 0 where no component varies. Numbers whose scaled
value, or deviations whose sum, do not fit a long raise an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm import common

SCALE = 256
COMPONENTS = 4
#: Sums of products below this are exact as doubles.
_EXACT = 1 << 53
_SWEEPS = 60


@dataclass(frozen=True)
class Basis:
    """The fit of vectors of one length: components are rows, in falling order of eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x``, the whole numbers, of the usable rows."""
    usable = F.coalesce((F.size("embedding") > 0) & F.forall(
        "embedding", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))), F.lit(False))
    whole: Column = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"),
                                         whole.cast("array<bigint>").alias("x"))


def _matrices(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column as matrices, one for each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        some = column.filter(pa.array(sizes == dim)) if (sizes != dim).any() else column
        yield some.flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dim))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and sums of a task: row -1 counts, row i sums number i. Sums of Python integers."""
    counts: dict[int, int] = defaultdict(int)
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for x in _matrices(b.column("x")):
            dim = x.shape[1]
            counts[dim] += len(x)
            # Two halves of 32 bits: sums of either fit a long for any batch.
            part = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + \
                (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            sums[dim] = part if dim not in sums else sums[dim] + part
    for dim, n in counts.items():
        yield _numbers(dim, [-1, *range(dim)], [0] * (dim + 1), [n, *sums[dim]])


def _numbers(dim: int, i: list[int], j: list[int], values: list[int]) -> pa.RecordBatch:
    from decimal import Decimal

    return pa.RecordBatch.from_arrays(
        [pa.array([dim] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
         pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))],
        ["dim", "i", "j", "value"])


def _scatter(centres: dict[int, tuple[int, ...]]):
    """Sums of products of centred numbers, exact, of a task."""
    def products(y: np.ndarray) -> np.ndarray:
        largest = int(np.abs(y).max(initial=0))
        if largest * largest * len(y) < _EXACT:
            return (y.astype(float).T @ y.astype(float)).astype(np.int64).astype(object)
        y = y.astype(object)
        return y.T @ y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for x in _matrices(b.column("x")):
                dim = x.shape[1]
                centre = np.array(centres[dim], np.int64)
                far = max(int(np.abs(x).max()), int(np.abs(centre).max())) >= 1 << 62
                y = x.astype(object) - centre.astype(object) if far else x - centre
                part = products(y)
                total[dim] = part if dim not in total else total[dim] + part
        for dim, t in total.items():
            i, j = np.triu_indices(dim)
            yield _numbers(dim, i.tolist(), j.tolist(), t[i, j].tolist())

    return run


def _added(parts: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    out: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["dim"]][r["i"], r["j"]] = int(r["value"])
    return out


_NUMBERS = "dim int, i int, j int, value decimal(38, 0)"


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``L`` with ``L @ L.T == v``, a column for each pivot with anything left, largest first."""
    dim = len(v)
    rest, columns = v.astype(float).copy(), []
    least = np.finfo(float).eps * dim * np.abs(np.diag(v)).max(initial=0.0)
    left = np.arange(dim)
    while len(left):
        pivot = left[np.diag(rest)[left].argmax()]
        if rest[pivot, pivot] <= least:
            break
        column = np.zeros(dim)
        column[left] = rest[left, pivot] / np.sqrt(rest[pivot, pivot])
        columns.append(column)
        left = left[left != pivot]
        rest[np.ix_(left, left)] -= np.outer(column[left], column[left])
    return np.stack(columns, axis=1) if columns else np.zeros((dim, 0))


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of ``factor @ factor.T``.

    Rounds of disjoint column pairs, as in a tournament, are rotated at once.
    """
    a = factor.copy()
    n = a.shape[1]
    seats = list(range(n)) + [-1] * (n % 2)
    for _ in range(_SWEEPS):
        worst = 0.0
        for _ in range(max(len(seats) - 1, 0)):
            half = len(seats) // 2
            pairs = [(p, q) for p, q in zip(seats[:half], seats[:half - 1:-1]) if p >= 0 <= q]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            off = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, off.max())
            turn = off > np.finfo(float).eps
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            sign = np.where(zeta >= 0, 1.0, -1.0)
            t = np.where(turn, sign / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            c = 1 / np.hypot(1, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst <= np.finfo(float).eps * max(len(a), 1):
            break
    values = (a * a).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], (a / np.sqrt(values))[:, order]


def fit(vectors: DataFrame) -> dict[int, Basis]:
    """The bases, by length, of a table with a column ``x`` that holds each vector once."""
    first = _added(vectors.select("x").mapInArrow(_sums, _NUMBERS))
    totals = {d: (t[-1, 0], tuple(t[i, 0] for i in range(d))) for d, t in first.items()}
    centres = {d: tuple((2 * s + n) // (2 * n) for s in sums) for d, (n, sums) in totals.items()}
    second = _added(vectors.select("x").mapInArrow(_scatter(centres), _NUMBERS))
    bases = {}
    for dim, (n, sums) in totals.items():
        off = [s - n * c for s, c in zip(sums, centres[dim])]
        v = np.zeros((dim, dim))
        for (i, j), t in second[dim].items():
            v[i, j] = v[j, i] = (n * t - off[i] * off[j]) / (n * n)
        values, components = one_sided_jacobi(pivoted_cholesky(v))
        bases[dim] = Basis(n, sums, values, components.T, float(np.trace(v)))
    return bases


def _project(bases: dict[int, Basis], k: int):
    def deviations(x: np.ndarray, b: Basis) -> list[int]:
        largest = b.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, b.sums))
        kind = np.int64 if largest * largest * x.shape[1] < 1 << 63 else object
        d = x.astype(kind) * b.n - np.array(b.sums, kind)
        return (d * d).sum(axis=1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for x, dim in zip(_matrices(batch.column("x")), np.unique(sizes)):
                b = bases[int(dim)]
                ids = batch.column("vec_id").filter(pa.array(sizes == dim))
                shown, some = min(k, int(dim)), min(k, len(b.values))
                mean = np.array([s / b.n for s in b.sums])
                white = (x - mean) @ b.components[:some].T / np.sqrt(b.values[:some])
                lists = [[*row, *[None] * (shown - some)] for row in white.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(x), dim), pa.int32()),
                     pa.array(deviations(x, b), pa.int64()), pa.array(lists, pa.list_(pa.float64()))],
                    ["vec_id", "dim", "deviation", "whitened"])

    return run


_PROJECTED = "vec_id long, dim int, deviation long, whitened array<double>"


def transform(rows: DataFrame, bases: dict[int, Basis], k: int = COMPONENTS) -> DataFrame:
    """``vec_id, dim, deviation, whitened`` (up to ``k`` numbers) of rows with ``vec_id`` and ``x``."""
    if not bases:
        return rows.sparkSession.createDataFrame([], _PROJECTED)
    return rows.select("vec_id", "x").mapInArrow(_project(bases, k), _PROJECTED)


def identity_errors(fitted: DataFrame, bases: dict[int, Basis], k: int = COMPONENTS) -> dict[int, float]:
    """By length, how far the covariance of the whitened fit list is from the identity."""
    if not bases:
        return {}
    white = transform(fitted.withColumn("vec_id", F.lit(None).cast("long")), bases, k)
    at = [F.get("whitened", F.lit(i)) for i in range(k)]
    spread = {(i, j): F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}")
              for i in range(k) for j in range(i, k)}
    out = {}
    for r in white.groupBy("dim").agg(*spread.values()).collect():
        some = min(k, len(bases[r["dim"]].values))
        out[r["dim"]] = max((abs(r[f"c{i}_{j}"] - (i == j)) for i in range(some)
                             for j in range(i, some)), default=0.0)
    return out


def whitened(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each
    usable row of ``vectors`` (vec_id, embedding) and each of its first ``k`` components."""
    rows = scaled(vectors, scale)
    fitted = common.staged(rows.select("x").distinct(), "fit-list")
    bases = fit(fitted)
    errors = identity_errors(fitted, bases, k)
    out = transform(rows, bases, k)

    def of_length(value, kind: str) -> Column:
        """A value of the length's basis; the lengths are few."""
        c = F.lit(None)
        for dim, b in bases.items():
            c = F.when(F.col("dim") == dim, value(dim, b)).otherwise(c)
        return c.cast(kind)

    def share(dim: int, b: Basis) -> Column:
        parts = [float(v) for v in b.values[:k]] + [0.0] * max(min(k, dim) - len(b.values), 0)
        return F.array(*[F.lit(v / b.trace if b.trace > 0 else None) for v in parts])

    return out.withColumns({
        "n": of_length(lambda d, b: F.lit(b.n), "long"),
        "shares": of_length(share, "array<double>"),
        "identity_error": of_length(lambda d, b: F.lit(errors[d]), "double"),
    }).select("vec_id", "n", "deviation", "identity_error", "shares",
              F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("shares", F.col("at")).alias("explained"), "identity_error")
