"""Embedding whitening: exact covariance in Spark, leading components by FEAST contour integration.

The whitened table needs the leading eigenpairs of one small matrix, the
covariance of the vectors.  Its entries come from Spark: first the sums of
every dimension, then the products of centred entries, both exact whole
numbers.  The eigenpairs are found interval by interval: inertia counts of
shifted factorizations say how many eigenvalues lie above a shift, bisection
cuts the spectrum where gaps allow, and for every interval a quadrature of
complex shifted solves projects a block of vectors onto its eigenspace, where
Rayleigh-Ritz extracts the pairs.  The count found must equal the count by
inertia, so none is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this make the exact sums doubtful; they fail the job.
LARGEST = 1 << 52
#: Eigenvalues at most this share of the largest are rounding: their directions are no components.
RANK_TOLERANCE = 1e-11
#: At most this many eigenvalues in one contour, where the spectrum can be cut.
PER_INTERVAL = 8
#: Quadrature nodes on the upper half of a contour, and refinements of a block.
NODES, ROUNDS = 8, 40
#: A residual, as a share of the matrix, at which a pair may count as found; refinement goes on while it helps.
SETTLED = 1e-12
#: Vectors handled at a time inside a task.
ROWS = 4096


# --- eigenpairs of a small symmetric matrix ---------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: positive pivots of ``matrix - shift`` by Sylvester's law.

    Symmetric elimination with pivots of one or two rows, chosen by size
    (Bunch and Parlett), so the signs are right for indefinite matrices too.
    """
    a = matrix - shift * np.eye(len(matrix))
    alpha, above = (1 + math.sqrt(17)) / 8, 0
    while len(a):
        d = np.abs(np.diag(a))
        r = int(d.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        if d[r] == 0 and off[p, q] == 0:
            break
        if d[r] >= alpha * off[p, q]:
            above += a[r, r] > 0
            rest = np.delete(np.arange(len(a)), r)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, r], a[r, rest]) / a[r, r]
        else:
            pair = [int(p), int(q)]
            block = a[np.ix_(pair, pair)]
            above += 1  # its determinant is negative: one eigenvalue of either sign
            rest = np.delete(np.arange(len(a)), pair)
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, pair)] @ np.linalg.solve(block, a[np.ix_(pair, rest)])
        a = (a + a.T) / 2
    return above


def _feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs with eigenvalues in (low, high], by contour integration."""
    n, centre, radius = len(matrix), (low + high) / 2, (high - low) / 2
    size = min(n, max(count + 4, count * 3 // 2))
    block = np.random.default_rng(seed).standard_normal((n, size))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angles = -math.pi / 2 * (points - 1)
    turns = np.exp(1j * angles)
    scale = max(abs(low), abs(high), np.abs(matrix).max())
    best = None
    for _ in range(ROUNDS):
        # the spectral projector of the interval, applied to the block
        projected = np.zeros((n, size))
        for turn, weight in zip(turns, weights):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(n) - matrix, block.astype(complex))
            projected += weight / 2 * (radius * turn * solved).real
        # Rayleigh-Ritz inside the projected space
        basis, spread, _ = np.linalg.svd(projected, full_matrices=False)
        basis = basis[:, spread > spread[0] * 1e-13]
        values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ inner
        residual = np.abs(matrix @ vectors - vectors * values).max(axis=0) / scale
        inside = np.flatnonzero((values > low) & (values <= high))
        # directions of rounding may have a Ritz value inside too, but no small residual
        inside = np.sort(inside[np.argsort(residual[inside], kind="stable")][:count])
        worst = float(residual[inside].max(initial=0.0)) if len(inside) == count else math.inf
        if worst < SETTLED and best is not None and worst >= best[0] / 2:
            return best[1:]
        if best is None or worst < best[0]:
            best = (worst, values[inside], vectors[:, inside])
        more = np.random.default_rng(seed + 1).standard_normal((n, size - vectors.shape[1]))
        block = np.hstack((vectors, more))
    if best[0] >= SETTLED:
        raise ArithmeticError(f"contour ({low}, {high}] with {count} eigenvalues by inertia does not settle: residual {best[0]}")
    return best[1:]


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above rounding, falling, and their unit vectors as columns.

    The largest entry of a vector is positive.  Fewer than ``k`` come back
    when the rank is less.
    """
    n = len(matrix)
    if n == 0 or k <= 0 or not np.abs(matrix).max() > 0:
        return np.zeros(0), np.zeros((n, 0))
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)  # no eigenvalue is larger
    counts: dict[float, int] = {top: 0}

    def above(x: float) -> int:
        if x not in counts:
            counts[x] = count_above(matrix, x)
        return counts[x]

    # the k-th eigenvalue, or the rounding level, bounds the spectrum from below
    largest_low, largest_high = 0.0, top
    while largest_high - largest_low > 1e-3 * largest_high:
        mid = (largest_low + largest_high) / 2
        largest_low, largest_high = (mid, largest_high) if above(mid) else (largest_low, mid)
    floor = largest_high * RANK_TOLERANCE
    wanted = min(k, above(floor))
    edges = [floor, top]
    while True:  # cut where too many eigenvalues share an interval, down to gaps that rounding leaves
        for low, high in zip(edges, edges[1:]):
            inside = above(low) - above(high)
            mid = math.sqrt(low * high)
            if above(high) < wanted and inside > PER_INTERVAL and high - low > 1e-9 * largest_high and low < mid < high:
                edges = sorted({*edges, mid})
                break
        else:
            break
    values, vectors = [], []
    for i, (low, high) in enumerate(reversed(list(zip(edges, edges[1:])))):
        inside = above(low) - above(high)
        if above(high) >= wanted or not inside:
            continue
        e, v = _feast(matrix, low, high, inside, seed=i)
        values.append(e)
        vectors.append(v)
    e, v = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-e, kind="stable")[:wanted]
    e, v = e[order], v[:, order]
    v, r = np.linalg.qr(v)  # intervals are orthogonal up to rounding; this takes the rounding out
    e = np.einsum("ij,ij->j", v, matrix @ v)
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return e, v


# --- the vectors, in Spark -----------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums ``sums`` per dimension, and their leading components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vector: str) -> Column:
    """Vectors that are not null or empty and hold finite entries only."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def whole(vector: str) -> Column:
    """Entries as whole numbers; one too large for exact sums fails the job."""

    def one(c: Column) -> Column:
        x = F.floor(c.cast("double") * SCALE)
        return F.when(F.abs(c.cast("double")) * SCALE < LARGEST, x + SHIFT).otherwise(F.raise_error(F.lit("vector entry too large to whiten")).cast("long"))

    return F.transform(vector, one)


def _numbers(df: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    out = df.where(usable(vector))
    return out if dim is None else out.where(F.size(vector) == dim)


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest length of usable vectors, the longer of two as common; 0 without vectors."""
    sizes = _numbers(df, vector).groupBy(F.size(vector).alias("dim")).count()
    row = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    return row["dim"] if row else 0


def _matrices(batches: Iterator[pa.RecordBatch], column: str, dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            col = batch.column(column).slice(at, ROWS)
            yield np.asarray(col.flatten()).reshape(len(col), dim)


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of every dimension; one row a task and dimension is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for x in _matrices(batches, "x", dim):
            n += len(x)
            # halves of 26 bits: the sum of neither can overflow
            total += (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(-1, dim), pa.int32()), "s": [str(n), *map(str, total)]})

    parts = rows.mapInArrow(add, "j int, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {r["j"]: int(r["s"]) for r in parts.collect()}
    return got.get(-1, 0), [got.get(j, 0) for j in range(dim)]


def _products(rows: DataFrame, dim: int, centre: list[int]) -> list[list[int]]:
    """Sum of products of entries less ``centre``, exact; upper triangle, one row a task and pair is shuffled."""
    upper = np.triu_indices(dim)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, total = np.array(centre, dtype=np.int64), np.zeros((dim, dim), dtype=object)
        for x in _matrices(batches, "x", dim):
            y = x - shift
            largest = int(np.abs(y).max(initial=0))
            if largest * largest * len(y) < 1 << 53:  # whole numbers that doubles hold exactly
                d = y.astype(np.float64)
                total += (d.T @ d).astype(np.int64)
            else:
                d = y.astype(object)
                total += d.T @ d
        yield pa.RecordBatch.from_pydict({"i": pa.array(upper[0], pa.int32()), "j": pa.array(upper[1], pa.int32()), "s": [str(v) for v in total[upper]]})

    parts = rows.mapInArrow(add, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [[0] * dim for _ in range(dim)]
    for r in parts.collect():  # dim * (dim + 1) / 2 rows, whatever the number of vectors
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = int(r["s"])
    return out


def fit(df: DataFrame, k: int = 32, vector: str = "embedding") -> Whitening:
    """Sums, covariance and the leading ``k`` components of all usable vectors.

    Vectors of another length than the commonest take no part.  Products are
    of entries less the rounded mean, and the rounding is taken out in exact
    fractions, so the covariance has the digits of a double however far the
    entries lie from zero.
    """
    dim = dimension(df, vector)
    if not dim:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    rows = _numbers(df, vector, dim).select(whole(vector).alias("x"))
    n, sums = _sums(rows, dim)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    products = _products(rows, dim, centre)
    exact = [[Fraction(n * products[i][j] - rest[i] * rest[j], n * n) for j in range(dim)] for i in range(dim)]
    matrix = np.array([[float(v) for v in line] for line in exact])
    values, vectors = leading(matrix, k)
    return Whitening(n, sums, values, vectors, float(sum(exact[i][i] for i in range(dim))))


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``(*keep, deviation, whitened)`` of every vector that the fit used: projections over the root of the eigenvalue.

    ``deviation`` is the exact sum over dimensions of ``(n * x - sum) ** 2``;
    one that does not fit a BIGINT fails the job.
    """
    spark, dim = df.sparkSession, len(model.sums)
    kept = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", deviation bigint, whitened array<double>"
    if not dim:
        return spark.createDataFrame([], schema)
    n, sums = model.n, model.sums
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([s - n * c for s, c in zip(sums, centre)], dtype=object)
    weights = model.vectors / np.sqrt(model.values)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, offset = np.array(centre, dtype=np.int64), (rest / n).astype(np.float64) if n else None
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                col = part.column("_x")
                y = np.asarray(col.flatten()).reshape(len(col), dim) - shift
                largest = n * int(np.abs(y).max(initial=0)) + n
                if largest * largest * dim < 1 << 63:
                    off = y * n - rest.astype(np.int64)
                    deviation = (off * off).sum(axis=1)
                else:
                    deviation = ((y.astype(object) * n - rest) ** 2).sum(axis=1)
                    if max(deviation) >= 1 << 63:
                        raise OverflowError("the deviation of a vector does not fit a BIGINT")
                scores = (y - offset) @ weights
                arrays = [part.column(f.name) for f in kept]
                lists = pa.ListArray.from_arrays(np.arange(len(col) + 1, dtype=np.int32) * scores.shape[1], pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(deviation.astype(np.int64)), lists], names=[*(f.name for f in kept), "deviation", "whitened"])

    rows = _numbers(df, vector, dim).select(*[f"`{f.name}`" for f in kept], whole(vector).alias("_x"))
    return rows.mapInArrow(whiten, schema)


def identity_error(whitened: DataFrame, k: int, column: str = "whitened") -> float | None:
    """Largest entry of the covariance of ``column`` less the identity; null without rows or components.

    The columns have mean zero up to rounding; their mean is taken out all the same.
    """
    if not k:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(k), np.zeros((k, k))
        for w in _matrices(batches, column, k):
            n, total, squares = n + len(w), total + w.sum(axis=0), squares + w.T @ w
        whole_part = np.concatenate(([n], total, squares.ravel()))
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(len(whole_part)), pa.int32()), "s": whole_part})

    got = {r["j"]: r["s"] for r in whitened.select(column).mapInArrow(add, "j int, s double").groupBy("j").agg(F.sum("s").alias("s")).collect()}
    flat = np.array([got[j] for j in range(len(got))])
    n, mean = flat[0], flat[1 : k + 1] / flat[0]
    return float(np.abs(flat[k + 1 :].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
