"""Embedding whitening (operator 12): principal components by FEAST contour integration.

Whole numbers first: an entry c becomes x = floor(64 c) + 1000000, so sums are exact and do not depend on the order of the rows.
Two passes over the vectors make the covariance: the sums give a whole-number centre near the mean, and the
products of the centred values are summed exactly; what the centre misses of the mean is taken off in whole numbers
too. Each task adds up its rows and hands on one partial per cell, Spark adds the partials, and only d sums and d (d + 1) / 2
products of d-dimensional vectors reach the driver, however many rows there are.

On the driver, FEAST works on that d x d matrix A (the "components", ``leading_components``):

- Inertia. A symmetric factorisation L D L^T of A - s I has as many negative eigenvalues in D as A has below s. Bisection
  on s by these counts cuts the upper spectrum into intervals of at most ``INTERVAL`` eigenvalues each (more only where they are
  closer than ``GAP``).
- Contour. For an interval, the spectral projector is the integral of (z I - A)^-1 / (2 pi i) over a circle around it. Gauss-Legendre nodes
  on the upper half circle give its quadrature: a few complex shifted solves on a block of start vectors, of which the real part is taken.
- Rayleigh-Ritz in the span of the result gives approximate eigenpairs, which start the next round until residuals are at rounding level.
- Verification. The pairs found inside an interval must be as many as its inertia counts say; a block that fell short grows.

Last, one Rayleigh-Ritz step over all components found makes them orthogonal across intervals. The rows are then centred, projected and
scaled in one pass; the covariance of the whitened rows is measured by one more.

Vectors that are NULL or hold NULL or non-finite entries, or an entry whose x does not fit a long, take no part, nor do vectors of another
length than the most common one (ties: the longer). Repeated rows count each; NULL ids are carried through. Components whose variance
is not above rounding (2^-33 of the largest) have no whitened value and are left out, so there are fewer than asked for
where the vectors span less; an empty table, or one whose vectors are all equal, gives no rows. Equal eigenvalues: any orthonormal
basis of their space, the same for all rows. ``deviation`` is exact and NULL where it exceeds a long. Only the id and the vector are read, so
further columns of any name do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

SCALE, SHIFT = 64, 1_000_000  # of the contract
NODES = 8  # quadrature nodes on the half circle
INTERVAL = 8  # eigenvalues of one contour
GAP = 1e-9  # of the width of the spectrum, between the end of an interval and the nearest eigenvalue
CUTS = (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9)  # where an interval is tried to be cut
ROUNDS = 40  # contour rounds of an interval before its block grows
MIN_VARIANCE = 2.0**-33  # of the largest eigenvalue; below, rounding would show in the scaled values
BLOCK = 8192  # rows multiplied at once


# ---- eigenvalues of a symmetric matrix ------------------------------------------------------------------------------------


def count_below(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``a`` below ``shift``: negative ones of D in a factorisation L D L^T of a - shift I with pivots of size one or two,
    the largest left on or off the diagonal."""
    m = a - shift * np.eye(len(a))
    negative, ratio = 0, (1 + math.sqrt(17)) / 8
    while len(m):
        size = np.abs(m)
        on = int(np.argmax(np.diagonal(size)))
        i, j = divmod(int(np.argmax(size - np.diag(np.diagonal(size)))), len(m))
        if size[on, on] == 0 and size[i, j] == 0:
            return negative
        pivot = [on] if size[on, on] >= ratio * size[i, j] else [i, j]
        d = m[np.ix_(pivot, pivot)]
        if len(pivot) == 1:
            negative += int(d[0, 0] < 0)
        else:
            det, trace = d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0], d[0, 0] + d[1, 1]
            negative += 1 if det < 0 else 2 * int(trace < 0)
        rest = np.setdiff1d(np.arange(len(m)), pivot)
        side = m[np.ix_(rest, pivot)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(d, side.T)
        m = (m + m.T) / 2
    return negative


def cut_spectrum(a: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, number of eigenvalues) of at most ``INTERVAL`` eigenvalues that hold at least the k largest.

    No end lies within ``GAP`` of the width of the spectrum of an eigenvalue: the counts on both sides of it agree. Eigenvalues too close
    together for such a cut stay in one interval, however many they are."""
    d = len(a)
    radius = np.abs(a).sum(1) - np.abs(np.diagonal(a))
    low, high = float((np.diagonal(a) - radius).min()), float((np.diagonal(a) + radius).max())
    width = max(high - low, abs(high), abs(low), np.finfo(float).tiny)
    low, high, gap = low - 1e-3 * width, high + 1e-3 * width, GAP * width
    out: list[tuple[float, float, int]] = []
    todo = [(low, high, 0, d)]  # from the top; with the counts of eigenvalues below both ends
    found = 0
    while todo and found < k:
        lo, hi, below_lo, below_hi = todo.pop()
        n = below_hi - below_lo
        if n == 0:
            continue
        if n > INTERVAL:
            for share in CUTS:
                mid = lo + share * (hi - lo)
                if lo + 2 * gap < mid < hi - 2 * gap and (below := count_below(a, mid - gap)) == count_below(a, mid + gap):
                    todo += [(lo, mid, below_lo, below), (mid, hi, below, below_hi)]
                    break
            else:
                out.append((lo, hi, n))
                found += n
            continue
        out.append((lo, hi, n))
        found += n
    return out


def contour_pairs(a: np.ndarray, low: float, high: float, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The n eigenpairs of ``a`` between two shifts by FEAST."""
    d = len(a)
    centre, radius = (low + high) / 2, (high - low) / 2
    node, weight = np.polynomial.legendre.leggauss(NODES)
    angle = math.pi / 2 * (1 - node)  # 0..pi: the upper half of the circle, the lower one is its conjugate
    shifts = centre + radius * np.exp(1j * angle)
    solvers = [np.linalg.inv(z * np.eye(d) - a) for z in shifts]
    block = min(d, n + max(4, n // 2))
    y = rng.standard_normal((d, block))
    scale = max(float(np.abs(a).max()), np.finfo(float).tiny)
    best = math.inf
    stalled = 0
    for step in range(ROUNDS * 3):
        q = sum((w * radius / 2) * (np.exp(1j * t) * (s @ y)).real for w, t, s in zip(weight, angle, solvers, strict=True))
        q, _ = np.linalg.qr(q)
        values, small = np.linalg.eigh(q.T @ a @ q)
        x = q @ small
        inside = np.flatnonzero((values > low) & (values <= high))
        residual = np.abs(a @ x - x * values).max(0)
        worst = float(residual[inside].max(initial=0.0))
        if len(inside) == n and worst <= 1e-15 * d * scale:
            return values[inside], x[:, inside]
        stalled = 0 if worst < best / 2 else stalled + 1
        best = min(best, worst)
        if len(inside) == n and stalled >= 3 and worst <= 1e-12 * d * scale:
            return values[inside], x[:, inside]
        y = x
        if (step + 1) % 4 == 0 and block < d:  # fell short so far: more directions
            grow = min(d - block, max(4, n // 2))
            y, block = np.hstack([x, rng.standard_normal((d, grow))]), block + grow
    raise ArithmeticError(f"{len(inside)} of {n} eigenvalues between {low} and {high} with residual {worst}")


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    rng = np.random.default_rng(0)
    parts = [contour_pairs(a, low, high, n, rng) for low, high, n in cut_spectrum(a, min(k, len(a)))]
    if not parts:
        return np.zeros(0), np.zeros((len(a), 0))
    basis, _ = np.linalg.qr(np.hstack([x for _, x in parts]))
    values, small = np.linalg.eigh(basis.T @ a @ basis)
    order = np.argsort(values)[::-1][:k]
    vectors = basis @ small[:, order]
    return values[order], vectors


# ---- moments ------------------------------------------------------------------------------------------------------------------


def scaled(batch: pa.RecordBatch, dims: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and whole-number vectors of the rows of a batch that take part."""
    vectors = batch.column("vector")
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(rows)).flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    c = np.floor(SCALE * pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))
    good = np.isfinite(c).all(1) & (np.abs(c) < 2.0**62).all(1) & ~missing.reshape(-1, dims).any(1)
    return batch.column("vec_id").take(pa.array(rows[good])), c[good].astype(np.int64) + SHIFT


def _gram(y: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows, as Python integers where doubles could not hold the sums."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i in range(0, len(y), BLOCK):
        part = y[i : i + BLOCK]
        top = int(np.abs(part).max(initial=0))
        if top * top * len(part) < 2**53:
            z = part.astype(np.float64)
            total += (z.T @ z).astype(np.int64)
        else:
            z = part.astype(object)
            total += z.T @ z
    return total


def _cells(batches, dims: int, sums) -> pa.RecordBatch:
    """One partial per cell of the arrays that ``sums`` gives for the rows of a task, added up over its batches."""
    total = None
    for batch in batches:
        _, x = scaled(batch, dims)
        if len(x):
            part = sums(x)
            total = part if total is None else total + part
    flat = [] if total is None else total.ravel().tolist()
    return pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([str(v) for v in flat], pa.string())], ["cell", "value"])


def _added(vectors: DataFrame, dims: int, sums) -> list[int]:
    """Whole-number cells added up over all rows: partials per task, then a shuffle by cell; one row per cell reaches the driver."""

    def run(batches):
        yield _cells(batches, dims, sums)

    parts = vectors.mapInArrow(run, "cell int, value string")
    rows = parts.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()
    return [int(r["value"]) for r in sorted(rows, key=lambda r: r["cell"])]


def covariance(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows n, whole-number sums S and the covariance with divisor n, rounded once from its exact value."""
    first = _added(vectors, dims, lambda x: np.append(np.array([int(v) for v in x.astype(object).sum(0)], object), len(x)))
    if not first:
        return 0, np.zeros(dims, object), np.zeros((dims, dims))
    n, s = first[-1], np.array(first[:-1], object)
    centre = np.array([int(v) // n for v in s], np.int64)
    upper = np.triu_indices(dims)
    cells = _added(vectors, dims, lambda x: _gram(x - centre)[upper])
    left = np.array([int(v) - n * int(c) for v, c in zip(s, centre, strict=True)], object)
    v = np.zeros((dims, dims))
    v[upper] = [int(g * n - left[i] * left[j]) / (n * n) for g, i, j in zip(cells, *upper, strict=True)]
    return n, s, v + np.triu(v, 1).T


def common_length(vectors: DataFrame) -> int:
    """The most common length of the vectors (ties: the longer), 0 without vectors."""
    counts = vectors.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return int(top[0]["d"]) if top else 0


# ---- the operator ---------------------------------------------------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 per row, exact; None beyond a long."""
    far = max((max(abs(n * int(hi) - int(t)), abs(n * int(lo) - int(t))) for hi, lo, t in zip(x.max(0), x.min(0), s, strict=True)), default=0)
    if far * far * x.shape[1] < 2**63:
        y = x * np.int64(n) - s.astype(np.int64)
        return (y * y).sum(1).tolist()
    exact = ((x.astype(object) * n - s) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(table: DataFrame, k: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector that takes part: vec_id, n, deviation, whitened (array of up to k values, component 1 first),
    explained (array: share of each component in the total variance) and identity_error."""
    spark = table.sparkSession
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    dims = common_length(vectors)
    n, s, v = covariance(vectors, dims) if dims else (0, np.zeros(0, object), np.zeros((0, 0)))
    values, basis = leading_components(v, k) if n and v.any() else (np.zeros(0), np.zeros((dims, 0)))
    keep = values > MIN_VARIANCE * values.max(initial=0.0)
    values, basis = values[keep], basis[:, keep]
    if not len(values):
        return spark.createDataFrame([], schema)
    explained = (values / np.trace(v)).tolist()
    centre = np.array([int(t) // n for t in s], np.int64)
    rest = np.array([(int(t) - n * int(c)) / n for t, c in zip(s, centre, strict=True)])  # mean = centre + rest
    project = basis / np.sqrt(values)
    m = len(values)

    def rows(batches):
        for batch in batches:
            ids, x = scaled(batch, dims)
            if not len(x):
                continue
            w = ((x - centre) - rest) @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * m, pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(x, n, s), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    def products(batches):
        total, sums, count = np.zeros((m, m)), np.zeros(m), 0
        for batch in batches:
            w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            total, sums, count = total + w.T @ w, sums + w.sum(0), count + len(w)
        flat = np.append(total.ravel(), sums) if count else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["cell", "value"])

    white = save(vectors.mapInArrow(rows, "vec_id long, deviation long, whitened array<double>"), "whitened")
    cells = white.select("whitened").mapInArrow(products, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    flat = np.array([r["value"] for r in sorted(cells, key=lambda r: r["cell"])]) / n
    mean = flat[m * m :]
    error = float(np.abs(flat[: m * m].reshape(m, m) - np.outer(mean, mean) - np.eye(m)).max())
    return white.select(
        "vec_id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.lit(explained).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def by_component(white: DataFrame) -> DataFrame:
    """One row per vector and component of ``whiten``."""
    each = F.posexplode("whitened").alias("_at", "_value")
    rows = white.select("vec_id", "n", "deviation", "explained", "identity_error", each)
    return rows.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("_value").alias("whitened"),
        F.element_at("explained", F.col("_at") + 1).alias("explained"),
        "identity_error",
    )
