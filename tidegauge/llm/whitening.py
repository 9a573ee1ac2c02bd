"""Whitening of embeddings on the leading eigenvectors of their covariance.

Spark sums up: the counts, sums and centred products of the distinct vectors, in two passes that send the driver one row
per dimension and one per pair of dimensions. The eigenvectors of that one small matrix come from FEAST: a contour around
an interval of the spectrum, the projector on it by quadrature of complex shifted solves, then Rayleigh-Ritz. The intervals
are set between eigenvalues that Sturm counts (the inertia of the shifted matrix) have told apart, one for each group of
close eigenvalues, and the same counts say how many eigenvectors must come out of each, so none can be missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import give_back, pick, run_folder, stored

SCALE = 256
COMPONENTS = 4
NODES = 8  # quadrature points on the upper half of the contour
TURNS = 200  # of the subspace through the filter, at most
APART = 1e-6  # eigenvalues nearer than this share of the largest one share a contour
_LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """What the fit found: n distinct vectors with sums `total`, and per component an eigenvector and its eigenvalue."""

    n: int
    total: tuple[int, ...]
    vectors: np.ndarray  # components x dimensions
    values: np.ndarray
    trace: float
    identity_error: float


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and neighbours of the tridiagonal matrix with the same eigenvalues, by reflections."""
    a = np.array(matrix, dtype=np.float64)
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if not length:
            continue
        v[0] += length if v[0] >= 0 else -length
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, beside: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed `shift`: the positive pivots of the shifted matrix."""
    tiny = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    above, pivot = 0, 1.0
    for n, d in enumerate(diagonal):
        pivot = d - shift - (beside[n - 1] ** 2 / pivot if n else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
    return above


def _bisected(diagonal: np.ndarray, beside: np.ndarray, place: int, low: float, high: float) -> float:
    """The eigenvalue at `place` from the top, counted from 1."""
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if count_above(diagonal, beside, mid) >= place:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def feast(matrix: np.ndarray, low: float, high: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (rows) in (low, high), which holds `wanted` of them.

    ArithmeticError if the contour doesn't yield that many to double precision.
    """
    size = len(matrix)
    centre, radius = (low + high) / 2, (high - low) / 2
    places, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - places)
    turned = np.exp(1j * angles)
    basis = np.random.Generator(np.random.PCG64(7)).standard_normal((size, min(size, wanted + wanted // 2 + 2)))
    bound = 64 * np.finfo(np.float64).eps * np.abs(matrix).sum(axis=1).max()
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(TURNS):
        projected = np.zeros_like(basis)
        for weight, turn in zip(weights, turned):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(size) - matrix, basis.astype(complex))
            projected += weight / 2 * radius * (turn * solved).real
        q, _ = np.linalg.qr(projected)
        values, mixed = np.linalg.eigh(q.T @ matrix @ q)
        basis = q @ mixed
        inside = np.flatnonzero((values > low) & (values < high))[::-1]
        if len(inside) != wanted:
            continue
        found, vectors = values[inside], basis[:, inside]
        off = float(np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max())
        if best is not None and off >= best[0] and best[0] <= bound:
            break  # as near as double precision gets
        if best is None or off < best[0]:
            best = off, found, vectors.T
    if best is None or best[0] > 1e4 * bound:
        raise ArithmeticError(f"the contour ({low}, {high}) did not give its {wanted} eigenvectors")
    return best[1], best[2]


def leading(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their eigenvectors (rows): `components`, or as many as are not zero."""
    size = len(matrix)
    if not size or not np.any(matrix):
        return np.zeros(0), np.zeros((0, size))
    diagonal, beside = tridiagonal(matrix)
    reach = np.abs(matrix).sum(axis=1).max()
    floor = size * np.finfo(np.float64).eps * reach
    wanted = min(components, count_above(diagonal, beside, floor))
    if not wanted:
        return np.zeros(0), np.zeros((0, size))
    value = lambda place: _bisected(diagonal, beside, place, -reach, reach * (1 + 1e-12))
    places = [value(n) for n in range(1, wanted + 1)]
    while wanted < size and places[-1] - (below := value(wanted + 1)) <= APART * places[0]:
        places.append(below)  # no contour fits between these two
        wanted += 1
    bottom = value(wanted + 1) if wanted < size else places[-1] - reach
    groups = [[places[0]]]
    for place in places[1:]:
        if groups[-1][-1] - place <= APART * places[0]:
            groups[-1].append(place)
        else:
            groups.append([place])
    found = []
    for n, group in enumerate(groups):
        over = groups[n - 1][-1] if n else group[0] + reach
        under = groups[n + 1][0] if n + 1 < len(groups) else bottom
        margin = min(over - group[0], group[-1] - under) / 2
        low, high = group[-1] - margin, group[0] + margin
        if count_above(diagonal, beside, low) - count_above(diagonal, beside, high) != len(group):
            raise ArithmeticError(f"the inertia counts disagree about the interval ({low}, {high})")
        found.append(feast(matrix, low, high, len(group)))
    values, vectors = np.concatenate([v for v, _ in found]), np.concatenate([v for _, v in found])
    return values[:components], vectors[:components]


def _whole(vector: str, scale: int) -> Column:
    return F.transform(pick(vector).cast("array<double>"), lambda c: F.floor(c * scale))


def finite_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector and no null or non-finite entry in it."""
    entries = pick(vector).cast("array<double>")
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.filter(pick(vector).isNotNull() & good)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, [0] * size
        for batch in batches:
            x = _matrix(batch.column(0), size)
            count += len(x)
            # halves, so that no sum of longs overflows
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([
            pa.array(range(size), pa.int32()), pa.array([count] * size, pa.int64()),
            pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
        ], names=["i", "n", "total"])

    return add_up


def _products(mean: np.ndarray, project: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of products of the centred entries, or of their projections."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(mean) if project is None else len(project)
        sums = np.zeros((size, size))
        for batch in batches:
            y = _matrix(batch.column(0), len(mean)) - mean
            if project is not None:
                y = y @ project.T
            sums += y.T @ y
        i, j = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(sums.ravel())],
            names=["i", "j", "v"],
        )

    return add_up


def _covariance(fit: DataFrame, n: int, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    size = len(mean) if project is None else len(project)
    out = np.zeros((size, size))
    parts = fit.mapInArrow(_products(mean, project), "i int, j int, v double")
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"] / n
    return (out + out.T) / 2


def fit_whitening(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of a table (x array<bigint>, each of `size` entries); None where there are none.

    The driver gets `size` sums and size * size products, whatever the number of rows.
    """
    fit = stored(vectors.select("x").distinct(), run_folder(vectors.sparkSession) + "/fit")
    sums = fit.mapInArrow(_sums(size), "i int, n long, total decimal(38,0)")
    found = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").collect()
    if not found or not found[0]["n"]:
        return None
    n, total = found[0]["n"], tuple(int(r["total"]) for r in found)
    mean = np.array([t / n for t in total])
    covariance = _covariance(fit, n, mean)
    values, axes = leading(covariance, components)
    if not len(values):
        return Whitening(n, total, axes, values, float(np.trace(covariance)), 0.0)
    seen = _covariance(fit, n, mean, axes / np.sqrt(values)[:, None])
    error = float(np.abs(seen - np.eye(len(values))).max())
    return Whitening(n, total, axes, values, float(np.trace(covariance)), error)


def _deviations(x: np.ndarray, n: int, total: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n * x - total)**2, exactly; null where no long can hold it."""
    if not len(x):
        return []
    most = n * int(max(-int(x.min()), int(x.max()))) + max(map(abs, total))
    if len(total) * most * most < _LONG:
        y = x * n - np.array(total, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * n - np.array(total, dtype=object)
    return [v if v < _LONG else None for v in (y * y).sum(axis=1)]


def _whitened(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    mean = np.array([t / model.n for t in model.total])
    project = model.vectors / np.sqrt(model.values)[:, None]
    k = len(model.values)
    share = np.array([v / model.trace for v in model.values])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(mean))
            rows = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, model.n), pa.int64()),
                pa.array([d for d in _deviations(x, model.n, model.total) for _ in range(k)], pa.int64()),
                pa.array(((x - mean) @ project.T).ravel()),
                pa.array(np.tile(share, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        give_back()

    return score


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """vec_id, component (1 for the largest eigenvalue), n, deviation, whitened, explained, identity_error.

    One row for each vector and component. Entries count as floor(scale * entry); the fit sees each distinct vector once.
    Rows with a null vector or a null, NaN or infinite entry are dropped. All vectors need the same length: those of another
    length than the commonest (of equally common ones the longest) are dropped. Rows repeated, or without an id, are scored
    like any other. There are as many components as the covariance has eigenvalues above rounding, `components` at most; so
    an empty table, a single distinct vector or empty vectors give no rows. `deviation` is null where it exceeds a long.
    Other columns are not read.
    """
    rows = finite_vectors(df, vector).select(pick(vec_id).alias("vec_id"), _whole(vector, scale).alias("x"))
    kind = df.select(pick(vec_id).alias("vec_id")).schema["vec_id"].dataType.simpleString()
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = lengths["size"] if lengths else 0
    rows = rows.filter(F.size("x") == size)
    model = fit_whitening(rows, size, components) if size else None
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, {WHITENED}")
    return rows.mapInArrow(_whitened(model), f"vec_id {kind}, {WHITENED}")
