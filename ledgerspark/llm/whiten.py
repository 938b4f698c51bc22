"""Embedding whitening by FEAST contour integration.

The components are eigenvectors of the covariance of all vectors. FEAST finds those with eigenvalues in an interval: the
resolvent ``(zI - V)^-1`` is applied to a block of vectors at the nodes of a Gauss-Legendre quadrature on a circle through the ends
of the interval, complex symmetric solves whose weighted sum projects the block onto the wanted eigenspace; a Rayleigh-Ritz step
in that subspace gives eigenpairs, and the step is repeated until the residuals are at rounding level. Intervals are found
by bisection on the inertia of ``V - sI``, the number of eigenvalues below ``s``, counted on a tridiagonal form of V; the same
count then proves that each interval gave all of its eigenvalues, else the block is enlarged and drawn again.

The vectors stay in Spark. Three passes read them: sums and numbers of rows; products of the centred vectors; covariance of the
whitened vectors, which is the reported error. Each task adds up its own rows and emits one row per dimension, and these partial sums are
reduced by dimension. Only sums of the size of the covariance (dimensions squared) come to the driver, where the
eigenproblem, as small as they, is solved. Entries are whole numbers, so sums are exact: centring subtracts the
rounded mean, a whole number, and the rest of the mean, below one half, is taken off the summed products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
MAX_DIMENSIONS = 4096  # the covariance is solved on the driver: at most 128 MB
INTERVAL = 8  # eigenvalues in one contour, at most, where they are told apart
NODES = 12  # of the quadrature on the upper half of a contour
RATIO = 16  # of the ends of an interval
LEAST = 1e-11  # of the largest eigenvalue: components below are rounding, and cannot be scaled to unit variance
PIECE = 4096  # vectors handled at once


# ---- the eigenproblem -------------------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the eigenvalues of the symmetric ``v`` (Householder)."""
    a = np.array(v, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def below(form: tuple[np.ndarray, np.ndarray], s: float) -> int:
    """Inertia: the number of eigenvalues below ``s``, as negative pivots of the shifted tridiagonal matrix."""
    diagonal, squares = form
    tiny = np.finfo(float).tiny ** 0.5
    negative, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - s - (squares[i - 1] / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        negative += pivot < 0
    return negative


def intervals(form: tuple[np.ndarray, np.ndarray], low: float, high: float, size: int = INTERVAL) -> list[tuple[float, float, int]]:
    """Intervals between ``low`` and ``high``, both above 0, with their numbers of eigenvalues, from the top; at most ``size`` in each.

    The ends of one are of like magnitude, so that eigenvalues much smaller than a contour do not crowd at its end.
    An interval that holds more but has become as narrow as rounding is left whole: its eigenvalues are one multiple one.
    Ends are moved into wide gaps: of several cuts near the middle, the one is taken that is farthest from an eigenvalue.
    """
    wanted, done = [(low, high)], []
    while wanted:
        a, b = wanted.pop()
        n = below(form, b) - below(form, a)
        if n == 0:
            continue
        if n <= size and b <= RATIO * a or b - a < 1e-11 * min(b, high):
            done.append((a, b, n))
            continue
        middle = np.linspace(0.3, 0.7, 17)
        cuts = a * (b / a) ** middle if b > 2 * a else a + (b - a) * middle
        counts = [below(form, c) for c in cuts]
        # the longest run of cuts with one count lies in the widest gap
        runs, start = [], 0
        for i in range(1, len(cuts) + 1):
            if i == len(cuts) or counts[i] != counts[start]:
                runs.append((i - start, (cuts[start] + cuts[i - 1]) / 2))
                start = i
        cut = max(runs)[1]
        wanted += [(a, cut), (cut, b)]
    return sorted(done, reverse=True)


def _edge(form: tuple[np.ndarray, np.ndarray], s: float, bound: float) -> float:
    """The eigenvalue next to ``s`` on the way to ``bound``, by bisection on the inertia; ``bound`` if there is none."""
    start, near, far = below(form, s), s, bound
    if below(form, far) == start:
        return bound
    for _ in range(60):
        half = (near + far) / 2
        near, far = (half, far) if below(form, half) == start else (near, half)
    return far


def in_gap(form: tuple[np.ndarray, np.ndarray], s: float, low: float, high: float) -> float:
    """A place with the inertia of ``s``, half way between the eigenvalues next to it."""
    middle = (_edge(form, s, low) + _edge(form, s, high)) / 2
    return middle if below(form, middle) == below(form, s) else s


def contour(v: np.ndarray, a: float, b: float, block: np.ndarray) -> np.ndarray:
    """The block filtered by the quadrature of the resolvent on the circle through ``a`` and ``b``."""
    middle, radius = (a + b) / 2, (b - a) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(block)
    identity = np.eye(len(v))
    for x, w in zip(nodes, weights):
        turn = np.exp(1j * np.pi / 2 * (1 + x))  # the upper half; the lower one is its conjugate
        out += (w / 2 * radius * (turn * np.linalg.solve((middle + radius * turn) * identity - v, block))).real
    return out


def feast(v: np.ndarray, a: float, b: float, expected: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in [a, b) by falling size, and their vectors as columns; ``expected`` of them, as the inertia says."""
    n, scale = len(v), max(float(np.abs(v).max()), np.finfo(float).tiny)
    for attempt in range(8):
        rng = np.random.default_rng(seed + attempt)
        size = min(n, expected + max(4, expected // 2) * (attempt + 1))
        block = np.linalg.qr(rng.standard_normal((n, size)))[0]
        before = np.inf
        for _ in range(30):
            basis = np.linalg.qr(contour(v, a, b, block))[0]
            values, turns = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ turns
            inside = (values >= a) & (values < b)
            residual = np.abs(v @ block[:, inside] - block[:, inside] * values[inside]).max(initial=0.0) / scale
            if inside.sum() == expected and (residual < 4e-16 or residual >= before / 4 and residual < 1e-13):
                order = np.flatnonzero(inside)[::-1]
                return values[order], block[:, order]
            before = residual
    raise ArithmeticError(f"the contour [{a}, {b}) did not give the {expected} eigenvalues that its inertia counts")


def largest_components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a covariance, by falling size, and unit vectors as columns; those at rounding level are left out."""
    v = (v + v.T) / 2
    top = float(np.abs(v).sum(1).max()) * (1 + 1e-9) if len(v) else 0.0  # no eigenvalue is larger than the largest row sum
    if not top > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    form = tridiagonal(v)
    peak = top  # the largest eigenvalue, from above, by bisection on the inertia
    least = 0.0
    for _ in range(60):
        half = (least + peak) / 2
        least, peak = (half, peak) if below(form, half) < len(v) else (least, half)
    floor = peak * LEAST
    ends, found, columns = intervals(form, floor, peak * (1 + 1e-9)), [], []
    for a, b, n in ends:
        if sum(map(len, found)) >= count:
            break
        # an end close to an eigenvalue outside would let that one into the contour by half
        values, vectors = feast(v, in_gap(form, a, -peak, 2 * peak), in_gap(form, b, -peak, 2 * peak), n)
        found.append(values)
        columns.append(vectors)
    values = np.concatenate([np.zeros(0), *found])
    vectors = np.concatenate([np.zeros((len(v), 0)), *columns], axis=1)
    if len(values) < min(count, len(v) - below(form, floor)):
        raise ArithmeticError("fewer eigenvalues than the inertia counts")
    # vectors of neighbouring intervals are orthogonal but for rounding; one QR step with the signs kept takes that away
    q, r = np.linalg.qr(vectors)
    vectors = q * np.sign(np.where(np.diag(r) == 0, 1, np.diag(r)))
    return values[:count], vectors[:, :count]


# ---- the vectors in Spark -----------------------------------------------------------------------


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray]]:
    """Ids and whole-number entries of the usable vectors of a batch, grouped by their number of entries."""
    for at in range(0, batch.num_rows, PIECE):
        piece = batch.slice(at, PIECE)
        ids, lists = piece.column(0), piece.column(1)
        lengths = np.asarray(lists.value_lengths().fill_null(-1))
        flat = lists.flatten()  # without the entries of null lists
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
        starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        fine = (lengths > 0) & (bad[starts + np.maximum(lengths, 0)] == bad[starts])
        for d in np.unique(lengths[fine]):
            rows = np.flatnonzero(fine & (lengths == d))
            x = np.floor(SCALE * values[starts[rows][:, None] + np.arange(d)])
            if np.abs(x).max() >= 2**62:
                raise OverflowError("an entry times 64 does not fit a long")
            yield ids.take(pa.array(rows)), x.astype(np.int64) + SHIFT


def _summed(vectors: DataFrame, add: Callable, schema: str) -> DataFrame:
    """One pass over the vectors: ``add(x, held)`` folds pieces into a dict of arrays, and each task emits (key, place, values)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for _, x in _pieces(batch):
                add(x, held)
        for (key, place), values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([place], pa.int64()), pa.array([values.tolist()])], ["d", "place", "v"])

    return vectors.mapInArrow(work, schema)


def _reduced(parts: DataFrame, schema: str) -> dict[tuple[int, int], np.ndarray]:
    """Partial sums added up by (key, place): in tasks that each take some places, streamed, then a row per place to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key, place, values in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.array(values)
                old = held.get((key, place))
                held[key, place] = values if old is None else old + values
        for (key, place), values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([place], pa.int64()), pa.array([values.tolist()])], ["d", "place", "v"])

    rows = parts.repartition("d", "place").mapInArrow(work, schema).collect()
    return {(r.d, r.place): np.array(r.v) for r in rows}


WHOLE, REAL = "d long, place long, v array<long>", "d long, place long, v array<double>"


def _count_and_sum(x: np.ndarray, held: dict) -> None:
    new = np.append(x.sum(0), len(x))
    key = (x.shape[1], 0)
    held[key] = held[key] + new if key in held else new


def _products(y: np.ndarray, held: dict) -> None:
    """Adds the products of centred rows, row by row of the matrix; whole numbers below 2**53 stay exact."""
    d = y.shape[1]
    product = y.T @ y
    for i in range(d):
        held[d, i] = held[d, i] + product[i] if (d, i) in held else product[i]


@dataclass(frozen=True)
class Whitening:
    """What is fitted to all vectors."""

    n: int
    sums: np.ndarray  # per dimension
    covariance: np.ndarray
    values: np.ndarray  # eigenvalues of the components, falling
    vectors: np.ndarray  # components as columns

    @property
    def centre(self) -> np.ndarray:
        """Rounded means; the rest of each mean is ``sums / n - centre``."""
        return (2 * self.sums + self.n) // (2 * self.n)

    def rest(self) -> np.ndarray:
        return (self.sums - self.n * self.centre) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows: centred exactly but for the last division, projected, and scaled."""
        return ((x - self.centre) - self.rest()) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """Means, covariance and components of all usable vectors (columns: id, vector); None if there is none.

    All vectors have the same number of entries; if a table mixes several, the most frequent number counts (the larger one of
    equally frequent ones) and vectors of other lengths are left out.
    """
    counted = _reduced(_summed(vectors, _count_and_sum, WHOLE), WHOLE)
    if not counted:
        return None
    d = max(counted, key=lambda k: (counted[k][-1], k[0]))[0]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MAX_DIMENSIONS} are solved on the driver")
    n, sums = int(counted[d, 0][-1]), counted[d, 0][:-1]
    means = Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    centre, rest = means.centre, means.rest()

    def centred(x: np.ndarray, held: dict) -> None:
        if x.shape[1] == d:
            _products((x - centre).astype(float), held)

    summed = _reduced(_summed(vectors, centred, REAL), REAL)
    covariance = np.array([summed[d, i] for i in range(d)]) / n - np.outer(rest, rest)
    values, columns = largest_components(covariance, components)
    return Whitening(n, sums, covariance, values, columns)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    d = len(model.sums)

    def add(x: np.ndarray, held: dict) -> None:
        if x.shape[1] == d:
            w = model.project(x)
            _products(np.column_stack([w, np.ones(len(w))]), held)  # the last column: their sums

    k = len(model.values)
    summed = _reduced(_summed(vectors, add, REAL), REAL)
    products = np.array([summed[k + 1, i] for i in range(k + 1)])
    means = products[k, :k] / model.n
    return float(np.abs(products[:k, :k] / model.n - np.outer(means, means) - np.eye(k)).max())


OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: the id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold a null or non-finite entry are left out; other columns are not read. Each other entry c becomes
    ``floor(64 * c) + 1000000``. Repeated rows and ids are rows of their own, as are null ids. Components whose variance is at
    rounding level cannot be scaled and are not returned: with one vector, or only equal ones, the result is empty, as for an empty
    table. A deviation beyond the range of a long fails the job.
    """
    kind = vectors.schema[id_col].dataType
    chosen = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    schema = f"vec_id {kind.simpleString()}, {OUTPUT}"
    model = fit(chosen, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(chosen, model)
    explained = model.values / np.trace(model.covariance)
    d, k = len(model.sums), len(model.values)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d * (d + k) numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        sums = fitted.sums
        for batch in batches:
            for ids, x in _pieces(batch):
                if x.shape[1] != d:
                    continue
                away = fitted.n * x - sums
                if float(np.abs(away).max()) ** 2 * d >= 2**63:
                    squares = (away.astype(object) ** 2).sum(1)
                    if max(squares) >= 2**63:
                        raise OverflowError("a deviation does not fit a long")
                    away = squares.astype(np.int64)
                else:
                    away = (away**2).sum(1)
                rows = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, fitted.n)),
                        pa.array(np.repeat(away, k)),
                        pa.array(fitted.project(x).reshape(-1)),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(rows * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return chosen.mapInArrow(work, schema)
