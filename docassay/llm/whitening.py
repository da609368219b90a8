"""Whitening of integer vectors by principal components.

The covariance of the distinct vectors is exact: vectors are centred by the
whole part of their mean before they are multiplied, and what its fraction adds
is taken off in whole numbers. A pivoted Cholesky factorisation of it gives a
triangular factor G with V = G G'; one-sided Jacobi rotations make the columns
of G orthogonal, after which their squared lengths are the eigenvalues of V and
the normalised columns its eigenvectors. V is never squared nor diagonalised
itself, so small eigenvalues keep their digits.

The distinct vectors are written once and read three times: for the sums, for
the scatter, and for the covariance of what came out. Tasks keep one matrix of
the dimension's size; the driver gets sums by dimension and pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import shared_checkpoint

#: Tasks that add up a matrix each, at most, so that what is added up does not grow with the rows.
PARTIAL_SUMS = 2048
LONG_MAX = 2**63 - 1


class Whitening(NamedTuple):
    """What is fitted to the vectors of one length; the mean is `floor` + `rest` / `n`."""

    n: int
    floor: list[int]
    rest: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.floor, np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - sum)^2 of each vector, exact; None where it does not fit a long."""
        y = x - np.array(self.floor, np.int64)
        most = (int(np.abs(y).max(initial=0)) + 1) * self.n
        kind = np.int64 if most * most * max(1, y.shape[1]) <= LONG_MAX else object
        z = y.astype(kind) * self.n - np.array(self.rest, kind)
        return [int(v) if v <= LONG_MAX else None for v in (z * z).sum(axis=1).tolist()]


def whole_numbers(vector: Column | str, scale: int = 64, offset: int = 0) -> Column:
    """floor(scale * entry) + offset as longs; null for a vector that is null or has an entry null or not finite.

    An entry too large for that (2^62 and more) counts as not finite.
    """
    vector = F.col(vector) if isinstance(vector, str) else vector
    scaled = lambda e: e.cast("double") * scale
    odd = F.filter(vector, lambda e: e.isNull() | F.isnan(scaled(e)) | (F.abs(scaled(e)) >= 2.0**62))
    return F.when(F.size(odd) == 0, F.transform(vector, lambda e: F.floor(scaled(e)).cast("long") + offset))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a column of lists."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)
    lengths = np.diff(offsets)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        yield rows, values[offsets[:-1][rows, None] + np.arange(d)]


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(g, order): v[order][:, order] = g g' with g lower triangular, as many columns as v has rank.

    A dimension counts as dependent on those before it once no more of its own
    variance is left than rounding leaves.
    """
    d = len(v)
    order, g, rest = np.arange(d), np.zeros((d, d)), v.diagonal().copy()
    least = 8 * d * np.finfo(float).eps * v.diagonal()
    for k in range(d):
        free = np.where(rest[k:] > least[order[k:]], rest[k:], 0.0)
        p = k + int(free.argmax())
        if free[p - k] == 0:
            return g[:, :k], order
        for x in (order, rest, g):
            x[[k, p]] = x[[p, k]]
        g[k, k] = np.sqrt(rest[k])
        below = v[order[k + 1 :], order[k]] - g[k + 1 :, :k] @ g[k, :k]
        g[k + 1 :, k] = below / g[k, k]
        rest[k + 1 :] -= g[k + 1 :, k] ** 2
    return g, order


def orthogonal_columns(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: g times rotations, until its columns are orthogonal to double precision.

    A sweep takes every pair of columns once, in rounds of pairs that share no column.
    """
    g = g.copy()
    r = g.shape[1]
    players = list(range(r + r % 2))
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(a, b) for a, b in zip(players[:half], players[:half - 1 : -1]) if a < r and b < r]
            players[1:] = players[-1:] + players[1:-1]
            p, q = np.array([x for x, _ in pairs], int), np.array([x for _, x in pairs], int)
            a, b = g[:, p], g[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            cosine = np.abs(gamma) / np.sqrt(alpha * beta)
            largest = max(largest, cosine.max(initial=0.0))
            turn = np.flatnonzero(cosine > np.finfo(float).eps)
            if len(turn):
                p, q, a, b = p[turn], q[turn], a[:, turn], b[:, turn]
                zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                g[:, p], g[:, q] = c * a - c * t * b, c * t * a + c * b
        if largest <= 8 * np.finfo(float).eps:
            break
    return g


def principal_components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components by column) of the covariance v, largest first; the largest entry of each is positive."""
    g, order = pivoted_cholesky(v)
    g = orthogonal_columns(g)
    lengths = np.linalg.norm(g, axis=0)
    first = np.argsort(-lengths, kind="stable")[:most]
    u = np.empty((len(v), len(first)))
    u[order] = g[:, first] / lengths[first]
    signs = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]) if u.size else np.ones(u.shape[1])
    return lengths[first] ** 2, u * signs


def _summed(fit: DataFrame, add: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, dict[tuple[int, int], float]]:
    """`add(d, x)` gives a matrix for a batch of vectors of length d; all of them added up, {d: {(i, j): sum}}."""
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                d = x.shape[1]
                sums[d] = sums.get(d, 0.0) + add(d, x)
        for d, m in sums.items():
            i, j = np.triu_indices(len(m))
            arrays = [np.full(len(i), d, np.int32), i.astype(np.int32), j.astype(np.int32), m[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, schema)], schema=schema)

    cells = fit.coalesce(PARTIAL_SUMS).mapInArrow(partial, "d int, i int, j int, v double")
    out: dict[int, dict[tuple[int, int], float]] = {}
    for x in cells.groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault(x.d, {})[x.i, x.j] = x.v
    return out


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{d: (number of vectors, exact sum of each dimension)}."""
    schema = pa.schema([("d", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                own = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)  # neither leaves a long
                own[0], own[1] = own[0] + len(x), own[1] + (high.astype(object) << 32) + low.astype(object)
        for d, (n, total) in found.items():
            arrays = [[d] * d, range(d), [n] * d, [Decimal(t) for t in total]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, schema)], schema=schema)

    cells = fit.mapInArrow(partial, "d int, j int, n long, total decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for x in cells.groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out.setdefault(x.d, (x.n, [0] * x.d))[1][x.j] = int(x.total)
    return out


def fit_whitening(fit: DataFrame, most: int = 16) -> dict[int, tuple[Whitening, float]]:
    """{length: (model, identity_error)} of `fit`, whose only column `vector` holds distinct vectors of longs.

    The driver gets a number for each pair of dimensions. identity_error: the
    largest absolute entry of the whitened vectors' covariance (they are centred,
    as their vectors are) minus the identity, measured over `fit`.
    """
    means = {d: (n, [t // n for t in total], [t % n for t in total]) for d, (n, total) in _sums(fit).items()}

    def scatter(d: int, x: np.ndarray) -> np.ndarray:
        y = (x - np.array(means[d][1], np.int64)).astype(np.float64)
        return y.T @ y

    models = {}
    for d, cells in _summed(fit, scatter).items():
        n, floor, rest = means[d]
        v = np.zeros((d, d))
        trace = 0
        for (i, j), s in cells.items():
            exact = n * int(s) - rest[i] * rest[j]
            v[i, j] = v[j, i] = exact / (n * n)
            trace += exact if i == j else 0
        eigenvalues, components = principal_components(v, most)
        if len(eigenvalues):
            models[d] = Whitening(n, floor, rest, components, eigenvalues, eigenvalues / (trace / (n * n)))

    def products(d: int, x: np.ndarray) -> np.ndarray:
        if d not in models:
            return np.zeros((0, 0))
        w = models[d].whitened(x)
        return w.T @ w

    found = _summed(fit, products) if models else {}
    return {d: (m, max(abs(s / m.n - (i == j)) for (i, j), s in found[d].items())) for d, m in models.items()}


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row and component of `vectors`.

    `vectors` has vec_id and vector, an array of longs; rows whose vector is null
    are dropped, other columns are not read. The model is fitted to the distinct
    vectors, n of them; repeated rows are whitened one by one. Vectors of another
    length are a space of their own, with its own n. Components are numbered from
    1 by falling eigenvalue, at most `most` and as many as the covariance has rank:
    one vector alone, vectors without entries and an empty table give no rows.
    deviation, the sum of (n x - sum)^2, is exact, and null where it does not fit a long.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    vectors = vectors.select("vec_id", "vector").where(F.col("vector").isNotNull())
    models = fit_whitening(shared_checkpoint(vectors.select("vector").distinct()), most)
    kind = vectors.schema["vec_id"].dataType
    names = [("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
    schema = pa.schema([("vec_id", to_arrow_type(kind)), *names])
    ddl = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column(1)):
                if x.shape[1] not in models:
                    continue
                model, error = models[x.shape[1]]
                r, k = len(model.eigenvalues), len(rows)
                arrays = [
                    batch.column(0).take(pa.array(np.repeat(rows, r))),
                    np.tile(np.arange(1, r + 1, dtype=np.int32), k),
                    np.full(k * r, model.n),
                    [v for v in model.deviations(x) for _ in range(r)],
                    model.whitened(x).ravel(),
                    np.tile(model.explained, k),
                    np.full(k * r, error),
                ]
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)

    return vectors.mapInArrow(of_rows, ddl)
