"""Embedding whitening by shifted CholeskyQR.

The rows of the fit list, centred, are a tall matrix X. Gram passes make it orthonormal: each pass
takes the Gram matrix of Q = X R^-1 (solved by substitution, column by column, for a batch of rows at
a time) as a sum over tasks, factors it by Cholesky and composes the factor into R. The first factor
is shifted, so it exists however nearly dependent the dimensions are; later passes are shifted only if
they must be. Once Q is orthonormal, the singular values and right vectors of the small R are those of
X, to double precision (a Gram matrix of X itself would only give half the digits). What the driver
holds is a few matrices of dimension x dimension.

Entries are first put on a grid: x = floor(SCALE * entry) + OFFSET, a whole number. The fit list is
each distinct x vector once, told apart by all its numbers; sums and the products n * x - S are exact.

Defined results: a null vector and one with a null or non-finite entry take no part; vectors of
different lengths are whitened each length on its own; a zero vector is a row like any other; repeated
rows get equal results and count once in the fit; a direction without variance (a constant dimension,
a sum of others, fewer distinct vectors than dimensions) is no component, so equal vectors alone, an
empty vector or an empty table give no rows; equal eigenvalues come in any order; entries beyond
+-2^55 are taken as +-2^55 on the grid; a deviation that a bigint cannot hold is null; null ids stay
null; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .sums import tree_sum

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Gram passes at most; three are enough but for nearly dependent dimensions.
PASSES = 6
#: Q counts as orthonormal if its Gram matrix is this near the identity.
ORTHONORMAL = 1e-9
#: Singular values below this part of the largest are none.
NO_VARIANCE = 1e-12
#: Largest grid value, and rows that are worked on at once.
_EDGE = float(1 << 55)
_ROWS = 4096


# ---- the grid --------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """Not null and every entry a finite number."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _grid(column: pa.Array, scale: int, offset: int) -> np.ndarray:
    """(rows, dimensions) whole numbers of a column of equally long lists."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(scale * flat), -_EDGE, _EDGE)
    return x.astype(np.int64).reshape(len(column), -1) + offset


def _pack(x: np.ndarray, offset: int) -> list[bytes]:
    """Each row as bytes in the narrowest type that holds all its numbers; equal rows have equal bytes."""
    y = x - offset
    low, high = y.min(1), y.max(1)
    out: list[bytes] = [b""] * len(y)
    left = np.ones(len(y), bool)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        info = np.iinfo(kind)
        fits = left & (low >= info.min) & (high <= info.max)
        for i, row in zip(np.flatnonzero(fits), y[fits].astype(kind)):
            out[i] = row.tobytes()
        left &= ~fits
    return out


def _unpack(column: pa.Array, dim: int, offset: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.empty((len(rows), dim), np.int64)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // dim
    for size, kind in ((1, np.int8), (2, np.int16), (4, np.int32), (8, np.int64)):
        at = np.flatnonzero(sizes == size)
        if len(at):
            out[at] = np.frombuffer(b"".join([rows[i] for i in at]), kind).reshape(len(at), dim)
    return out + offset


def _parts(x: np.ndarray) -> Iterator[np.ndarray]:
    for lo in range(0, len(x), _ROWS):
        yield x[lo:lo + _ROWS]


# ---- linear algebra ----------------------------------------------------------------------------

def solve_right(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = X for an upper triangular R, by substitution."""
    q = np.array(x, np.float64, order="F")
    for j in range(r.shape[0]):
        if j:
            q[:, j] -= q[:, :j] @ r[:j, j]
        q[:, j] /= r[j, j]
    return q


def factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = gram; shifted (always, or where the plain factor does not exist) by a
    bound of the rounding error of a Gram matrix of n rows."""
    d = len(gram)
    size = max(float(np.linalg.norm(gram, 2)), np.finfo(float).tiny)
    shift = 11 * (min(n * d, 1 << 30) + d * (d + 1)) * np.finfo(float).eps / 2 * size
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


@dataclass
class Model:
    """What whitening needs of a fit: n distinct vectors, their exact sums, and per component the unit
    direction (a row), the eigenvalue and its share of the trace; error is that of the whitened covariance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    scale: int
    offset: int
    error: float = 0.0

    @property
    def _middle(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part of the mean, and n times the rest of it."""
        middle = [s // self.n for s in self.sums]
        return np.array(middle, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, middle)], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, with no digit lost to the size of x."""
        middle, rest = self._middle
        return (x - middle).astype(np.float64) - rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exactly; None beyond a bigint."""
        middle, rest = self._middle
        y = x - middle
        far = (self.n * (np.abs(y).max(initial=0).astype(object) + 1)) ** 2 * max(1, x.shape[1])
        if far < 1 << 63:
            return ((self.n * y - rest) ** 2).sum(1).tolist()
        exact = ((y.astype(object) * self.n - rest.astype(object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / np.sqrt(self.values)[:, None]).T


# ---- distributed passes ------------------------------------------------------------------------

def distinct_vectors(rows: DataFrame, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The distinct grid vectors of equally long vectors, packed (column `packed`); copies are combined
    before the shuffle, so a vector that a third of all rows hold is one row per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _grid(batch.column(0), scale, offset)
            if len(x):
                yield pa.record_batch([pa.array(_pack(x, offset), pa.binary())], ["packed"])
    return rows.select(vector_col).mapInArrow(run, "packed binary").distinct()


def _totals(fit: DataFrame, dim: int, offset: int) -> tuple[int, list[int]]:
    """Count and exact sums per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            for x in _parts(_unpack(batch.column(0), dim, 0)):
                n += len(x)
                whole = np.abs(x).max(initial=0).astype(object) * len(x) < 1 << 62
                total = total + (x.sum(0).astype(object) if whole else x.astype(object).sum(0))
        if n:
            yield pa.record_batch([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                                   pa.array([str(v) for v in total])], ["at", "n", "total"])
    added = (fit.mapInArrow(run, "at int, n bigint, total string").groupBy("at")
             .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("at").collect())
    n = added[0].n if added else 0
    return n, [int(r.total) + n * offset for r in added]


def _gram(fit: DataFrame, dim: int, model: Model, solved) -> np.ndarray:
    """Sum over the fit list of solved(centred rows), as rows' products."""
    def make(batch: pa.RecordBatch) -> np.ndarray:
        total = 0
        for x in _parts(_unpack(batch.column(0), dim, model.offset)):
            q = solved(model.centred(x))
            total = total + q.T @ q
        return total.ravel()
    size = solved(np.zeros((1, dim))).shape[1]
    g = tree_sum(fit, make, size * size).reshape(size, size)
    return (g + g.T) / 2


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS, vector_col: str = "vector",
        scale: int = SCALE, offset: int = OFFSET) -> Model:
    """Model of usable, equally long vectors (length dim)."""
    vectors = cut_lineage(distinct_vectors(rows, vector_col, scale, offset))
    n, sums = _totals(vectors, dim, offset)
    model = Model(n, sums, np.zeros((0, dim)), np.zeros(0), np.zeros(0), scale, offset)
    if not n:
        return model
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        for r in factors:
            x = solve_right(x, r)
        return x

    for turn in range(PASSES):
        gram = _gram(vectors, dim, model, orthogonal)
        if turn and np.abs(gram - np.eye(dim)).max() < ORTHONORMAL:
            break
        if not gram.any() or turn == PASSES - 1:
            break
        factors.append(factor(gram, n, shifted=turn == 0))
    # X = Q R; gram = Q'Q is all but the identity, and has the missing directions of dependent dimensions
    length, turn_of = np.linalg.eigh(gram)
    whole = np.sqrt(np.maximum(length, 0))[:, None] * turn_of.T
    for r in reversed(factors):
        whole = whole @ r
    _, single, directions = np.linalg.svd(whole)
    real = single > NO_VARIANCE * single[0] if len(single) and single[0] > 0 else np.zeros(len(single), bool)
    kept = np.flatnonzero(real)[:components]
    variance = single ** 2 / n
    model.directions, model.values = directions[kept], variance[kept]
    model.shares = variance[kept] / variance.sum() if len(kept) else np.zeros(0)
    if len(kept):
        weights = (model.directions / np.sqrt(model.values)[:, None]).T
        covariance = _gram(vectors, dim, model, lambda x: x @ weights) / n
        model.error = float(np.abs(covariance - np.eye(len(kept))).max())
    return model


_OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """A row per vector and component: the id, component (from 1), n, deviation, whitened, explained, identity_error."""
    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), *T._parse_datatype_string(_OUT).fields])
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows if k else 0, _ROWS):
                part = batch.slice(lo, _ROWS)
                x = _grid(part.column(1), model.scale, model.offset)
                m, again = len(x), np.repeat(np.arange(len(x)), k)
                yield pa.record_batch([
                    part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(again)),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.shares, m)), pa.array(np.full(m * k, model.error))],
                    names=schema.names)

    return rows.select(F.col(id_col).alias("id"), F.col(vector_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit on all distinct vectors and transform all rows; each vector length on its own."""
    vector = F.col(vector_col).cast("array<double>")
    valid = rows.select(F.col(id_col).alias("vec_id"), vector.alias("vector")).filter(usable(F.col("vector")))
    lengths = [r.dim for r in valid.select(F.size("vector").alias("dim")).distinct().orderBy("dim").collect()]
    out = None
    for dim in lengths or [0]:
        own = valid.filter(F.size("vector") == dim)
        model = fit(own, dim, components, "vector", scale, offset) if dim else Model(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), scale, offset)
        got = transform(own, model)
        out = got if out is None else out.unionByName(got)
    return out
