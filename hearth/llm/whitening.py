"""Whitening of vectors by a compensated covariance.

Components become whole numbers.  Sums, and then outer products of the centred
vectors, are accumulated in double-double with error-free transformations: a task
adds up its rows by halves, and high and low parts merge through a reduction tree
over the tasks.  The covariance, whose size depends on the number of components
alone, is solved on the driver by LAPACK's syevd: reduction to tridiagonal form,
then divide and conquer.  Eigenvectors are then corrected against the
double-double covariance, so that small eigenvalues keep their digits
beside large ones.  The whitened vectors are stored, and their own covariance,
taken in the same way, tells how far they are from white.

Cases: vectors that are null, empty, or hold null or non-finite components are
dropped; null and repeated ids keep their rows, each of which counts; components
without variance (2**-70 of the trace or less) have no whitened value (null), and
the error is over the others (null if there are none); where the trace is zero
`explained` is null; vectors of fewer components than asked for give as many rows
as they have components; no vector gives an empty result; other columns are
ignored.  Vectors of different lengths and whole numbers beyond 2**53 are errors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import double_double as D
from . import kernels as K
from .shared import written
from .vectors import tree_sum, usable

SCALE, SHIFT = 1024, 100_000
#: Components that vary by this share of all variance or less have none.
NO_VARIANCE = 2.0**-70
#: Rows taken at a time; bounds the temporary arrays.
ROWS = 512
PARTIAL = "n long, high binary, low binary"


@dataclass(frozen=True)
class Whitening:
    n: int
    #: Exact sums of the whole-number components.
    sums: tuple[int, ...]
    mean: D.Pair
    #: Falling eigenvalues and their unit eigenvectors in columns.
    values: np.ndarray
    axes: np.ndarray
    trace: float


def whole(matrix: np.ndarray) -> np.ndarray:
    x = np.floor(matrix * SCALE) + SHIFT
    if x.size and not np.abs(x).max() < 2**53:
        raise ValueError("a component is beyond 2**53 / 1024")
    return x


def as_they_are(matrix: np.ndarray) -> np.ndarray:
    return matrix


def _folded(vectors: DataFrame, column: str, fold: Callable, depth: int) -> tuple[int, D.Pair] | None:
    """(n, sum of what `fold` makes of rows in columns) over all usable vectors."""

    def run(batches):
        n, held = 0, None
        for batch in batches:
            _, matrix = usable(batch.column(0))
            for at in range(0, len(matrix), ROWS):
                part = matrix[at : at + ROWS]
                made = fold(part)
                held = made if held is None else D.add(held, made)
                n += len(part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([held[0].tobytes()]), pa.array([held[1].tobytes()])], names=["n", "high", "low"])

    def merge(a, b):
        if len(a[1][0]) != len(b[1][0]):
            raise ValueError("vectors of different lengths")
        return a[0] + b[0], D.add(a[1], b[1])

    return tree_sum(vectors.select(column).mapInArrow(K.tidy(run), PARTIAL), lambda r: (r.n, (np.frombuffer(r.high), np.frombuffer(r.low))), merge, depth)


def sums(vectors: DataFrame, column: str, made: Callable = as_they_are, depth: int = 2) -> tuple[int, list[Fraction]] | None:
    """(n, sum of each component)."""

    def fold(rows):
        x = made(rows).T
        return D.total((x, np.zeros_like(x)))

    found = _folded(vectors, column, fold, depth)
    return found and (found[0], D.fractions(found[1]))


def covariance(vectors: DataFrame, column: str, mean: D.Pair, made: Callable = as_they_are, depth: int = 2) -> D.Pair:
    """The covariance (divisor n) about a mean: outer products of centred rows, the upper triangle row by row."""
    width = len(mean[0])
    shipped = vectors.sparkSession.sparkContext.broadcast(mean)

    def fold(rows):
        high, low = shipped.value
        h, e = D.two_sum(made(rows).T, -high[:, None])
        h, l = D.settled(h, e - low[:, None])
        cut = D.halves(h)
        out = []
        for i in range(width):
            p, e = D.two_prod(h[i], h[i:], tuple(x[i] for x in cut), tuple(x[i:] for x in cut))
            out.append(D.total(D.settled(p, e + (h[i] * l[i:] + l[i] * h[i:]))))
        return tuple(np.concatenate(x) for x in zip(*out))

    n, flat = _folded(vectors, column, fold, depth)
    out = []
    for part in D.over(flat, n):
        full = np.zeros((width, width))
        full[np.triu_indices(width)] = part
        out.append(full + np.triu(full, 1).T)
    return tuple(out)


def eigen(v: D.Pair, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors in columns) of a symmetric double-double matrix.

    From LAPACK's divide and conquer, corrected by the residuals of X'X = I and
    X'VX = diagonal in double-double (Ogita and Aishima).
    """
    axes = np.linalg.eigh(v[0])[1]
    for _ in range(steps):
        x = axes, np.zeros_like(axes)
        turned = axes.T.copy(), np.zeros_like(axes)
        gram = D.matmul(turned, x)
        s = D.matmul(turned, D.matmul(v, x))
        r = (np.eye(len(axes)) - gram[0]) - gram[1]
        values = np.diag(s[0]) / (1 - np.diag(r))
        gaps = values[None, :] - values[:, None]
        off = s[0] - np.diag(np.diag(s[0]))
        near = np.abs(gaps) <= 2 * (np.abs(off).max(initial=0) + np.abs(values).max(initial=0) * np.abs(r).max(initial=0))
        step = np.where(near, r / 2, (off + values[None, :] * r) / np.where(near, 1, gaps))
        axes = axes + axes @ step
        axes /= np.sqrt((axes * axes).sum(0))
    high, low = D.matmul(v, (axes, np.zeros_like(axes)))
    p, e = D.two_prod(axes, high)
    p, e = D.settled(p, e + axes * low)
    values = D.total((p.T, e.T))[0]
    order = np.argsort(-values, kind="stable")
    return values[order], axes[:, order]


def fitted(vectors: DataFrame, vector: str = "embedding", depth: int = 2) -> Whitening | None:
    """Mean, eigenvalues and eigenvectors of all usable vectors' whole numbers; None without vectors."""
    found = sums(vectors, vector, whole, depth)
    if found is None:
        return None
    n, s = found
    mean = D.from_fractions([x / n for x in s])
    v = covariance(vectors, vector, mean, whole, depth)
    values, axes = eigen(v)
    return Whitening(n, tuple(int(x) for x in s), mean, values, axes, float(sum(D.fractions(tuple(np.diag(p) for p in v)))))


def deviations(x: np.ndarray, n: int, s: tuple[int, ...]) -> pa.Array:
    """The exact sum over components of (n x - S)**2 of each row; null beyond 38 digits."""
    top = max(abs(n * int(v) - t) for row in (x.max(0), x.min(0)) for v, t in zip(row, s)) if len(x) else 0
    if len(s) * top * top < 2**63 and n * (int(np.abs(x).max(initial=0)) + 1) < 2**62:
        y = n * x.astype(np.int64) - np.array(s, np.int64)
        return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
    y = n * x.astype(np.int64).astype(object) - np.array(s, object)
    return pa.array([Decimal(v) if v < 10**38 else None for v in (y * y).sum(1)], pa.decimal128(38, 0))


def whitened(vectors: DataFrame, model: Whitening, components: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, deviation, white) of every usable vector; white has the components with variance among the first ones."""
    k = int((model.values[:components] > NO_VARIANCE * model.trace).sum())
    shipped = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.mean, model.axes[:, :k] / np.sqrt(model.values[:k])))

    def run(batches):
        n, s, (high, low), axes = shipped.value
        for batch in batches:
            places, matrix = usable(batch.column(1))
            for at in range(0, len(places), 4096):
                x = whole(matrix[at : at + 4096])
                white = ((x - high) - low) @ axes
                ends = np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places[at : at + 4096])), deviations(x, n, s), pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))], names=["id", "deviation", "white"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), vector).mapInArrow(K.tidy(run), "id long, deviation decimal(38,0), white array<double>")


def whiteness(rows: DataFrame, column: str = "white", depth: int = 2) -> float | None:
    """The largest absolute entry of the vectors' covariance less the identity."""
    found = sums(rows, column, depth=depth)
    if found is None:
        return None
    n, s = found
    v = covariance(rows, column, D.from_fractions([x / n for x in s]), depth=depth)
    return float(np.abs((v[0] - np.eye(len(v[0]))) + v[1]).max())


def whitening(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector: str = "embedding", depth: int = 2) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error of every usable vector and component."""
    spark = vectors.sparkSession
    model = fitted(vectors, vector, depth)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = written(whitened(vectors, model, components, id_col, vector), "whitened")
    error = F.lit(whiteness(rows, depth=depth)).cast("double")
    shares = [float(max(e, 0.0) / model.trace) if model.trace else None for e in model.values[:components]]
    parts = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.get("white", F.lit(i)).alias("whitened"), F.lit(share).cast("double").alias("explained")) for i, share in enumerate(shares)])
    return rows.select("id", "deviation", F.explode(parts).alias("c")).select(F.col("id").alias("vec_id"), "c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", error.alias("identity_error"))
