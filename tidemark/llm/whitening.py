"""Whitening of embeddings by shifted CholeskyQR.

The centred vectors are a tall matrix A. A pass over it sums the Gram matrix of its rows, each
solved by the triangular factors of the passes before; its Cholesky factor R is the next of
them, so that A = Q R_k ... R_1 with Q nearer to orthonormal in each pass. The first factor is
that of the Gram matrix plus a small multiple of the identity, as are later ones where Cholesky
breaks down. The singular values and right vectors of the composed R are the components;
squaring happens to Q only, so small ones keep their digits, which the covariance would lose.

What reaches the driver are sums and d x d matrices, d at most ``MOST_DIMENSIONS``. A task holds
an Arrow batch and one such matrix.

Defined results. Rows whose vector is null, empty, or holds a null or non-finite entry are
dropped, and so are those of another length than the most frequent one (the greater of two as
frequent ones). Repeated rows count each, null ids are kept. Entries beyond 2^50 in size after
scaling count as 2^50. Directions without variance have no unit variance either: components
stop at the numeric rank, so equal vectors, or one, give no rows; nor does an empty table.
A deviation beyond 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A d x d matrix of doubles takes 128 MB at this bound.
MOST_DIMENSIONS = 4096

_FAR = float(1 << 50)


@dataclass(frozen=True)
class Whiten:
    components: int = 8
    #: Passes at most; three do for what is not nearly singular.
    passes: int = 8
    #: Distance from one, and from zero, at which the eigenvalues of Q'Q are taken for these.
    close: float = 1e-11
    #: Singular values below this part of the largest one are rounding.
    rank: float = 1e-13
    scale: int = 1024
    offset: int = 100_000


@dataclass(frozen=True)
class Fitted:
    n: int
    sums: np.ndarray
    #: Unit components as columns, and their eigenvalues, falling.
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def rows(df: DataFrame, key: str, column: str, how: Whiten) -> DataFrame:
    """(key, x) with the vectors as scaled whole numbers."""
    v = F.col(column)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * how.scale, F.lit(_FAR)), F.lit(-_FAR))) + how.offset
    return df.select(F.col(key), F.when(fine, F.transform(v, whole)).alias("x")).where("x is not null")


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums/n, whole parts first, so that no digit is lost to large means."""
    return (x - sums // n) - (sums % n) / n


def gram(x: DataFrame, d: int, f) -> np.ndarray:
    """The sum over all rows of z'z, where f turns a batch's matrix into its rows z."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                z = f(_matrix(b.column(0), d))
                total = total + z.T @ z
        if not np.isscalar(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "g": pa.array(list(total), pa.list_(pa.float64()))})

    summed = x.select("x").mapInArrow(parts, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    out = np.zeros((summed.i.max() + 1,) * 2)
    out[summed.i, summed.j] = summed.g
    return (out + out.T) / 2


def _solved(z: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """z R_1^-1 ... R_k^-1."""
    for r in factors:
        z = np.linalg.solve(r.T, z.T).T
    return z


def _factor(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper Cholesky factor of g, shifted in the first pass and wherever it is singular otherwise."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(g, 2)
    if not first:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    return np.linalg.cholesky(g + shift * np.eye(d)).T


def fitted(x: DataFrame, d: int, how: Whiten = Whiten()) -> Fitted | None:
    """Components of all rows of x (key, x), whose vectors have d entries; None without rows."""
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions, more than {MOST_DIMENSIONS}")
    s = x.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    if not s:
        return None
    n, sums = s[0]["n"], np.array([int(r["s"]) for r in s])
    factors: list[np.ndarray] = []
    g = gram(x, d, lambda m: _centred(m, n, sums))
    trace = float(np.trace(g) / n)
    if not trace:
        return Fitted(n, sums, np.zeros((d, 0)), np.zeros(0), trace)
    for _ in range(how.passes):
        factors = [*factors, _factor(g, n, not factors)]
        g = gram(x, d, lambda m, f=tuple(factors): _solved(_centred(m, n, sums), f))
        left = np.linalg.eigvalsh(g)
        if np.all((np.abs(left - 1) < how.close) | (np.abs(left) < how.close**2)):
            break
    value, vector = np.linalg.eigh(g)  # what Q still is off: g = W'W, and A'A = (W R)'(W R)
    w = np.sqrt(np.maximum(value, 0))[:, None] * vector.T
    composed = reduce(np.matmul, [w, *reversed(factors)])
    _, sigma, vt = np.linalg.svd(composed)
    keep = min(how.components, int(np.sum(sigma > how.rank * sigma[0])))
    vt = vt[:keep]
    at = np.argmax(np.abs(vt), axis=1)
    vt = vt * np.sign(vt[np.arange(keep), at])[:, None]
    return Fitted(n, sums, vt.T, sigma[:keep] ** 2 / n, trace)


def identity_error(x: DataFrame, d: int, fit: Fitted) -> float:
    """The largest entry by which the whitened rows' covariance, measured in a pass of its own, is off the identity."""
    n, sums, to = fit.n, fit.sums, fit.vectors / np.sqrt(fit.values)
    g = gram(x, d, lambda m: np.column_stack([_centred(m, n, sums) @ to, np.ones(len(m))])) / n
    mean = g[-1, :-1]
    return float(np.abs(g[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    top = float(max(np.abs(x).max() * n, np.abs(sums).max()))
    if 4 * top * top * x.shape[1] < 2.0**62:
        m = n * x - sums
        return pa.array(np.einsum("ij,ij->i", m, m))
    m = n * x.astype(object) - sums.astype(object)
    return pa.array([v if v < 1 << 63 else None for v in (m * m).sum(axis=1)], pa.int64())


def whitened(df: DataFrame, key: str = "vec_id", column: str = "embedding", how: Whiten = Whiten()) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error): the last but one an entry a component, the last the measured error of all."""
    x = rows(df, key, column, how)
    kind = x.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, deviation long, whitened array<double>"
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    x = x.where(F.size("x") == d)
    fit = fitted(x, d, how)
    if fit is None or not len(fit.values):
        out = x.where("false").select(key, F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return out.select(key, F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    off = identity_error(x, d, fit)
    n, sums, to = fit.n, fit.sums, fit.vectors / np.sqrt(fit.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1), d)
                z = _centred(m, n, sums) @ to
                yield pa.RecordBatch.from_arrays([b.column(0), _deviation(m, n, sums), pa.array(list(z), pa.list_(pa.float64()))], [key, "deviation", "whitened"])

    share = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values])
    return x.mapInArrow(project, schema).select(key, F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(off).alias("identity_error"))


def components(df: DataFrame, key: str = "vec_id", column: str = "embedding", how: Whiten = Whiten()) -> DataFrame:
    """``whitened`` with a row for each component, from 1."""
    w = whitened(df, key, column, how).select(key, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("_i", "_c"))
    return w.select(key, (F.col("_i") + 1).alias("component"), "n", "deviation", F.col("_c.whitened"), F.col("_c.explained"), "identity_error")
