"""Whitening of embeddings with eigenvectors refined from single to double precision.

Entries become integers, so that counts, sums and the second moments about an integer centre are
exact in any order of addition; the covariance is formed from them on the driver, where it is a
matrix of the dimension's size whatever the number of rows.

Its eigenvectors are computed in float32 and corrected by the iteration of Ogita and Aishima: from
an approximate X, the residuals R = I - X'X and S = X'VX, formed in extended precision, give a
correction E with X + XE of twice as many right digits. Pairs of eigenvalues closer than the
iteration can tell apart take only the part of E that restores orthogonality; each such cluster is
then solved on its own: the matrix shifted by the cluster's mean and projected on its vectors is
diagonalised in float64, and the vectors are turned by the result. Steps repeat until nothing
moves any more.

State between tasks: a row of d sums, then rows of d x d cells, added up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import stored, table

#: Factor and offset that make entries integers; entries of this size and beyond count as not finite.
SCALE, OFFSET, HUGE = 64, 1_000_000, float(1 << 30)


# ------------------------------------------------------------------ eigenvectors


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b with sums in extended precision."""
    return np.asarray(a, np.longdouble) @ np.asarray(b, np.longdouble)


def _corrected(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step: better vectors, their values, the distance under which two values form a cluster, the step's size."""
    r = np.eye(len(v), dtype=np.longdouble) - _product(x.T, x)
    s = _product(x.T, _product(v, x))
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    near = float(2 * (np.linalg.norm(off.astype(float), 2) + np.linalg.norm(v.astype(float), 2) * np.linalg.norm(r.astype(float), 2)))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + _product(x, e), values, near, float(np.abs(e).max())


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Places of values that are chained by steps of at most near, two or more together."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(values[order][:-1] - values[order][1:] > near) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigenvectors(v: np.ndarray, most: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    scale = float(np.abs(v).max()) if v.size else 0.0
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    a = np.asarray(v, np.longdouble) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    for _ in range(most):
        x, values, near, moved = _corrected(a, x)
        # A cluster's vectors span the right space to the precision reached so far, but are turned within it.
        for c in _clusters(values, near):
            part = x[:, c]
            mean = values[c].mean()
            inner = _product(part.T, _product(a, part) - mean * part)
            x[:, c] = _product(part, np.linalg.eigh((inner + inner.T).astype(np.float64) / 2)[1])
        if moved < 1e-17:
            break
    for _ in range(2):  # values closer than rounding may leave vectors a little off the right angle
        x = x + _product(x, (np.eye(len(a)) - _product(x.T, x)) / 2)
    values = np.diag(_product(x.T, _product(a, x))) / np.diag(_product(x.T, x))
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return (values[order] * scale).astype(float), x.astype(float)


# ------------------------------------------------------------------ moments


def entries(vector: Column) -> Column:
    """The vector as integers; null if it is null or holds null, non-finite or huge entries."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= HUGE))
    return F.when(~bad, F.transform(wide, lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long")))


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _summed(rows: DataFrame, d: int, cells: int, of) -> np.ndarray:
    """The sum over all rows of of(matrix), an array of cells numbers.

    Each task adds up its own rows; Spark adds the tasks' sums cell by cell. Blocks are small
    enough for sums of integers to stay exact.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch.column("x"), d)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "part"])

    out = np.zeros(cells)
    for r in rows.select("x").mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect():
        out[r["cell"]] = r["part"]
    return out


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, exact sums per dimension, and the covariance (divisor n) of a table of integer vectors x."""
    sums = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, s = sums["n"], [int(sums[f"s{i}"] or 0) for i in range(d)]
    if not n:
        return 0, s, np.zeros((d, d))
    centre = [round(t / n) if abs(t) < 1 << 52 else (2 * t + n) // (2 * n) for t in s]
    at = np.array(centre, np.int64)

    def gram(x: np.ndarray) -> np.ndarray:
        y = (x - at).astype(float)
        return y.T @ y

    shift = np.array([float(t - c * n) / n for t, c in zip(s, centre, strict=True)])
    return n, s, _summed(fit, d, d * d, gram).reshape(d, d) / n - np.outer(shift, shift)


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n as doubles, and the exact sums of (n x - S)^2 (None if over a long)."""
    most = int(np.abs(x).max(initial=1)) * n + max((abs(t) for t in sums), default=0)
    if most < 1 << 62:
        off = x * n - np.array(sums, np.int64)
        top = int(np.abs(off).max(initial=0))
        if top * top * max(1, x.shape[1]) < 1 << 63:
            return off / n, (off * off).sum(axis=1).tolist()
    off = x.astype(object) * n - np.array(sums, object)
    total = (off * off).sum(axis=1).tolist() if x.shape[1] else [0] * len(x)
    return (off / n).astype(float), [t if t < 1 << 63 else None for t in total]


# ------------------------------------------------------------------ operator


def whitened(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Rows of vectors (vec_id, embedding) projected on the leading components of their distinct vectors.

    Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.
    Rows whose vector is null, or holds null, non-finite or huge (2**30 and beyond) entries, are
    dropped; so are vectors that are not of the most common length (of equally common ones, the
    longest). Each distinct vector counts once for n, sums and covariance, repeated rows each get
    their own result, and a null vec_id stays null. Components whose eigenvalue is not above
    rounding (d x 2**-52 of the largest) can't be scaled and are left out; so one vector alone, or
    an empty table, gives no rows. A deviation beyond a long is null. The sign of a component makes
    its entry of greatest size positive. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == d)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n, sums, v = moments(fit, d)
    values, x = eigenvectors(v)
    k = min(components, int((values > d * 2.0 ** -52 * values[0]).sum())) if values[0] > 0 else 0
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    x = x[:, :k] * np.where(np.take_along_axis(x[:, :k], np.abs(x[:, :k]).argmax(axis=0)[None], 0)[0] < 0, -1, 1)
    scaled = x / np.sqrt(values[:k])
    explained = values[:k] / np.trace(v)

    def second(rows_x: np.ndarray) -> np.ndarray:
        w = centred(rows_x, n, sums)[0] @ scaled
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    found = _summed(fit, d, k * k + k, second) / n
    error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(found[k * k:], found[k * k:]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                off, deviation = centred(matrix(part.column("x"), d), n, sums)
                m = part.num_rows
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     pa.array(deviation, pa.int64()).take(again), pa.array((off @ scaled).ravel()), pa.array(np.tile(explained, m)),
                     pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op12_whitening(spark, sf_dir):
    """All embeddings, whitened."""
    return whitened(table(spark, sf_dir, "embeddings"))
