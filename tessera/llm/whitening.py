"""Whitening of embeddings along the leading eigenvectors of their covariance.

Vectors are taken as whole numbers x = floor(1024 * c) + 100000. With n vectors
and S the sums of their entries, the covariance V has divisor n and rows are
centred, as (n * x - S) / n from exact whole numbers, before they are multiplied.

Method: LOBPCG (Knyazev, 2001). The driver holds blocks of d x 24 numbers; V
itself is never made. Each round multiplies V by one block: tasks sum
y (y' W) over their centred rows y and their blocks are added in two steps, so
that the driver gets a few. Rayleigh-Ritz then takes the best block from the span
of iterate, residuals and previous directions, which are kept orthonormal, so
that products of V follow by small matrices without losing digits. Iterations
end when all residuals |V u - e u| of a fresh product are at most TOLERANCE
times the largest eigenvalue, or rounding stops them below CERTIFIED times it;
otherwise it is an error.

The table is read once for the sums, once a round, and once each for the check
and the result; nothing grows with it but the number of blocks that tasks add up.

Rows whose vector is null or holds null or non-finite entries are dropped, and so
are those of a length other than the commonest (the greater of equally common
ones; empty vectors don't count). Entries of 2^40 or more are an error. Repeated
rows and ids count and are returned each. Components whose eigenvalue isn't above
1e-12 of the trace can't be whitened and are left out: equal vectors, a single one
or an empty table give no rows. Equal eigenvalues leave the choice of their
eigenvectors open. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GUARD, TOLERANCE, CERTIFIED, ROUNDS = 16, 1e-13, 1e-11, 300
#: Vectors at once in a task.
ROWS = 2048
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Eigen(NamedTuple):
    values: np.ndarray
    vectors: np.ndarray  # a column each, unit, the entry of greatest size positive
    residuals: np.ndarray  # |V u - e u| by a fresh product
    trace: float
    rounds: int


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, lengths and whole numbers, one after another, of the valid vectors of (id, array<double>) batches."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            vectors = batch.column(1)
            sizes = vectors.value_lengths().fill_null(0).to_numpy()
            flat = vectors.flatten()
            c = flat.fill_null(np.nan).to_numpy().astype(np.float64)
            bad = np.append(0, np.cumsum(~np.isfinite(c)))
            ends = np.cumsum(sizes)
            good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
            c = c[np.repeat(good, sizes)]
            if len(c) and np.abs(c).max() >= 2.0**40:
                raise ValueError("entries of 2^40 or more can't be whitened")
            yield batch.column(0).filter(pa.array(good)), sizes[good].astype(np.int64), np.floor(1024 * c).astype(np.int64) + 100000


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for _, sizes, x in _whole(batches):
        of = np.repeat(sizes, sizes)
        for d in np.unique(sizes).tolist():
            own = x[of == d].reshape(-1, d)
            n, s = totals.get(d, (0, 0))
            totals[d] = n + len(own), s + own.sum(axis=0)
    for d, (n, s) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(s)], ["d", "dim", "n", "total"])


def _centred(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and n * x - S, exact, of the vectors of the fit list."""
    d = len(sums)
    for ids, sizes, x in _whole(batches):
        rows = x[np.repeat(sizes == d, sizes)].reshape(-1, d)
        if len(rows):
            yield ids.filter(pa.array(sizes == d)), n * rows - sums


def _added(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """work(batches) of each task, added up: tasks' arrays by 256 in the order of their partitions, then those again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([work(batches).astype("<f8").tobytes()], pa.binary())], ["total"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = np.sum([np.frombuffer(x, "<f8") for x in pdf["total"]], axis=0)
        return pd.DataFrame({"part": pdf["part"].iloc[:1] // 256, "total": [total.tobytes()]})

    parts = rows.mapInArrow(run, "total binary").select(F.spark_partition_id().alias("part"), "total")
    for _ in range(2):
        parts = parts.withColumn("salt", F.floor(F.col("part") / 256).cast("int")).groupBy("salt").applyInPandas(lambda pdf: add(pdf[["part", "total"]]), "part int, total binary")
    return np.sum([np.frombuffer(x.total, "<f8") for x in parts.orderBy("part").collect()], axis=0)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """A basis of what the block's columns add to the span of `against`, an orthonormal block; none where it's rounding."""
    for _ in range(2):
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        block = block - against @ (against.T @ block)
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8]
    return block - against @ (against.T @ block)


def _ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and coefficients of the projected problem."""
    g = basis.T @ product
    values, c = np.linalg.eigh((g + g.T) / 2)
    return values[::-1], c[:, ::-1]


def lobpcg(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Largest k eigenvalues of a symmetric non-negative d x d operator that multiply() applies to a block, their unit
    vectors and certified residuals, and the number of products taken. guard: further columns that speed it up."""
    m = min(d, k + guard)
    k = min(k, m)
    x = np.linalg.qr(np.random.default_rng(d).normal(size=(d, m)))[0]
    ax, fresh, products = multiply(x), True, 1
    p = ap = np.zeros((d, 0))
    best, idle = np.inf, 0
    while True:
        if not p.shape[1]:
            values, c = _ritz(x, ax)
            x, ax = x @ c, ax @ c
        values = np.einsum("ij,ij->j", x, ax)
        r = ax - x * values
        sizes = np.linalg.norm(r[:, :k], axis=0)
        scale = max(abs(values[0]), np.finfo(float).tiny)
        idle = 0 if sizes.max() < 0.5 * best else idle + 1
        best = min(best, sizes.max())
        w = _orthonormal(r[:, np.linalg.norm(r, axis=0) > 0.1 * TOLERANCE * scale], np.hstack([x, p]))
        ended = sizes.max() <= TOLERANCE * scale or (idle >= 8 and sizes.max() <= CERTIFIED * scale) or not w.shape[1]
        if ended and fresh:
            if sizes.max() > CERTIFIED * scale:
                raise ArithmeticError(f"residuals stay at {sizes.max() / scale:.1e} of the largest eigenvalue")
            return values[:k], x[:, :k], sizes, products
        if products >= ROUNDS:
            raise ArithmeticError(f"no convergence in {products} products: residuals {sizes.max() / scale:.1e} of the largest eigenvalue")
        if ended:  # by updated products: take a fresh one to certify
            x = np.linalg.qr(x)[0]
            ax, fresh, p, ap = multiply(x), True, p[:, :0], ap[:, :0]
            products += 1
            continue
        aw, fresh = multiply(w), False
        products += 1
        basis, product = np.hstack([x, w, p]), np.hstack([ax, aw, ap])
        _, c = _ritz(basis, product)
        c = c[:, :m]
        away = c.copy()
        away[:m] = 0  # the step from the iterate: the new direction
        step = _orthonormal(away, c)
        x, ax, p, ap = basis @ c, product @ c, basis @ step, product @ step


def fit(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[int, np.ndarray, Eigen] | None:
    """n, S and the leading components of the fit list, or None without valid vectors."""
    rows = _rows(vectors, id_col, vector_col)
    totals = rows.mapInArrow(_sums, "d long, dim long, n long, total long").groupBy("d", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    common = totals.where("dim = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return None
    n, d = common.n, common.d
    sums = np.array([x.total for x in totals.where(F.col("d") == d).orderBy("dim").collect()], np.int64)
    sc = rows.sparkSession.sparkContext

    def product(block: np.ndarray) -> tuple[np.ndarray, float]:
        """V times the block, and V's trace."""
        shared: Broadcast = sc.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total, squares = np.zeros_like(shared.value), 0.0
            for _, z in _centred(batches, n, sums):
                y = z / n
                total += y.T @ (y @ shared.value)
                squares += np.einsum("ij,ij->", y, y)
            return np.append(total.ravel(), squares)

        out = _added(rows, work) / n
        shared.unpersist()
        return out[:-1].reshape(block.shape), float(out[-1])

    trace = 0.0

    def multiply(block: np.ndarray) -> np.ndarray:
        nonlocal trace
        out, trace = product(block)
        return out

    values, u, residuals, rounds = lobpcg(multiply, d, k)
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    some = values > 1e-12 * trace
    return n, sums, Eigen(values[some], u[:, some], residuals[some], trace, rounds)


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def _square_sums(z: np.ndarray) -> list[int]:
    """Exact sums of squares of rows of whole numbers below 2^62, from limbs of 21 bits."""
    z = np.abs(z)
    limbs = [(z >> s) & 0x1FFFFF for s in (0, 21, 42)]
    dots = {}
    for i in range(3):
        for j in range(i + 1):
            dots[i + j] = dots.get(i + j, 0) + np.einsum("ij,ij->i", limbs[i], limbs[j]).astype(object) * (1 if i == j else 2)
    return sum(v * (1 << 21 * s) for s, v in dots.items()).tolist()


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector of the fit list and component up to k, numbered from 1 by falling eigenvalue: vec_id, component,
    n, deviation (sum of (n * x - S)^2, exact), whitened, explained (share of the trace), identity_error (largest absolute
    entry of the covariance of `whitened` minus the identity)."""
    rows, spark = _rows(vectors, id_col, vector_col), vectors.sparkSession
    found = fit(vectors, k, id_col, vector_col)
    if found is None or not len(found[2].values):
        return spark.createDataFrame([], SCHEMA)
    n, sums, eigen = found
    turn, explained, k = eigen.vectors / np.sqrt(eigen.values), eigen.values / eigen.trace, len(eigen.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, squares = np.zeros(k), np.zeros((k, k))
        for _, z in _centred(batches, n, sums):
            w = z / n @ turn
            total += w.sum(axis=0)
            squares += w.T @ w
        return np.append(total, squares)

    out = _added(rows, moments) / n
    error = float(np.abs(out[k:].reshape(k, k) - np.outer(out[:k], out[:k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, z in _centred(batches, n, sums):
            size, at = len(z) * k, pa.array(np.repeat(np.arange(len(z)), k))
            columns = [
                ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.full(size, n)), pa.array(_square_sums(z), pa.decimal128(38, 0)).take(at),
                pa.array((z / n @ turn).ravel()), pa.array(np.tile(explained, len(z))), pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
