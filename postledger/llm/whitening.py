"""Embedding whitening: components of the covariance by spectral divide and conquer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postledger.shared import cut

SCALE, SHIFT = 1024, 100_000  # an entry c becomes floor(SCALE * c) + SHIFT
COMPONENTS = 8
LARGEST = float(1 << 40)  # largest entry, by amount
FAN = 64  # partial sums are added up in two steps, first in this many shares

EPS = float(np.finfo(float).eps)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: rows whose vector has entries, none of them NULL, NaN or infinite."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where((F.size("v") > 0) & ~bad)


def whole_numbers(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"an entry is {LARGEST} or more")
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per vector length met in a task: its number of vectors and the sum in each dimension."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        column = batch.column(0)
        sizes = column.value_lengths()
        for size in sizes.unique().to_pylist():
            x = whole_numbers(column.filter(pa.compute.equal(sizes, size)))
            n, total = found.get(size, (0, 0))
            found[size] = n + len(x), total + x.sum(axis=0)
    for size, (n, total) in found.items():
        columns = [pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)), pa.array(total)]
        yield pa.RecordBatch.from_arrays(columns, ["size", "i", "n", "total"])


def fit_sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums by dimension; the driver gets one row per dimension."""
    parts = rows.select("v").mapInArrow(_sums, "size int, i int, n long, total long")
    sums = parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    sizes = sorted({r["size"] for r in sums})
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes}")
    total = np.zeros(len(sums), np.int64)
    for r in sums:
        total[r["i"]] = r["total"]
    return (sums[0]["n"] if sums else 0), total


def _added(group: pa.Table) -> pa.Table:
    rows = [np.frombuffer(row, dtype=float) for row in group.column("row").to_pylist()]
    return pa.table({"i": group.column("i")[:1], "row": [np.sum(rows, axis=0).tobytes()]})


def covariance(rows: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """Covariance of the whole-number vectors, centred before multiplying.

    Every task multiplies its own centred rows; the products, one row per task and
    dimension, are added up in two steps of shuffles. The driver gets one matrix.
    """
    shared = rows.sparkSession.sparkContext.broadcast(total / n)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = shared.value
        product, share = np.zeros((len(mean), len(mean))), TaskContext.get().partitionId()
        for batch in batches:
            centred = whole_numbers(batch.column(0)) - mean
            product += centred.T @ centred
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(mean), share, np.int32)), pa.array(np.arange(len(mean), dtype=np.int32)), pa.array([row.tobytes() for row in product], pa.binary())], ["share", "i", "row"]
        )

    parts = rows.select("v").mapInArrow(products, "share int, i int, row binary")
    parts = parts.groupBy(F.col("share") % FAN, "i").applyInArrow(_added, "i int, row binary")
    parts = parts.groupBy("i").applyInArrow(_added, "i int, row binary").collect()
    v = np.zeros((len(total), len(total)))
    for r in parts:
        v[r["i"]] = np.frombuffer(r["row"], dtype=float)
    return (v + v.T) / (2 * n)


def polar(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps.

    None if the matrix is singular to working precision, so that no factor is near.
    """
    x = a / np.linalg.norm(a)
    low = EPS  # lower bound of the singular values
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        weight = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack((np.sqrt(c) * x, np.eye(len(x)))))
            new = b / c * x + (weight - b / c) / np.sqrt(c) * q[: len(x)] @ q[len(x) :].T
        else:
            z = np.eye(len(x)) + c * x.T @ x
            new = b / c * x + (weight - b / c) * np.linalg.solve(z, x.T).T
        new = (new + new.T) / 2
        step = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (weight + b * square) / (1 + c * square))
        if step < 1e-10 and 1 - low < 1e-10:
            break
    return x if np.linalg.norm(x @ x - np.eye(len(x))) < 1e-10 else None


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift inside the spectrum.

    The polar factor U of ``a - shift`` gives the spectral projector (U + I) / 2.
    None if the eigenvalues are all equal to working precision.
    """
    n, diagonal = len(a), np.diag(a)
    spread = np.linalg.norm(a - diagonal.mean() * np.eye(n))
    for shift in (np.median(diagonal), diagonal.mean(), *(diagonal.mean() + spread / n * rng.uniform(-0.5, 0.5, 8))):
        u = polar(a - shift * np.eye(n))
        if u is None:
            continue
        projector = (u + np.eye(n)) / 2
        k = round(np.trace(projector))
        if not 0 < k < n:
            continue
        high = np.linalg.qr(projector @ np.linalg.qr(projector @ rng.standard_normal((n, k)))[0])[0]
        rest = rng.standard_normal((n, n - k))
        for _ in range(2):
            rest = rest - high @ (high.T @ rest)
            rest = np.linalg.qr(rest - projector @ rest)[0]
        rest = np.linalg.qr(rest - high @ (high.T @ rest))[0]
        return high, rest
    return None


def leading_components(v: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Invariant subspaces are split until they are single vectors; the lower part of a
    split is left alone once the upper ones hold ``k``. Of a vector's signs the one that
    makes its largest entry positive is taken.
    """
    rng = np.random.default_rng(seed)
    floor = EPS * np.linalg.norm(v)
    parts, found = [np.eye(len(v))], []
    while parts and sum(b.shape[1] for b in found) < k:
        basis = parts.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        flat = np.linalg.norm(a - np.diag(a).mean() * np.eye(len(a))) <= floor * len(a)
        halves = None if len(a) == 1 or flat else split(a, rng)
        if halves is None:
            found.append(basis)
        else:
            parts += [basis @ halves[1], basis @ halves[0]]
    if not len(v):
        return np.zeros(0), np.zeros((0, 0))
    vectors = np.linalg.qr(np.hstack(found))[0]
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return np.maximum(values[order], 0.0), vectors * signs


def squared_deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - total) squared; None beyond a 64-bit integer."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(total).max(initial=0))
    if most < 1 << 62:
        d = n * x - total
        most = int(np.abs(d).max(initial=0))
        if most * most * len(total) < 1 << 63:
            return (d * d).sum(axis=1).tolist()
    exact = (sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x)
    return [e if e < 1 << 63 else None for e in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component.

    Vectors that are NULL or empty, or hold a NULL, NaN or infinite entry, are left out. All
    others are the fit list: each entry c becomes the whole number floor(1024 c) + 100000,
    ``n`` vectors with exact sums by dimension. Components are the unit eigenvectors
    of their covariance, from 1 by falling eigenvalue, at most as many as dimensions.

    Passes over the table: exact sums; centred products; projection. What is
    broadcast has the size of one vector or of ``components`` vectors. The driver
    holds one matrix of the vectors' length squared, whatever the number of rows.

    A component without variance (all of them in a table of equal vectors) has
    ``whitened`` 0 and no part in ``identity_error``, which is 0 if none is left;
    ``explained`` is 0 if no dimension varies. Repeated rows and NULL ids are rows of
    their own. A ``deviation`` beyond 64 bits is NULL. Vectors of different lengths, and
    entries of 2^40 or more, raise an error. An empty table gives an empty table;
    other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    n, total = fit_sums(rows)
    k = min(components, len(total))
    v = covariance(rows, n, total) if n else np.zeros((0, 0))
    values, basis = leading_components(v, k)
    trace = float(np.trace(v))
    varied = values > EPS * len(total) * trace
    scaled = basis * np.where(varied, 1 / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    shared = rows.sparkSession.sparkContext.broadcast((n, total, scaled))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, scaled = shared.value
        for batch in batches:
            x = whole_numbers(batch.column(1))
            w = (x - total / n) @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(squared_deviations(x, n, total), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))],
                ["vec_id", "deviation", "w"],
            )

    whitened = cut(rows.mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>"), "whitened")
    at = [i for i in range(k) if varied[i]]
    pairs = [(i, j) for i in at for j in at if i <= j]
    # covar_pop centres as it goes and merges by task; there are at most components squared of them.
    parts = [F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]
    measured = whitened.agg(*parts).first() if n and parts else ()
    error = max((abs(c - (i == j)) for (i, j), c in zip(pairs, measured)), default=0.0)
    explained = F.array(*[F.lit(float(e / trace) if trace else 0.0) for e in values]).cast("array<double>")
    return whitened.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened")).select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
