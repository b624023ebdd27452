"""Operator 13, embedding whitening with eigenvectors refined in mixed precision.

Vectors become whole numbers, each distinct one counts once. Sums are exact; the covariance
is added up from centred rows, in each task and then in a tree of tasks, so that what is
held at once is a few matrices of dimension squared. Its eigenvectors are computed in single
precision, which is cheap, and corrected by the iteration of Ogita and Aishima: with
R = I - X'X and S = X'AX in extended precision, the next X is X + XE, where E follows from R
and S by elementwise divisions. Each round squares the error. Where eigenvalues are closer
than the current error, the divisions would not hold: such a cluster is rotated by the
eigenvectors of its own small block, shifted by its mean so that no digits are lost, and the
rounds go on until nothing changes in double precision.

Only the matrix of dimension squared reaches the driver, where the rounds run on it.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries take
no part; neither do vectors of another length than the most frequent one (the longer of two
as frequent), as no covariance is defined between lengths; a whole number beyond 64 bits is
the nearest one inside, and a deviation beyond 64 bits is null; components of no variance,
by the accuracy of double precision, are not returned, so constant data and empty tables
give no rows; repeated rows and ids give rows each; of the input only the key is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrail.llm.encoding import column_of
from geotrail.scratch import publish_with_facts

SCALE = 256
FAN = 32
"""Matrices that one task adds up."""
ROUNDS = 30


@dataclass(frozen=True)
class Whitening:
    """A fitted model: what a row needs to be whitened."""

    dim: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    """Unit eigenvectors as columns, by falling eigenvalue."""
    values: np.ndarray
    trace: float
    identity_error: float | None


# ---- eigenvectors -----------------------------------------------------------------


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Positions of eigenvalues that follow each other within ``width``, where there are several."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refine_eigenvectors(matrix: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, from rough eigenvectors."""
    a, x = matrix.astype(np.longdouble), start.astype(np.longdouble)
    eye = np.eye(len(a), dtype=np.longdouble)
    size = np.sqrt((a * a).sum())
    solved: set[tuple[int, ...]] = set()
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        width = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > width
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ step
        turned = 0.0
        for cluster in _clusters(values, width):
            block = x[:, cluster]
            middle = values[cluster].mean()
            # the block without its mean: what is left is as small as the cluster is wide
            inner = block.T @ (a @ block - middle * block)
            _, turn = np.linalg.eigh(((inner + inner.T) / 2).astype(np.float64))
            member = tuple(sorted(cluster.tolist()))
            spread = np.abs(inner - np.diag(np.diag(inner))).max()
            if spread > np.finfo(np.longdouble).eps * 8 * size or member not in solved:
                x[:, cluster] = block @ turn.astype(np.longdouble)
                solved.add(member)
                turned = max(turned, float(spread / size)) if size else 0.0
        if np.abs(step).max() <= np.finfo(np.float64).eps / 8 and turned <= np.finfo(np.float64).eps ** 1.1:
            break
    # rotations of clusters end in double precision; one more pass makes columns orthonormal again
    x = x + x @ ((eye - x.T @ x) / 2)
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix to double precision.

    The largest entry of each vector is positive.
    """
    size = np.abs(matrix).max() if len(matrix) else 0.0
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    scaled = matrix / size
    _, rough = np.linalg.eigh(scaled.astype(np.float32))
    values, vectors = refine_eigenvectors(scaled, rough)
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(matrix))])
    return (values * size).astype(np.float64), (vectors * sign).astype(np.float64)


# ---- rows -------------------------------------------------------------------------


def whole_vectors(rows: DataFrame, vector: str, *keep: Column | str) -> DataFrame:
    """The rows that take part, with ``x``: their vectors in units of 1/256, rounded down."""
    kept = rows.select(*keep, F.col(vector).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform("_v", lambda c: F.floor(c * SCALE))
    return kept.where("_v IS NOT NULL AND size(_v) > 0").where(finite).withColumn("x", whole).drop("_v")


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return column_of(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _exact_sum(x: np.ndarray) -> list[int]:
    if not len(x):
        return [0] * x.shape[1]
    bound = max(abs(int(x.min())), abs(int(x.max())))
    return x.sum(0).tolist() if bound * len(x) < 1 << 62 else x.astype(object).sum(0).tolist()


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit numbers where they and the sum of their squares fit, else Python's."""
    bound = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums) if len(x) else 0
    if bound * bound * x.shape[1] < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def sum_matrices(parts: DataFrame) -> np.ndarray | None:
    """Adds up rows (part, m), m a binary of doubles, a few at a time, until one is left."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m, np.float64) for m in group.sort_values("part")["m"])
        return pd.DataFrame({"part": [group["part"].min() // FAN], "m": [total.tobytes()]})

    while True:
        parts, facts = publish_with_facts(parts, "matrices", F.count(F.lit(1)).alias("n"), F.max("part").alias("last"))
        if not facts["n"]:
            return None
        if facts["n"] == 1:
            return np.frombuffer(parts.first()["m"], np.float64)
        parts = parts.withColumn("_group", F.expr(f"part div {FAN}")).groupBy("_group").applyInPandas(add, "part long, m binary")


def _gram(fit: DataFrame, dim: int, n: int, sums: list[int], project: np.ndarray | None) -> np.ndarray:
    """Sum over the rows of the outer product of the centred, and possibly projected, vector with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            if batch.num_rows:
                part = int(column_of(batch, "part")[0].as_py())
                centred = _scaled(_matrix(batch, dim), n, sums).astype(np.float64) / n
                centred = centred if project is None else centred @ project
                own = centred.T @ centred
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])

    numbered = fit.select("x", F.spark_partition_id().cast("long").alias("part"))
    total = sum_matrices(numbered.mapInArrow(run, "part long, m binary"))
    side = dim if project is None else project.shape[1]
    return total.reshape(side, side)


def fit_whitening(rows: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening | None:
    """Learns from every distinct whole vector; null if no row takes part.

    ``identity_error`` is measured on ``components`` components.
    """
    whole = whole_vectors(rows, vector)
    lengths = whole.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return None
    dim = common["dim"]
    fit, facts = publish_with_facts(whole.where(F.size("x") == dim).distinct(), "whole-vectors", F.count(F.lit(1)).alias("n"))
    n = facts["n"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for batch in batches:
            total = [a + b for a, b in zip(total, _exact_sum(_matrix(batch, dim)), strict=True)]
        # the lower 32 bits and the rest apart: sums of either stay in 64 bits
        yield pa.RecordBatch.from_arrays([pa.array(list(range(dim))), pa.array([t >> 32 for t in total]), pa.array([t & 0xFFFFFFFF for t in total])], names=["d", "high", "low"])

    parts = fit.mapInArrow(add, "d long, high long, low long").groupBy("d").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums = [0] * dim
    for d, high, low in parts.collect():
        sums[d] = (high << 32) + low
    covariance = _gram(fit, dim, n, sums, None) / n
    values, vectors = eigenvectors((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    held = int((values > dim * np.finfo(np.float64).eps * trace).sum())
    values, vectors, k = values[:held], vectors[:, :held], min(components, held)
    error = None
    if k:
        found = _gram(fit, dim, n, sums, vectors[:, :k] / np.sqrt(values[:k])) / n
        error = float(np.abs(found - np.eye(k)).max())
    return Whitening(dim, n, sums, vectors, values, trace, error)


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    whole = whole_vectors(rows, vector, F.col(key).alias("key"))
    kind = whole.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = min(components, len(model.values)) if model else 0
    if not k:
        return whole.where("false").mapInArrow(lambda batches: iter(()), schema).withColumnRenamed("key", key)
    dim, n, sums = model.dim, model.n, model.sums
    project = model.vectors[:, :k] / np.sqrt(model.values[:k])
    explained, error = model.values[:k] / model.trace, model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scaled = _scaled(_matrix(batch, dim), n, sums)
            squares = (scaled * scaled).sum(1)
            if squares.dtype == object:
                squares = [d if d < 1 << 63 else None for d in squares]
            count = batch.num_rows * k
            columns = [
                column_of(batch, "key").take(pa.array(np.repeat(np.arange(batch.num_rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(count, n)),
                pa.array([d for d in squares for _ in range(k)] if isinstance(squares, list) else np.repeat(squares, k), pa.int64()),
                pa.array((scaled.astype(np.float64) / n @ project).ravel()),
                pa.array(np.tile(explained, batch.num_rows)),
                pa.array(np.full(count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return whole.where(F.size("x") == dim).mapInArrow(run, schema).withColumnRenamed("key", key)
