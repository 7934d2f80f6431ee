"""Estimates by cell from product forms, in stacked linear algebra over Arrow batches; closed forms for p up to 3."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT = "n long, n_rows long, rank int, beta array<double>, rss double, resms double, sigma2 double, llh double, inverse array<double>"
LOG_2PI = 1.8378770664093453


def balanced(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(D A D, the diagonal of D) of stacked symmetric matrices, D chosen so that the diagonal of D A D is 1 where A's is not 0."""
    diagonal = np.einsum("vii->vi", a)
    d = 1 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    return a * d[:, :, None] * d[:, None, :], d


def inverse_and_log_det(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses and logarithms of determinants of stacked positive definite matrices, whatever the scales of their columns.

    A is D^-1 (D A D) D^-1, so its inverse is D (D A D)^-1 D, and its determinant that of D A D over the square of D's.
    """
    m, d = balanced(a)
    inverse = np.linalg.solve(m, np.broadcast_to(np.eye(a.shape[1]), a.shape)) * d[:, :, None] * d[:, None, :]
    return inverse, np.linalg.slogdet(m)[1] - 2 * np.log(d).sum(axis=1)


def solve(n: np.ndarray, xtx: np.ndarray, xty: np.ndarray, yty: np.ndarray):
    """rank, beta, rss, resms, sigma2, llh and (X'X)^-1 of stacked cells; cells of low rank get NaN."""
    p = xty.shape[1]
    finite = np.isfinite(xtx).all(axis=(1, 2))
    rank = np.zeros(len(n), np.int32)
    rank[finite] = np.linalg.matrix_rank(balanced(xtx[finite])[0])
    ok = np.flatnonzero(rank == p)
    beta, inverse = np.full((len(n), p), np.nan), np.full((len(n), p, p), np.nan)
    m, d = balanced(xtx[ok])
    beta[ok] = d * np.linalg.solve(m, (d * xty[ok])[..., None])[..., 0]
    inverse[ok] = inverse_and_log_det(xtx[ok])[0]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        rss = yty - np.einsum("vi,vij,vj->v", beta, xtx, beta)
        resms, sigma2 = rss / (n - p), rss / n
        llh = -0.5 * n * (np.log(sigma2) + LOG_2PI + 1)  # of a negative rss NaN, of zero +inf
    return rank, beta, rss, resms, sigma2, llh, inverse


def stacked(column: pa.Array, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)


def lists(values: np.ndarray) -> pa.ListArray:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(np.ascontiguousarray(flat).ravel()))


def fit(forms: DataFrame, p: int, key: str = "cell") -> DataFrame:
    """One row a cell: rank, beta, rss, resms, sigma2, llh, inverse. A cell of low rank keeps its row, with NaN estimates."""

    def run(batches):
        for b in batches:
            n = b.column(1).to_numpy().astype(float)
            out = solve(n, stacked(b.column(3), p, p), stacked(b.column(4), p), b.column(5).to_numpy())
            cols = [lists(v) if v.ndim > 1 else pa.array(v) for v in out]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], [key, "n", "n_rows", "rank", "beta", "rss", "resms", "sigma2", "llh", "inverse"])

    kind = forms.schema[key].dataType.simpleString()
    return forms.select(key, F.col("n").cast("long"), F.col("n_rows").cast("long"), "xtx", "xty", "yty").mapInArrow(run, f"{key} {kind}, {FIT}")


def inverses(forms: DataFrame, p: int, key: str = "cell") -> DataFrame:
    """(cell, inverse, log_det) of each cell's X'X; null where it has low rank."""

    def run(batches):
        for b in batches:
            xtx = stacked(b.column(1), p, p)
            ok = np.isfinite(xtx).all(axis=(1, 2))
            ok[ok] = np.linalg.matrix_rank(balanced(xtx[ok])[0]) == p
            inverse, log_det = np.zeros_like(xtx), np.zeros(len(xtx))
            inverse[ok], log_det[ok] = inverse_and_log_det(xtx[ok])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.ravel().tolist() if o else None for v, o in zip(inverse, ok)], pa.list_(pa.float64())), pa.array(log_det, mask=~ok)], [key, "inverse", "log_det"])

    return forms.select(key, "xtx").mapInArrow(run, f"{key} {forms.schema[key].dataType.simpleString()}, inverse array<double>, log_det double")


def full_rank(fitted: DataFrame, p: int) -> DataFrame:
    """Cells whose design has full rank; one with all its readings and a design of low rank is an error of the design."""
    low = (F.col("rank") < p) & (F.col("n") == F.col("n_rows"))
    checked = F.when(low, F.raise_error(F.lit("the columns of the design are linearly dependent"))).otherwise(F.col("rank") == p)
    return fitted.where(checked.cast("boolean"))


def low_rank_removed(counts: DataFrame, fitted: DataFrame, p: int) -> DataFrame:
    """(cell, n, edf, mask) with all three 0 where the observed part of the design has low rank."""
    low = fitted.where((F.col("rank") < p)).select("cell", F.lit(0).alias("ok"))
    keep = F.coalesce("ok", F.lit(1))
    return counts.join(low, "cell", "left").select("cell", (F.col("n") * keep).alias("n"), (F.col("edf") * keep).alias("edf"), (F.col("mask") * keep).alias("mask"))


def ring_or_inner() -> Column:
    """A cell is inner if every one of its observations is observed."""
    return F.when(F.col("n") == F.col("n_rows"), F.lit("inner")).otherwise(F.lit("ring"))


def closed_form(forms: DataFrame, p: int, key: str = "cell") -> DataFrame:
    """The same estimates for p up to 3 by cofactors, as column expressions alone; the caller sees to full rank."""
    if p > 3:
        raise ValueError("closed forms reach to p = 3")
    a = [[F.col("xtx")[i * p + j] for j in range(p)] for i in range(p)]
    minor = {1: lambda i, j: F.lit(1.0), 2: lambda i, j: a[1 - i][1 - j], 3: lambda i, j: a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]}[p]
    sign = lambda i, j: -1.0 if p == 2 and i != j else 1.0  # noqa: E731  (cyclic minors of p = 3 carry their sign)
    cof = [[minor(i, j) * F.lit(sign(i, j)) for j in range(p)] for i in range(p)]
    det = sum((a[0][j] * cof[0][j] for j in range(1, p)), a[0][0] * cof[0][0])
    step = forms.withColumn("det", det).withColumn("inverse", F.array(*(F.try_divide(cof[j][i], F.col("det")) for i in range(p) for j in range(p))))
    beta = F.array(*(sum((F.col("inverse")[i * p + j] * F.col("xty")[j] for j in range(1, p)), F.col("inverse")[i * p] * F.col("xty")[0]) for i in range(p)))
    step = step.withColumn("beta", beta)
    rss = F.col("yty") - sum((F.col("beta")[i] * F.col("xty")[i] for i in range(1, p)), F.col("beta")[0] * F.col("xty")[0])
    return step.withColumn("rss", rss).select(key, "n", "n_rows", "beta", "rss", F.try_divide("rss", F.col("n") - p).alias("resms"), F.try_divide("rss", "n").alias("sigma2"), "inverse")
