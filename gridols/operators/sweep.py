"""Least squares by the sweep operator, in column expressions alone: no Python worker, any number of regressors.

The matrix [X'X X'y; y'X y'y] of a cell is held as columns of its upper triangle. Sweeping on regressor k replaces it by that of
the regression on the regressors so far; after the last one the corner is the residual sum of squares, the border the
estimates, and the block minus the inverse. A regressor whose pivot is at most ``TOLERANCE`` of what it was is a combination of
those before: it is passed over, and does not count in the rank. Pivots are compared with their own beginnings, so the
scales of the regressors do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridols.operators.fit import LOG_2PI
from gridols.spec import Model

TOLERANCE = 1e-11


def swept(forms: DataFrame, p: int, key: str = "cell") -> DataFrame:
    """One row a cell, as ``fit`` gives it, and log_det, the logarithm of the determinant of X'X; low rank gives NaN estimates."""
    at = lambda i, j: f"s_{min(i, j)}_{max(i, j)}"
    places = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    kept, told = [key, "n", "n_rows"], [f"o_{i}" for i in range(p)]
    source = lambda i, j: f"xtx[{i * p + j}]" if j < p else f"xty[{i}]" if i < p else "yty"
    step = forms.selectExpr(*kept, *(f"{source(i, j)} AS {at(i, j)}" for i, j in places), *(f"xtx[{i * p + i}] AS o_{i}" for i in range(p)))
    for k in range(p):
        d = at(k, k)
        fine = f"{d} > o_{k} * {TOLERANCE} AND NOT isnan({d}) AND o_{k} > 0 AND o_{k} < double('Infinity')"
        # the partition's number keeps Catalyst from writing a step's columns out within the next one's, or in a condition on the result
        step = step.selectExpr("*", f"CASE WHEN {fine} THEN 1 / {d} ELSE 0D END + spark_partition_id() * 0D AS over", f"CASE WHEN {fine} THEN ln({d}) END AS l_{k}")
        told.append(f"l_{k}")
        new = [f"{f'-over' if i == j == k else f'{at(i, j)} * over' if k in (i, j) else f'{at(i, j)} - {at(i, k)} * {at(k, j)} * over'} AS {at(i, j)}" for i, j in places]
        step = step.selectExpr(*kept, *told, *new)
    rank = sum((F.col(f"l_{k}").isNotNull().cast("int") for k in range(1, p)), F.col("l_0").isNotNull().cast("int"))
    full = lambda c: F.when(F.col("rank") == p, c).otherwise(float("nan"))
    out = step.select("*", rank.alias("rank")).select(
        *kept, "rank", F.array(*(full(F.col(at(i, p))) for i in range(p))).alias("beta"), full(F.col(at(p, p))).alias("rss"),
        F.array(*(full(-F.col(at(i, j))) for i in range(p) for j in range(p))).alias("inverse"), full(sum((F.col(f"l_{k}") for k in range(1, p)), F.col("l_0"))).alias("log_det"),
    )
    n, sigma2 = F.col("n"), F.try_divide("rss", "n")
    more = out.select("*", F.try_divide("rss", n - p).alias("resms"), sigma2.alias("sigma2"))
    logs = F.when(F.col("sigma2") > 0, F.log("sigma2")).when(F.col("sigma2") == 0, -float("inf")).otherwise(float("nan"))
    return more.select(*kept, "rank", "beta", "rss", "resms", "sigma2", (-0.5 * n * (logs + LOG_2PI + 1)).alias("llh"), "inverse", "log_det")


def total(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def t_statistics(fitted: DataFrame, model: Model) -> DataFrame:
    """The fit with arrays con, con_se and con_t of the T contrasts, as column expressions."""
    p, con, se = model.p, [], []
    for c in model.t:
        (row,) = c.rows
        live = [i for i in range(p) if row[i]]
        con.append(total([F.col("beta")[i] * row[i] for i in live] or [F.lit(0.0)]))
        spread = total([F.col("inverse")[i * p + j] * (row[i] * row[j]) for i in live for j in live] or [F.lit(0.0)])
        se.append(F.sqrt(spread * F.col("resms")))
    both = fitted.select("*", F.array(*con).alias("con"), F.array(*se).alias("con_se"))
    return both.select("*", F.zip_with("con", "con_se", F.try_divide).alias("con_t"))
