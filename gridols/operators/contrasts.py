"""Inference on contrasts of a fit: T contrasts give con, se, t and -log10 p; F contrasts F, -log10 p and partial R2."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridols.functions.special import f_sf, minus_log10, t_sf
from gridols.operators.fit import lists, stacked
from gridols.spec import Model

T = "con array<double>, con_se array<double>, con_t array<double>, con_t_lp array<double>"
FS = "con_f array<double>, con_f_lp array<double>, con_r2 array<double>"


def covariance(p: int, i: int, j: int) -> Column:
    """Covariance of two estimates; in maps its volume is i * p + j."""
    return F.col("resms") * F.col("inverse")[i * p + j]


def infer(fitted: DataFrame, model: Model, key: str = "cell") -> DataFrame:
    """The fit with arrays of T results in the order of the T contrasts and of F results in that of the F contrasts."""
    p = model.p
    names = fitted.columns
    at = {c: names.index(c) for c in ("n", "beta", "resms", "inverse")}

    def run(batches):
        for b in batches:
            n, resms = b.column(at["n"]).to_numpy().astype(float), b.column(at["resms"]).to_numpy(zero_copy_only=False)
            beta, inverse = stacked(b.column(at["beta"]), p), stacked(b.column(at["inverse"]), p, p)
            df = n - p
            t, f = t_results(model, beta, inverse, resms, df), f_results(model, beta, inverse, resms, df)
            yield pa.RecordBatch.from_arrays([*b.columns, *(lists(v) for v in (*t, *f))], [*names, "con", "con_se", "con_t", "con_t_lp", "con_f", "con_f_lp", "con_r2"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fitted.schema)
    return fitted.mapInArrow(run, f"{ddl}, {T}, {FS}")


def t_results(model: Model, beta, inverse, resms, df):
    v = len(beta)
    m = np.array([c.rows[0] for c in model.t]).reshape(-1, model.p)
    con = beta @ m.T
    with np.errstate(divide="ignore", invalid="ignore"):
        se = np.sqrt(np.einsum("ci,vij,cj->vc", m, inverse, m) * resms[:, None])
        t = con / se
    lp = minus_log10(t_sf(t, np.repeat(df[:, None], t.shape[1], axis=1)), model.min_log) if t.size else np.zeros((v, 0))
    return con, se, t, np.where(np.isnan(t), 0.0, lp)


def f_results(model: Model, beta, inverse, resms, df):
    out = [np.full((len(beta), len(model.f)), np.nan) for _ in range(3)]
    for k, c in enumerate(model.f):
        q, con = len(c.rows), beta @ c.matrix.T
        spread = np.einsum("ai,vij,bj->vab", c.matrix, inverse, c.matrix)
        ok = np.isfinite(spread).all(axis=(1, 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.full(len(beta), np.nan)
            f[ok] = np.einsum("va,va->v", con[ok], np.linalg.solve(spread[ok], con[ok][..., None])[..., 0]) / (q * resms[ok])
            out[0][:, k], out[1][:, k], out[2][:, k] = f, minus_log10(f_sf(f, q, df), model.min_log), q * f / (q * f + df)
    return out
