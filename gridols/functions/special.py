"""Upper tails of the t and F distributions, from the regularised incomplete beta function (continued fraction)."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _fraction(x, a, b, turns: int = 2000):
    """Lentz's method for the continued fraction of the incomplete beta function; converges for x below (a+1)/(a+b+2)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, turns):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
        if np.all(np.abs(delta - 1) < 1e-16):
            break
    return h


def beta_inc(x, a, b, y=None):
    """I_x(a, b); y is 1 - x where the caller knows it more exactly."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    y = 1 - x if y is None else np.broadcast_to(np.asarray(y, float), x.shape)
    out = np.full(x.shape, np.nan)
    out[x <= 0], out[x >= 1] = 0.0, 1.0
    ok = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    xs, ys, as_, bs = x[ok], y[ok], a[ok], b[ok]
    if len(xs):
        swap = xs > (as_ + 1) / (as_ + bs + 2)
        u, v, p, q = np.where(swap, ys, xs), np.where(swap, xs, ys), np.where(swap, bs, as_), np.where(swap, as_, bs)
        with np.errstate(under="ignore", divide="ignore"):
            front = np.exp(p * np.log(u) + q * np.log(v) - (_lgamma(p) + _lgamma(q) - _lgamma(p + q))) / p
            value = front * _fraction(u, p, q)
        out[ok] = np.where(swap, 1 - value, value)
    return out


def t_sf(t, df):
    """P(T > t)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(over="ignore", invalid="ignore"):
        t2 = t * t
        x = np.where(np.isinf(t2), 0.0, df / (df + t2))
        half = beta_inc(x, df / 2, 0.5, np.where(np.isinf(t2), 1.0, t2 / (df + t2))) / 2
    return np.where(np.isnan(t), np.nan, np.where(t >= 0, half, 1 - half))


def f_sf(f, q, df):
    """P(F > f)."""
    f, q, df = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, q, df)))
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.where(np.isinf(f), 0.0, df / (df + q * f))
        tail = beta_inc(x, df / 2, q / 2, np.where(np.isinf(f), 1.0, q * f / (df + q * f)))
    return np.where(np.isnan(f), np.nan, np.where(f <= 0, 1.0, tail))


def minus_log10(p, min_log: float):
    """-log10 p; p = 0 gives +inf, and only -inf is replaced."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -np.log10(p)
    return np.where(np.isneginf(out), min_log, out)
