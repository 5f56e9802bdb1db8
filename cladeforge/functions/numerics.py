"""Distribution functions and one-dimensional optimisation in numpy, vectorised where a column may pass through."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def gammainc(a: float, x: np.ndarray | float) -> np.ndarray:
    """The regularised lower incomplete gamma function."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.zeros_like(x)
    scale = lambda v: np.exp(-v + a * np.log(v) - math.lgamma(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        v = x[low]
        term = total = np.full_like(v, 1 / a)
        for n in range(1, 500):
            term = term * v / (a + n)
            total = total + term
            if (np.abs(term) < 1e-16 * np.abs(total)).all():
                break
        out[low] = total * scale(v)
    high = x >= a + 1
    if high.any():
        v = x[high]
        b = v + 1 - a
        c, d = np.full_like(v, 1e300), 1 / b
        h = d
        for n in range(1, 500):
            an = -n * (n - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = 1 - scale(v) * h
    return out


def chi2_sf(x: np.ndarray | float, df: float) -> np.ndarray:
    return 1 - gammainc(df / 2, np.asarray(x, float) / 2)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def inverse(f: Callable[[float], float], target: float, lo: float, hi: float, steps: int = 200) -> float:
    """x in [lo, hi] with f(x) = target, f rising: by bisection."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return (lo + hi) / 2


def norm_ppf(p: float) -> float:
    return inverse(norm_cdf, p, -40.0, 40.0)


def gamma_ppf(p: float, shape: float, rate: float) -> float:
    top = 1.0
    while gammainc(shape, rate * top)[0] < p:
        top *= 2
    return inverse(lambda x: float(gammainc(shape, rate * x)[0]), p, 0.0, top)


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return float(sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)))


def gamma_rates(shape: float, k: int, median: bool = False) -> np.ndarray:
    """Rates of k equally likely classes of a gamma distribution with mean 1: class means, or medians scaled to mean 1."""
    if median:
        r = np.array([gamma_ppf((2 * i + 1) / (2 * k), shape, shape) for i in range(k)])
        return r / r.mean()
    cut = np.array([0.0, *(gamma_ppf(i / k, shape, shape) for i in range(1, k)), np.inf])
    part = np.where(np.isinf(cut), 1.0, gammainc(shape + 1, np.where(np.isinf(cut), 1.0, cut) * shape))
    return np.diff(part) * k


def minimise(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-8) -> tuple[float, float]:
    """The smallest value of a one-dimensional function on [lo, hi]: golden section with parabolic steps (Brent)."""
    g = (3 - math.sqrt(5)) / 2
    x = w = v = lo + g * (hi - lo)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(200):
        m, t = (lo + hi) / 2, tol * abs(x) + 1e-12
        if abs(x - m) <= 2 * t - (hi - lo) / 2:
            break
        p = q = 0.0
        if abs(e) > t:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
        if q and abs(p) < abs(q * e / 2) and q * (lo - x) < p < q * (hi - x):
            e, d = d, p / q
        else:
            e = (hi - x) if x < m else (lo - x)
            d = g * e
        u = x + (d if abs(d) >= t else math.copysign(t, d))
        fu = f(u)
        if fu <= fx:
            lo, hi = (x, hi) if u >= x else (lo, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            lo, hi = (u, hi) if u < x else (lo, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx
