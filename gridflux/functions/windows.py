"""Taper windows as expressions of the sample number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bessel_i0_series(x: Column, terms: int = 40) -> Column:
    """Modified Bessel function of order 0 by its power series, in Horner form; for arguments up to about 30."""
    q = x * x / 4
    out = F.lit(1.0)
    for k in range(terms, 0, -1):
        out = 1 + q / float(k * k) * out
    return out


def _i0(x: float) -> float:
    out, term = 1.0, 1.0
    for k in range(1, 200):
        term *= (x / 2) ** 2 / k**2
        out += term
        if term < 1e-17 * out:
            break
    return out


def window_value(kind: str, k: Column, n: int, sym: bool = True, beta: float = 14.0, alpha: float = 0.5) -> Column:
    """Value k of n of a window; sym=False gives the periodic form used for spectra."""
    m = n - 1 if sym else n
    if m < 1 or n == 1:
        return F.lit(1.0)
    t = 2 * math.pi * k / m
    x = 2 * k / m - 1
    cosines = {
        "hann": (0.5, 0.5), "hanning": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
        "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168), "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
    }
    if kind in cosines:
        terms = [(-1) ** j * a * F.cos(j * t) if j else F.lit(a) for j, a in enumerate(cosines[kind])]
        return sum(terms[1:], terms[0])
    if kind in ("boxcar", "rectangular", "rect", "none"):
        return F.lit(1.0)
    if kind in ("bartlett", "triangular"):
        return 1 - F.abs(x)
    if kind == "welch":
        return 1 - x * x
    if kind in ("cosine", "sine"):
        return F.sin(math.pi * (k + 0.5) / n)
    if kind == "gaussian":
        return F.exp(-0.5 * (x / alpha) * (x / alpha))
    if kind == "kaiser":
        return bessel_i0_series(beta * F.sqrt(F.greatest(1 - x * x, F.lit(0.0)))) / _i0(beta)
    if kind == "tukey":
        edge = alpha / 2
        u = k / m
        return F.when(u < edge, 0.5 * (1 + F.cos(math.pi * (u / edge - 1)))).when(u > 1 - edge, 0.5 * (1 + F.cos(math.pi * ((u - 1) / edge + 1)))).otherwise(1.0)
    raise ValueError(f"unknown window {kind}")
