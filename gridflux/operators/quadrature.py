"""Quadrature of column-valued functions over tables of problems.

A rule is a table of (node, weight) on a reference interval. `integrate` spreads each problem row over the nodes, evaluates
the integrand once per node inside codegen, and sums per problem; nodes are a literal array, so nothing is joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def newton_cotes_weights(n: int, closed: bool = True) -> tuple[list[float], list[float]]:
    """n intervals on [0, 1]: nodes and weights that integrate polynomials through the nodes."""
    x = np.linspace(0, 1, n + 1) if closed else np.arange(1, n + 2) / (n + 2)
    a = np.vander(x, increasing=True).T
    return x.tolist(), np.linalg.solve(a, 1 / np.arange(1, len(x) + 1)).tolist()


def composite(rule: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Composite rules on [0, 1]; n is rounded up to what the rule needs."""
    step = {"simpson": 2, "simpson38": 3, "boole": 4}.get(rule, 1)
    n = -(-n // step) * step
    if rule in ("left", "right", "midpoint"):
        off = {"left": 0.0, "right": 1.0, "midpoint": 0.5}[rule]
        return (np.arange(n) + off) / n, np.full(n, 1 / n)
    x = np.linspace(0, 1, n + 1)
    w = np.zeros(n + 1)
    block = {"trapezoid": (0.5, 0.5), "simpson": (1 / 3, 4 / 3, 1 / 3), "simpson38": (3 / 8, 9 / 8, 9 / 8, 3 / 8), "boole": (14 / 45, 64 / 45, 24 / 45, 64 / 45, 14 / 45)}[rule]
    for at in range(0, n, len(block) - 1):
        w[at : at + len(block)] += block
    return x, w / n


def golub_welsch(diag: np.ndarray, off: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """Gauss nodes and weights from the recurrence's Jacobi matrix."""
    x, v = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    return x, mass * v[0] ** 2


def gauss(kind: str, n: int, alpha: float = 0.0, beta: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """legendre [-1,1], chebyshev (kinds by alpha 1, 2), hermite, laguerre (alpha), jacobi (alpha, beta)."""
    k = np.arange(1, n, dtype=float)
    if kind == "legendre":
        return golub_welsch(np.zeros(n), k / np.sqrt(4 * k * k - 1), 2.0)
    if kind == "hermite":
        return golub_welsch(np.zeros(n), np.sqrt(k / 2), math.sqrt(math.pi))
    if kind == "laguerre":
        return golub_welsch(2 * np.arange(n) + alpha + 1.0, np.sqrt(k * (k + alpha)), math.gamma(alpha + 1))
    if kind == "chebyshev":
        j = np.arange(1, n + 1)
        if alpha == 2:
            t = j * math.pi / (n + 1)
            return np.cos(t), math.pi / (n + 1) * np.sin(t) ** 2
        return np.cos((2 * j - 1) * math.pi / (2 * n)), np.full(n, math.pi / n)
    if kind == "jacobi":
        a, b, m = alpha, beta, np.arange(n, dtype=float)
        s = 2 * m + a + b
        with np.errstate(all="ignore"):
            diag = np.where(s * (s + 2) == 0, (b - a) / (a + b + 2), (b * b - a * a) / (s * (s + 2)))
        t = 2 * k + a + b
        with np.errstate(all="ignore"):
            off = np.sqrt(4 * k * (k + a) * (k + b) * (k + a + b) / (t * t * (t + 1) * (t - 1)))
        if n > 1:
            off[0] = math.sqrt(4 * (1 + a) * (1 + b) / ((2 + a + b) ** 2 * (3 + a + b)))
        mass = 2 ** (a + b + 1) * math.gamma(a + 1) * math.gamma(b + 1) / math.gamma(a + b + 2)
        return golub_welsch(diag, off, mass)
    raise ValueError(kind)


def gauss_fixed(n: int, ends: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss rules with fixed ends on [-1, 1]: 1 is Radau (left end), 2 Lobatto; inner nodes are Jacobi roots, weights match moments."""
    inner = gauss("jacobi", n - ends, 1.0 if ends == 2 else 0.0, 1.0)[0]
    x = np.concatenate(([-1.0], inner, [1.0] if ends == 2 else []))
    v = np.polynomial.legendre.legvander(x, n - 1).T
    return x, np.linalg.solve(v, np.concatenate(([2.0], np.zeros(n - 1))))


def clenshaw_curtis(n: int, fejer: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """On [-1, 1]: Chebyshev extrema (or Fejer's interior points) with weights that match Chebyshev moments."""
    if fejer == 1:
        t = (2 * np.arange(n) + 1) * math.pi / (2 * n)
    elif fejer == 2:
        t = np.arange(1, n + 1) * math.pi / (n + 1)
    else:
        t = np.arange(n + 1) * math.pi / n
    m = len(t)
    moments = np.array([0.0 if k % 2 else 2 / (1 - k * k) for k in range(m)])
    return np.cos(t), np.linalg.solve(np.cos(np.outer(np.arange(m), t)), moments)


def tanh_sinh(levels: int = 6, limit: float = 3.2) -> tuple[np.ndarray, np.ndarray]:
    h = 2.0**-levels * 4
    t = np.arange(-int(limit / h), int(limit / h) + 1) * h
    u = math.pi / 2 * np.sinh(t)
    return np.tanh(u), h * math.pi / 2 * np.cosh(t) / np.cosh(u) ** 2


def unit(rule: tuple) -> tuple[np.ndarray, np.ndarray]:
    """A rule of [-1, 1] moved to [0, 1]."""
    x, w = np.asarray(rule[0]), np.asarray(rule[1])
    return (x + 1) / 2, w / 2


def nodes(rule: tuple) -> Column:
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(*rule)))


def integrate(problems: DataFrame, f: Fn, a: Column, b: Column, rule: tuple, name: str = "integral") -> DataFrame:
    """problems plus the integral of f over [a, b] by a rule on [0, 1]; f may use the row's columns."""
    total = F.aggregate(F.transform(nodes(rule), lambda z: z["w"] * f(a + (b - a) * z["x"])), F.lit(0.0), lambda s, v: s + v)
    return problems.withColumn(name, total * (b - a))


def trapezoid_rule(problems: DataFrame, f: Fn, a: Column, b: Column, n: int = 100) -> DataFrame:
    return integrate(problems, f, a, b, composite("trapezoid", n))


def simpson_rule(problems: DataFrame, f: Fn, a: Column, b: Column, n: int = 100) -> DataFrame:
    return integrate(problems, f, a, b, composite("simpson", n))


def midpoint_rule(problems: DataFrame, f: Fn, a: Column, b: Column, n: int = 100) -> DataFrame:
    return integrate(problems, f, a, b, composite("midpoint", n))


def gauss_legendre(problems: DataFrame, f: Fn, a: Column, b: Column, n: int = 10) -> DataFrame:
    return integrate(problems, f, a, b, unit(gauss("legendre", n)))


def composite_gauss(problems: DataFrame, f: Fn, a: Column, b: Column, panels: int = 10, n: int = 5) -> DataFrame:
    x, w = unit(gauss("legendre", n))
    return integrate(problems, f, a, b, (np.concatenate([(x + k) / panels for k in range(panels)]), np.tile(w / panels, panels)))


def romberg(problems: DataFrame, f: Fn, a: Column, b: Column, levels: int = 6) -> DataFrame:
    """Richardson extrapolation is linear in the trapezoid sums, so a Romberg value is one rule with its own weights."""
    finest = 2 ** (levels - 1)
    rows = []
    for k in range(levels):
        w = np.zeros(finest + 1)
        w[:: finest // 2**k] = composite("trapezoid", 2**k)[1]
        rows.append(w)
    for j in range(1, levels):
        rows = [(4**j * q - p) / (4**j - 1) for p, q in zip(rows, rows[1:])]
    return integrate(problems, f, a, b, (np.linspace(0, 1, finest + 1), rows[0]))


def tensor_gauss(problems: DataFrame, f, lows: list[Column], highs: list[Column], n: int = 5, name: str = "integral") -> DataFrame:
    """f of a list of columns over a box: nested sums over the product of nodes."""
    rule, d = unit(gauss("legendre", n)), len(lows)

    def level(k: int, at: list[Column]) -> Column:
        if k == d:
            return f(at)
        inner = lambda z: z["w"] * level(k + 1, [*at, lows[k] + (highs[k] - lows[k]) * z["x"]])
        return (highs[k] - lows[k]) * F.aggregate(F.transform(nodes(rule), inner), F.lit(0.0), lambda s, v: s + v)

    return problems.withColumn(name, level(0, []))


def radical_inverse(i: Column, base: int, digits: int = 32) -> Column:
    """Van der Corput's sequence: the digits of i mirrored at the point."""
    digits = min(digits, int(62 / math.log2(base)))
    start = F.struct(i.cast("bigint").alias("n"), F.lit(0.0).alias("v"), F.lit(1.0).alias("s"))
    step = lambda a, _: F.struct(F.floor(a["n"] / base).cast("bigint").alias("n"), (a["v"] + F.pmod(a["n"], F.lit(base)) * a["s"] / base).alias("v"), (a["s"] / base).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda a: a["v"])


def primes(n: int) -> list[int]:
    out, k = [], 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def halton(spark, n: int, dim: int, skip: int = 0) -> DataFrame:
    return spark.range(n).select("id", *(radical_inverse(F.col("id") + skip, p).alias(f"x{k}") for k, p in enumerate(primes(dim))))


def quasi_monte_carlo(spark, f, lows: list[float], highs: list[float], n: int = 4096, skip: int = 1) -> DataFrame:
    pts = halton(spark, n, len(lows), skip)
    xs = [lo + (hi - lo) * F.col(f"x{k}") for k, (lo, hi) in enumerate(zip(lows, highs))]
    volume = math.prod(hi - lo for lo, hi in zip(lows, highs))
    return pts.agg((F.avg(f(xs)) * volume).alias("integral"))


def monte_carlo(spark, f, lows: list[float], highs: list[float], n: int = 100_000, seed: int = 0) -> DataFrame:
    """Hashed counters give the points, so that the value does not depend on partitions."""
    from gridflux.operators.stats import uniform_hash

    xs = [lo + (hi - lo) * uniform_hash(F.lit(seed), F.lit(k), F.col("id")) for k, (lo, hi) in enumerate(zip(lows, highs))]
    volume = math.prod(hi - lo for lo, hi in zip(lows, highs))
    v = f(xs)
    return spark.range(n).agg((F.avg(v) * volume).alias("integral"), (F.stddev_samp(v) * volume / math.sqrt(n)).alias("std_error"))
