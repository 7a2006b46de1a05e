"""Adaptive and random quadrature over tables of problems."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.operators.stats import uniform_hash

Fn = Callable[[Column], Column]
Rule = Callable[[Callable, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@cache
def _pair(n: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gauss nodes and weights of n and 2n + 1 points."""
    return *np.polynomial.legendre.leggauss(n), *np.polynomial.legendre.leggauss(2 * n + 1)


def _gauss(f, p, a, b):
    x, w, y, v = _pair()
    mid, half = ((a + b) / 2)[:, None], ((b - a) / 2)[:, None]
    rough, fine = (f(p[:, None], mid + half * x) @ w) * half[:, 0], (f(p[:, None], mid + half * y) @ v) * half[:, 0]
    return fine, np.abs(fine - rough)


def _halved(weights: np.ndarray, order: int) -> Rule:
    """An even rule against itself on both halves, with the difference spent on one more order."""
    n = len(weights) - 1
    twice = np.r_[weights, np.zeros(n)] / 2 + np.r_[np.zeros(n), weights] / 2

    def rule(f, p, a, b):
        y = f(p[:, None], a[:, None] + (b - a)[:, None] * np.linspace(0, 1, 2 * n + 1))
        whole, halves = (y[:, ::2] @ weights) * (b - a), (y @ twice) * (b - a)
        step = (halves - whole) / (2**order - 1)
        return halves + step, np.abs(step)

    return rule


RULES: dict[str, Rule] = {"gauss": _gauss, "simpson": _halved(np.array([1, 4, 1]) / 6, 4), "trapezoid": _halved(np.array([1, 1]) / 2, 2)}


def adaptive(f: Callable, p: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str = "gauss", tol: float = 1e-10, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(integral, error, converged) of f(p, x) from a to b for arrays of problems. All intervals that miss their share of the tolerance are halved at once; a problem ends when its errors together meet the tolerance."""
    n, at, lo, hi, share = len(a), np.arange(len(a)), a.astype(float), b.astype(float), np.full(len(a), float(tol))
    total, error = np.zeros(n), np.zeros(n)
    for left in range(rounds, -1, -1):
        value, miss = RULES[rule](f, p[at], lo, hi)
        sums, misses = total + np.bincount(at, value, n), error + np.bincount(at, miss, n)
        scale = np.maximum(1.0, np.abs(sums))
        met = misses <= tol * scale
        good = met[at] | (miss <= share * scale[at]) | (left == 0)
        total += np.bincount(at[good], value[good], n)
        error += np.bincount(at[good], miss[good], n)
        at, lo, hi, share = at[~good], lo[~good], hi[~good], share[~good] / 2
        if not len(at):
            break
        mid = (lo + hi) / 2
        at, lo, hi, share = np.r_[at, at], np.r_[lo, mid], np.r_[mid, hi], np.r_[share, share]
    return total, error, error <= tol * np.maximum(1.0, np.abs(total))


def quad(f: Callable, p: np.ndarray, a: float, b: float, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Limits may be infinite: x = t / (1 - t * t) over the line, x = a + t / (1 - t) or b - t / (1 - t) over a half of it."""
    n, one = len(p), np.ones(len(p))
    if math.isinf(a) and math.isinf(b):
        return adaptive(lambda q, t: f(q, t / (1 - t * t)) * (1 + t * t) / (1 - t * t) ** 2, p, -one, one, tol=tol)
    if math.isinf(a) or math.isinf(b):
        end, sign = (a, 1.0) if math.isinf(b) else (b, -1.0)
        return adaptive(lambda q, t: f(q, end + sign * t / (1 - t)) / (1 - t) ** 2, p, np.zeros(n), one, tol=tol)
    return adaptive(f, p, a * one, b * one, tol=tol)


def _mean(v: Column, n: int, scale: float) -> list[Column]:
    return [(F.avg(v) * scale).alias("integral"), (F.stddev_samp(v) * abs(scale) / math.sqrt(n)).alias("std_error")]


def stratified(spark: SparkSession, f: Fn, a: float, b: float, n: int = 10_000, strata: int = 100, seed: int = 0) -> DataFrame:
    """n // strata points, two at least, in each of equal parts."""
    each = max(2, n // strata)
    s, width = F.floor(F.col("id") / each), (b - a) / strata
    rows = spark.range(strata * each).select(s.alias("s"), f(a + (s + uniform_hash(F.lit(seed), F.col("id"))) * width).alias("v"))
    parts = rows.groupBy("s").agg(F.avg("v").alias("m"), F.var_samp("v").alias("q"))
    return parts.agg((F.sum("m") * width).alias("integral"), (F.sqrt(F.sum("q") / each) * abs(width)).alias("std_error"))


def antithetic(spark: SparkSession, f: Fn, a: float, b: float, n: int = 100_000, seed: int = 0) -> DataFrame:
    """Each point meets its mirror image."""
    u, half = uniform_hash(F.lit(seed), F.col("id")), max(2, n // 2)
    return spark.range(half).agg(*_mean((f(a + (b - a) * u) + f(b - (b - a) * u)) / 2, half, b - a))


def control_variates(spark: SparkSession, f: Fn, g: Fn, mean: float, a: float, b: float, n: int = 100_000, seed: int = 0) -> DataFrame:
    """g has the known mean over [a, b]; its slope against f comes from the same points."""
    x = a + (b - a) * uniform_hash(F.lit(seed), F.col("id"))
    fit = spark.range(n).select(f(x).alias("f"), g(x).alias("g"))
    got = fit.agg(F.avg("f").alias("f"), F.avg("g").alias("g"), F.covar_samp("f", "g").alias("c"), F.var_samp("g").alias("v"), F.var_samp("f").alias("w"))
    slope = F.when(F.col("v") > 0, F.col("c") / F.nullif(F.col("v"), F.lit(0.0))).otherwise(0.0)
    return got.select(((F.col("f") - slope * (F.col("g") - mean)) * (b - a)).alias("integral"), (F.sqrt(F.greatest(F.col("w") - slope * F.col("c"), F.lit(0.0)) / n) * abs(b - a)).alias("std_error"))


def importance(spark: SparkSession, f: Fn, inverse: Fn, density: Fn, n: int = 100_000, seed: int = 0) -> DataFrame:
    """Points are the inverse distribution at uniform numbers; values are weighted by the density."""
    x = inverse(uniform_hash(F.lit(seed), F.col("id")))
    return spark.range(n).agg(*_mean(f(x) / density(x), n, 1.0))


def hit_or_miss(spark: SparkSession, f: Fn, a: float, b: float, top: float, n: int = 100_000, seed: int = 0) -> DataFrame:
    """Share of points of a box that lie under the curve, 0 <= f <= top."""
    u, v = (uniform_hash(F.lit(seed), F.lit(k), F.col("id")) for k in (0, 1))
    return spark.range(n).agg(*_mean((v * top <= f(a + (b - a) * u)).cast("double"), n, (b - a) * top))
