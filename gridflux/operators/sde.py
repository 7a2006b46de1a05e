"""Stochastic differential equations over a table of paths.

A path is a row. Its steps are folded within the row by `aggregate`, so that neither a shuffle nor Python is needed, and its
increments come from a hash of (seed, path, step): a lost executor's paths come out the same again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridflux.operators.stats import uniform_hash

Fn = Callable[[Column], Column]
#: (path, step) -> standard normal or other increment of unit variance
Noise = Callable[[Column, Column], Column]


def normal(seed: int = 0, stream: int = 0) -> Noise:
    """Box-Muller on two hashes; the first is kept off zero."""

    def draw(path: Column, k: Column) -> Column:
        u, v = (uniform_hash(F.lit(seed), F.lit(stream + j), path, k.cast("bigint")) for j in (0, 1))
        return F.sqrt(-2 * F.log1p(-u)) * F.cos(2 * math.pi * v)

    return draw


def _slope(b: Fn, x: Column) -> Column:
    h = 1e-5 * F.greatest(F.abs(x), F.lit(1.0))
    return (b(x + h) - b(x - h)) / (2 * h)


def _euler(x, a, b, h, w, db):
    return x + a(x) * h + b(x) * w


def _milstein(x, a, b, h, w, db):
    return x + a(x) * h + b(x) * w + 0.5 * b(x) * db(x) * (w * w - h)


def _heun(x, a, b, h, w, db):
    """Converges to the Stratonovich solution."""
    y = x + a(x) * h + b(x) * w
    return x + 0.5 * (a(x) + a(y)) * h + 0.5 * (b(x) + b(y)) * w


def _platen(x, a, b, h, w, db):
    """Strong order one without a derivative of b."""
    y = x + a(x) * h + b(x) * math.sqrt(h)
    return x + a(x) * h + b(x) * w + (b(y) - b(x)) * (w * w - h) / (2 * math.sqrt(h))


def _tamed(x, a, b, h, w, db):
    return x + a(x) * h / (1 + h * F.abs(a(x))) + b(x) * w


def _implicit_milstein(x, a, b, h, w, db, theta=0.5, rounds=3):
    """Drift taken half at the end of the step, by Newton's method from the explicit step."""
    known = x + (1 - theta) * a(x) * h + b(x) * w + 0.5 * b(x) * db(x) * (w * w - h)
    start = F.struct(_milstein(x, a, b, h, w, db).cast("double").alias("y"), known.cast("double").alias("known"))

    def newton(s, _):
        y = s["y"]
        return F.struct((y - (y - s["known"] - theta * h * a(y)) / (1 - theta * h * _slope(a, y))).cast("double").alias("y"), s["known"].alias("known"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, newton)["y"]


STEPS = {"euler_maruyama": _euler, "milstein": _milstein, "stochastic_heun": _heun, "stochastic_rk": _platen, "tamed_euler": _tamed, "implicit_milstein": _implicit_milstein}


def simulate(paths: DataFrame, path: str, x0: str, a: Fn, b: Fn, span: float, n: int, method: str = "euler_maruyama", db: Fn | None = None, noise: Noise | None = None, out: str = "x") -> DataFrame:
    """paths with the value after `span` in n steps. a and b are drift and diffusion as functions of the state; they may use the row's columns."""
    h, draw, step = span / n, noise or normal(), STEPS[method]
    slope = db or (lambda x: _slope(b, x))
    increments = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: math.sqrt(h) * draw(F.col(path), k))
    end = F.aggregate(increments, F.col(x0).cast("double"), lambda x, w: step(x, a, b, h, w, slope).cast("double"))
    return paths.withColumn(out, end)


def brownian_paths(paths: DataFrame, path: str, span: float, n: int, noise: Noise | None = None) -> DataFrame:
    """(path, k, t, w) for k = 0..n: running sums within a path."""
    h, draw = span / n, noise or normal()
    rows = paths.select(path, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    dw = F.when(F.col("k") == 0, 0.0).otherwise(math.sqrt(h) * draw(F.col(path), F.col("k") - 1))
    return rows.withColumn("dw", dw).select(path, "k", (F.col("k") * h).alias("t"), F.sum("dw").over(Window.partitionBy(path).orderBy("k")).alias("w"))


def brownian_bridges(paths: DataFrame, path: str, span: float, n: int, x0: float, x1: float, noise: Noise | None = None) -> DataFrame:
    """Brownian paths tied to x0 at the start and x1 at the end."""
    w = brownian_paths(paths, path, span, n, noise)
    last = F.max_by("w", "k").over(Window.partitionBy(path))
    return w.select(path, "k", "t", (x0 + F.col("w") + F.col("t") / span * (x1 - x0 - last)).alias("x"))


def geometric_brownian_motion(paths: DataFrame, path: str, x0: str, mu: float, sigma: float, span: float, n: int, noise: Noise | None = None) -> DataFrame:
    """(path, k, t, x) by the exact solution."""
    w = brownian_paths(paths, path, span, n, noise).join(paths.select(path, F.col(x0).alias("__x0")), path)
    return w.select(path, "k", "t", (F.col("__x0") * F.exp((mu - sigma * sigma / 2) * F.col("t") + sigma * F.col("w"))).alias("x"))


def ornstein_uhlenbeck(paths: DataFrame, path: str, x0: str, theta: float, mu: float, sigma: float, span: float, n: int, noise: Noise | None = None) -> DataFrame:
    """paths with x after `span`, by the exact step."""
    h, draw = span / n, noise or normal()
    keep, spread = math.exp(-theta * h), sigma * math.sqrt((1 - math.exp(-2 * theta * h)) / (2 * theta))
    return paths.withColumn("x", F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.col(x0).cast("double"), lambda x, k: mu + (x - mu) * keep + spread * draw(F.col(path), k)))


def cox_ingersoll_ross(paths: DataFrame, path: str, x0: str, theta: float, mu: float, sigma: float, span: float, n: int, noise: Noise | None = None) -> DataFrame:
    """Euler steps whose root takes the positive part, so that none fails; the value after `span` is not below zero."""
    got = simulate(paths, path, x0, lambda x: theta * (mu - F.greatest(x, F.lit(0.0))), lambda x: sigma * F.sqrt(F.greatest(x, F.lit(0.0))), span, n, noise=noise)
    return got.withColumn("x", F.greatest("x", F.lit(0.0)))


def poisson_process(paths: DataFrame, path: str, rate: float, span: float, seed: int = 0) -> DataFrame:
    """(path, k, t): event times of each path by exponential gaps. Blocks of gaps are added within a row until the span is passed."""
    block = max(16, int(rate * span + 6 * math.sqrt(rate * span)))

    def extend(s: Column, part: Column) -> Column:
        last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0))
        more = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: -F.log1p(-uniform_hash(F.lit(seed), F.col(path), part * block + i)) / rate)
        sums = F.aggregate(more, F.array(last), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g)))
        return F.when((F.size(s) > 0) & (last > span), s).otherwise(F.concat(s, F.slice(sums, 2, block)))

    times = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.array().cast("array<double>"), extend)
    return paths.select(path, F.posexplode(F.filter(times, lambda t: t <= span)).alias("k", "t"))


def strong_error(paths: DataFrame, approx: str, exact: str) -> DataFrame:
    return paths.agg(F.avg(F.abs(F.col(approx) - F.col(exact))).alias("error"))


def weak_error(paths: DataFrame, approx: str, g: Fn, mean: float) -> DataFrame:
    return paths.agg(F.abs(F.avg(g(F.col(approx))) - mean).alias("error"))
