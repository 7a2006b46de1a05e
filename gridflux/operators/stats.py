"""Descriptive and inferential statistics as grouped aggregates.

Every operator takes a DataFrame, the value columns and optional grouping keys; what reaches a reducer is sums, never
rows. Models are fitted from Gram sums, whose size is the square of the number of features.
"""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridflux.kernels.special import incomplete_beta, regularized_gamma_q

from gridflux.functions.ieee import NAN


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _spread(x: Column, ddof: int) -> Column:
    """Variance with ddof; NaN where there are too few values."""
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / F.greatest(n - ddof, F.lit(1))).otherwise(NAN if ddof else 0.0)


def variance(x, ddof: int = 0) -> Column:
    return _spread(_d(x), ddof)


def skewness(x, bias: bool = False) -> Column:
    """0 for constant samples; corrected for bias from three values on."""
    x, n = _d(x), F.count(_d(x)).cast("double")
    raw = F.when(F.var_pop(x) > 0, F.skewness(x)).otherwise(0.0)
    return raw if bias else F.when(n > 2, raw * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0))).otherwise(raw)


def kurtosis(x, excess: bool = True, bias: bool = False) -> Column:
    x, n = _d(x), F.count(_d(x)).cast("double")
    g2 = F.when(F.var_pop(x) > 0, F.kurtosis(x)).otherwise(0.0)
    out = g2 if bias else F.when(n > 3, (n - 1) / F.greatest((n - 2) * (n - 3), F.lit(1.0)) * ((n + 1) * g2 + 6)).otherwise(g2)
    return out if excess else out + 3.0


def quantile(x, q: float, method: str = "linear") -> Column:
    """Of sorted values at q * (n - 1); methods other than linear pick or average the neighbours."""
    x = _d(x)
    if method not in ("lower", "higher", "nearest", "midpoint"):
        return F.percentile(x, F.lit(q))
    v, at = F.array_sort(F.collect_list(x)), (F.count(x) - 1) * q
    pick = lambda i: F.get(v, i.cast("int"))
    return {"lower": lambda: pick(F.floor(at)), "higher": lambda: pick(F.ceil(at)), "nearest": lambda: pick(F.rint(at)), "midpoint": lambda: (pick(F.floor(at)) + pick(F.ceil(at))) / 2}[method]()


def describe(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """n, mean, std, variance, min, q1, median, q3, max, skewness and kurtosis of x, per group."""
    v = _d(x)
    n = F.count(v)
    return df.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(v).alias("mean"),
        F.when(n > 1, F.stddev_samp(v)).otherwise(0.0).alias("std"),
        _spread(v, 1).alias("variance"),
        F.min(v).alias("min"),
        F.percentile(v, F.lit(0.25)).alias("q1"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.percentile(v, F.lit(0.75)).alias("q3"),
        F.max(v).alias("max"),
        skewness(v).alias("skewness"),
        kurtosis(v).alias("kurtosis"),
    )


def welford_mean_var(df: DataFrame, x: str, *keys: str, ddof: int = 1) -> DataFrame:
    """Mean and variance in one pass; Spark's central moments merge as Welford's do."""
    v = _d(x)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), _spread(v, ddof).alias("variance"))


def covariance_matrix(df: DataFrame, cols: list[str], *keys: str, ddof: int = 1) -> DataFrame:
    """(keys, i, j, v): one aggregate per pair, one pass over the rows."""
    n = len(cols)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    scale = F.count(F.lit(1)) / F.greatest(F.count(F.lit(1)) - ddof, F.lit(1))
    aggs = [(F.covar_pop(_d(cols[i]), _d(cols[j])) * scale).alias(f"c{i}_{j}") for i, j in pairs]
    wide = df.groupBy(*keys).agg(*aggs)
    cells = F.array(*(F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("v")) for i in range(n) for j in range(n)))
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.i", "c.j", "c.v")


def correlation_matrix(df: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    """Covariances over the product of deviations; a constant column divides by 1 and so correlates 0."""
    cov = covariance_matrix(df, cols, *keys)
    dev = cov.where("i = j").select(*keys, F.col("i").alias("k"), F.when(F.col("v") > 0, F.sqrt("v")).otherwise(1.0).alias("s"))
    a, b = dev.withColumnsRenamed({"k": "i", "s": "si"}), dev.withColumnsRenamed({"k": "j", "s": "sj"})
    return cov.join(a, [*keys, "i"]).join(b, [*keys, "j"]).select(*keys, "i", "j", (F.col("v") / (F.col("si") * F.col("sj"))).alias("v"))


def gram(df: DataFrame, features: list[Column], y: Column | None, *keys: str, weight: Column | None = None) -> DataFrame:
    """Sums of w * f_i * f_j, w * f_i * y and w * y * y: g_i_j, b_i, yy, n, sum_y."""
    w = weight if weight is not None else F.lit(1.0)
    p = len(features)
    aggs = [F.sum(w * features[i] * features[j]).alias(f"g_{i}_{j}") for i in range(p) for j in range(i, p)]
    if y is not None:
        aggs += [F.sum(w * features[i] * y).alias(f"b_{i}") for i in range(p)] + [F.sum(w * y * y).alias("yy"), F.sum(w * y).alias("sum_y")]
    return df.groupBy(*keys).agg(*aggs, F.sum(w).alias("sum_w"), F.count(F.lit(1)).alias("n"))


def solve_gram(g: DataFrame, p: int, *keys: str, ridge: float = 0.0, keep: tuple[str, ...] = (), free: int = -1) -> DataFrame:
    """(G + ridge I) c = b by Cholesky in column expressions over the one row per group; `free` names an unpenalised feature."""
    cell = lambda i, j: F.col(f"g_{min(i, j)}_{max(i, j)}") + (ridge if i == j and i != free else 0.0)
    for j in range(p):
        for i in range(j, p):
            rest = cell(i, j)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            g = g.withColumn(f"l_{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}_{j}"))
    for i in range(p):
        rest = F.col(f"b_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        g = g.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    for i in reversed(range(p)):
        rest = F.col(f"z_{i}")
        for k in range(i + 1, p):
            rest = rest - F.col(f"l_{k}_{i}") * F.col(f"c_{k}")
        g = g.withColumn(f"c_{i}", rest / F.col(f"l_{i}_{i}"))
    return g.select(*keys, *(f"c_{i}" for i in range(p)), *keep)


def linear_regression(df: DataFrame, y: str, xs: list[str], *keys: str, intercept: bool = True, ridge: float = 0.0) -> DataFrame:
    """Coefficients c_0.. (intercept first), r2, adjusted r2, sigma2 and n per group."""
    features = ([F.lit(1.0)] if intercept else []) + [_d(x) for x in xs]
    p = len(features)
    g = gram(df, features, _d(y), *keys)
    out = solve_gram(g, p, *keys, ridge=ridge, keep=("yy", "sum_y", "n", *(f"b_{i}" for i in range(p))), free=0 if intercept else -1)
    rss = F.col("yy") - sum((F.col(f"c_{i}") * F.col(f"b_{i}") for i in range(1, p)), F.col("c_0") * F.col("b_0"))
    tss = F.col("yy") - F.col("sum_y") * F.col("sum_y") / F.col("n") if intercept else F.col("yy")
    out = out.withColumn("rss", rss).withColumn("tss", tss).withColumn("dof", F.greatest(F.col("n") - p, F.lit(1)))
    r2 = 1 - F.col("rss") / F.col("tss")
    return out.select(*keys, *(f"c_{i}" for i in range(p)), r2.alias("r2"), (1 - (1 - r2) * (F.col("n") - (1 if intercept else 0)) / F.col("dof")).alias("r2_adjusted"), (F.col("rss") / F.col("dof")).alias("sigma2"), "n")


def polyfit(df: DataFrame, x: str, y: str, degree: int, *keys: str, weight: str | None = None) -> DataFrame:
    """Least-squares polynomial; c_0 is the highest degree. Powers of x - mean condition the sums, then are expanded."""
    center = df.groupBy(*keys).agg(F.avg(_d(x)).alias("__mid"), F.greatest(F.stddev_pop(_d(x)), F.lit(1e-300)).alias("__dev"))
    rows = df.join(F.broadcast(center), list(keys)) if keys else df.crossJoin(F.broadcast(center))
    t = (_d(x) - F.col("__mid")) / F.col("__dev")
    rows = rows.withColumn("__t", t)
    powers = [F.lit(1.0)]
    for _ in range(degree):
        powers.append(powers[-1] * F.col("__t"))
    g = gram(rows, powers, _d(y), *keys, "__mid", "__dev", weight=_d(weight) if weight else None)
    c = solve_gram(g, degree + 1, *keys, keep=("__mid", "__dev"))
    out = []
    for d in range(degree, -1, -1):
        terms = [F.col(f"c_{k}") * float(math.comb(k, d)) * F.pow(-F.col("__mid"), F.lit(float(k - d))) / F.pow("__dev", F.lit(float(k))) for k in range(d, degree + 1)]
        out.append(sum(terms[1:], terms[0]).alias(f"p_{degree - d}"))
    return c.select(*keys, *out)


def polynomial_regression(df: DataFrame, x: str, y: str, degree: int, *keys: str) -> DataFrame:
    return polyfit(df, x, y, degree, *keys)


def transformed_fit(df: DataFrame, x: str, y: str, kind: str, *keys: str) -> DataFrame:
    """exponential a*exp(b x), power a*x**b or logarithmic a + b*log(x), by a straight line through transformed rows."""
    fx = F.log(_d(x)) if kind in ("power", "logarithmic") else _d(x)
    fy = F.log(_d(y)) if kind in ("power", "exponential") else _d(y)
    fit = linear_regression(df.withColumn("__x", fx).withColumn("__y", fy).where("__x is not null and __y is not null"), "__y", ["__x"], *keys)
    return fit.select(*keys, (F.exp("c_0") if kind != "logarithmic" else F.col("c_0")).alias("a"), F.col("c_1").alias("b"))


def logistic_regression(df: DataFrame, y: str, xs: list[str], max_iter: int = 25, tol: float = 1e-8, ridge: float = 1e-8) -> tuple[list[float], int, bool]:
    """Iteratively reweighted least squares; each round is one aggregate over the rows. Returns (coefficients, rounds, converged)."""
    features = [F.lit(1.0), *(_d(x) for x in xs)]
    beta = [0.0] * len(features)
    for step in range(max_iter):
        eta = sum((f * b for f, b in zip(features[1:], beta[1:])), features[0] * beta[0])
        eta = F.least(F.greatest(eta, F.lit(-500.0)), F.lit(500.0))
        mu = 1 / (1 + F.exp(-eta))
        w = F.greatest(mu * (1 - mu), F.lit(1e-10))
        rows = df.withColumn("__w", w).withColumn("__z", eta + (_d(y) - mu) / w)
        new = list(solve_gram(gram(rows, features, F.col("__z"), weight=F.col("__w")), len(features), ridge=ridge).first())
        done = max(abs(a - b) for a, b in zip(new, beta)) < tol
        beta = new
        if done:
            return beta, step + 1, True
    return beta, max_iter, False


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin number; the last bin is closed, values outside give null. Equal limits are widened by a half."""
    a, b = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    k = F.floor((x - a) / (b - a) * bins)
    return F.when((x < a) | (x > b), None).when(x == b, bins - 1).otherwise(F.least(k, F.lit(bins - 1)))


def histogram(df: DataFrame, x: str, bins: int = 10, limits: tuple[float, float] | None = None, weight: str | None = None) -> DataFrame:
    """(bin, lo, hi, n) of all bins, 0 in empty ones; limits come from the data unless given."""
    v = _d(x)
    ends = df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi")) if limits is None else df.sparkSession.range(1).select(F.lit(float(limits[0])).alias("__lo"), F.lit(float(limits[1])).alias("__hi"))
    rows = df.crossJoin(F.broadcast(ends)).withColumn("bin", bin_of(v, F.col("__lo"), F.col("__hi"), bins)).where("bin is not null")
    total = F.count(F.lit(1)) if weight is None else F.sum(_d(weight))
    full = rows.groupBy("bin").agg(total.alias("n"))
    every = ends.where("__lo is not null").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    out = every.join(full, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    a, b = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo") - 0.5).otherwise(F.col("__lo")), F.when(F.col("__lo") == F.col("__hi"), F.col("__hi") + 0.5).otherwise(F.col("__hi"))
    width = (b - a) / bins
    return out.select("bin", (a + F.col("bin") * width).alias("lo"), (a + (F.col("bin") + 1) * width).alias("hi"), "n")


def histogram_density(df: DataFrame, x: str, bins: int = 30, limits: tuple[float, float] | None = None) -> DataFrame:
    h = histogram(df, x, bins, limits)
    total = h.agg(F.sum("n").alias("__total"))
    return h.crossJoin(F.broadcast(total)).select("bin", "lo", "hi", (F.col("n") / (F.col("__total") * (F.col("hi") - F.col("lo")))).alias("density"))


def mode_estimate(df: DataFrame, x: str, bins: int = 50) -> DataFrame:
    """The middle of the fullest bin, the first one among equals."""
    h = histogram(df, x, bins)
    return h.agg(F.max_by(F.struct("lo", "hi"), F.struct("n", (-F.col("bin")).alias("b"))).alias("m")).select(((F.col("m.lo") + F.col("m.hi")) / 2).alias("mode"))


_KERNELS = {
    "gaussian": lambda u: F.exp(-u * u / 2) / math.sqrt(2 * math.pi),
    "epanechnikov": lambda u: F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0),
    "uniform": lambda u: F.when(F.abs(u) <= 1, 0.5).otherwise(0.0),
    "triangular": lambda u: F.when(F.abs(u) <= 1, 1 - F.abs(u)).otherwise(0.0),
}


def kernel_density(df: DataFrame, x: str, points: list[float], bandwidth: float | None = None, kernel: str = "gaussian") -> DataFrame:
    """Density at each point: the points, a parameter, ride in the row expression, so nothing is joined or shuffled but sums."""
    v = _d(x)
    if bandwidth is None:
        s = df.agg(F.stddev_samp(v), F.count(v)).first()
        bandwidth = 1.06 * (s[0] or 1.0) * s[1] ** -0.2
    sums = df.agg(F.count(v).alias("n"), *(F.sum(_KERNELS[kernel]((F.lit(float(p)) - v) / bandwidth)).alias(f"s{i}") for i, p in enumerate(points)))
    cells = F.array(*(F.struct(F.lit(float(p)).alias("point"), (F.col(f"s{i}") / (F.col("n") * bandwidth)).alias("density")) for i, p in enumerate(points)))
    return sums.select(F.explode(cells).alias("c")).select("c.point", "c.density")


def t_test(df: DataFrame, x: str, group: str, a, b, equal_var: bool = False) -> DataFrame:
    """Two-sample statistic and degrees of freedom (Welch's unless equal_var)."""
    v, g = _d(x), F.col(group)
    part = lambda f, k: f(F.when(g == k, v))
    s = df.where(g.isin(a, b)).agg(*(part(f, k).alias(f"{m}{i}") for i, k in enumerate((a, b)) for m, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    va, vb = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    if equal_var:
        dof = F.col("n0") + F.col("n1") - 2
        pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / dof
        se = F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    else:
        dof = (va + vb) * (va + vb) / (va * va / (F.col("n0") - 1) + vb * vb / (F.col("n1") - 1))
        se = F.sqrt(va + vb)
    return s.select(((F.col("m0") - F.col("m1")) / se).alias("statistic"), dof.cast("double").alias("dof"))


def t_test_one(df: DataFrame, x: str, mu0: float = 0.0, *keys: str) -> DataFrame:
    v = _d(x)
    return df.groupBy(*keys).agg(((F.avg(v) - mu0) / (F.stddev_samp(v) / F.sqrt(F.count(v)))).alias("statistic"), (F.count(v) - 1).cast("double").alias("dof"))


def chi_square_test(df: DataFrame, observed: str, expected: str | None = None) -> DataFrame:
    """Statistic and degrees of freedom over rows of counts; expected counts are equal unless given."""
    o = _d(observed)
    if expected is None:
        s = df.agg(F.sum(o).alias("s"), F.sum(o * o).alias("q"), F.count(o).alias("n"))
        return s.select((F.col("q") * F.col("n") / F.col("s") - F.col("s")).alias("statistic"), (F.col("n") - 1).alias("dof"))
    e = _d(expected)
    return df.agg(F.sum((o - e) * (o - e) / e).alias("statistic"), (F.count(o) - 1).alias("dof"))


def anova_one_way(df: DataFrame, x: str, group: str) -> DataFrame:
    """F statistic with its degrees of freedom, from per-group sums."""
    g = df.groupBy(group).agg(F.count(_d(x)).alias("n"), F.avg(_d(x)).alias("m"), F.var_pop(_d(x)).alias("v"))
    s = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("n") * F.col("grand") * F.col("grand")
    return s.select(((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("statistic"), (F.col("k") - 1).alias("dof_between"), (F.col("n") - F.col("k")).alias("dof_within"))


def ks_two_sample(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    """Largest gap of the empirical distribution functions; distinct values are counted first, then summed in order."""
    g = F.col(group)
    ties = df.where(g.isin(a, b)).groupBy(_d(x).alias("x")).agg(F.count(F.when(g == a, 1)).alias("na"), F.count(F.when(g == b, 1)).alias("nb"))
    run = running_sums(ties, ["x"], {"ca": "na", "cb": "nb"})
    total = ties.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    return run.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("statistic"))


def ks_one_sample(df: DataFrame, x: str, cdf) -> DataFrame:
    """Largest gap to a distribution given as a function of a column."""
    ties = df.groupBy(_d(x).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    run = running_sums(ties, ["x"], {"c": "k"})
    total = ties.agg(F.sum("k").alias("n"))
    p = cdf(F.col("x"))
    gap = F.greatest(F.col("c") / F.col("n") - p, p - (F.col("c") - F.col("k")) / F.col("n"))
    return run.crossJoin(F.broadcast(total)).agg(F.max(gap).alias("statistic"))


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], *keys: str) -> DataFrame:
    """df plus running sums of columns in an order that may span all rows.

    Rows are range-partitioned by the order; each partition is summed by itself and offset by the totals of those before,
    of which there is one row per partition. No task sees the whole series. Keyed series partition by key instead.
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *(F.sum(c).over(w).alias(n) for n, c in sums.items()))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.stat.approxQuantile(order[0], [k / n for k in range(1, n)], 1.0 / (4 * n)) if n > 1 and dict(df.dtypes)[order[0]] in ("double", "bigint", "int", "float") else []
    cuts = sorted(set(bounds))
    block = sum((F.when(F.col(order[0]) > c, 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)
    rows = df.withColumn("__block", block)
    totals = rows.groupBy("__block").agg(*(F.sum(c).alias(f"__t_{m}") for m, c in sums.items()))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("__block", *(F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in sums))
    w = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # offsets have one row per block, of which there are at most as many as shuffle partitions
    out = rows.join(F.broadcast(offs), "__block")
    return out.select(*df.columns, *((F.sum(c).over(w) + F.col(f"__o_{m}")).alias(m) for m, c in sums.items()))


def confidence_interval(df: DataFrame, x: str, z: float = 1.959963984540054, *keys: str) -> DataFrame:
    """mean -+ z standard errors; pass a Student quantile as z for small samples."""
    v = _d(x)
    half = z * F.stddev_samp(v) / F.sqrt(F.count(v))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), (F.avg(v) - half).alias("lower"), (F.avg(v) + half).alias("upper"))


def jackknife_mean(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """Estimate, bias and standard error of the mean from leave-one-out means, which the sums give directly."""
    v, n = _d(x), F.count(_d(x))
    return df.groupBy(*keys).agg(F.avg(v).alias("estimate"), F.lit(0.0).alias("bias"), F.sqrt(F.var_pop(v) / F.greatest(n - 1, F.lit(1))).alias("std_error"))


def uniform_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on its arguments: a counter-based generator."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def bootstrap(df: DataFrame, x: str, ident: str, n_resamples: int = 200, seed: int = 0) -> DataFrame:
    """(resample, mean): Poisson weights from a hash of (seed, resample, id), so that each pass only sums."""
    v = _d(x)
    rows = df.select(v.alias("v"), F.col(ident).alias("id")).withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    u, edge, term, weight = uniform_hash(F.lit(seed), F.col("resample"), F.col("id")), 0.0, math.exp(-1), F.lit(0)
    for k in range(18):  # beyond 18 the weights are less likely than the hash can tell
        edge += term
        term /= k + 1
        weight = weight + F.when(u >= edge, 1).otherwise(0)
    rows = rows.withColumn("w", weight)
    return rows.groupBy("resample").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))


def permutation_test(df: DataFrame, x: str, group: str, a, b, ident: str, n_permutations: int = 200, seed: int = 0) -> DataFrame:
    """Share of relabellings whose difference of means is at least the observed one; group sizes stay as they are.

    A draw gives label a to the rows of the n_a least hashes. Counts by the first 16 bits of the hash tell in which cell the
    last of them lies, so that only the rows of that cell, some 65,536th of all, are ranked.
    """
    rows = df.where(F.col(group).isin(a, b) & F.col(x).isNotNull()).select(_d(x).alias("v"), (F.col(group) == a).alias("a"), F.col(ident).alias("id"))
    whole = rows.agg(F.count_if("a").alias("n_a"), F.count_if(~F.col("a")).alias("n_b"), F.sum(F.when(F.col("a"), F.col("v"))).alias("s_a"), F.sum("v").alias("s"))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_permutations)))).withColumn("h", F.xxhash64(F.lit(seed), F.col("draw"), F.col("id")))
    drawn = drawn.withColumn("cell", F.shiftrightunsigned("h", 48))
    cells = drawn.groupBy("draw", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("to", F.sum("n").over(Window.partitionBy("draw").orderBy("cell")))
    edge = cells.crossJoin(F.broadcast(whole)).where("to >= n_a and to - n < n_a").select("draw", F.col("cell").alias("edge"), (F.col("n_a") - F.col("to") + F.col("n")).alias("need"))
    met = drawn.join(F.broadcast(edge), "draw")  # a row per draw
    inner = met.where("cell < edge").groupBy("draw").agg(F.sum("v").alias("s"))
    last = met.where("cell = edge").withColumn("rank", F.row_number().over(Window.partitionBy("draw").orderBy("h", "id", "v")))
    taken = inner.unionByName(last.where("rank <= need").groupBy("draw").agg(F.sum("v").alias("s"))).groupBy("draw").agg(F.sum("s").alias("drawn"))

    def gap(part: str) -> Column:
        return F.col(part) / F.col("n_a") - (F.col("s") - F.col(part)) / F.col("n_b")

    gaps = taken.crossJoin(F.broadcast(whole)).where("n_a > 0 and n_b > 0").select(gap("s_a").alias("observed"), gap("drawn").alias("gap"))
    return gaps.agg(F.max("observed").alias("observed"), ((F.count_if(F.abs("gap") >= F.abs("observed") - 1e-12 * F.abs("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def p_value_t(statistic: float, dof: float) -> float:
    """Two-sided, of Student's distribution."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + statistic * statistic))


def p_value_chi_square(statistic: float, dof: float) -> float:
    return regularized_gamma_q(dof / 2, statistic / 2)


def p_value_f(statistic: float, between: float, within: float) -> float:
    return incomplete_beta(within / 2, between / 2, within / (within + between * statistic))


def p_value_ks(statistic: float, n: float, m: float | None = None) -> float:
    """Kolmogorov's limit for one sample of n, or two of n and m, with the usual small-sample shift of the argument."""
    size = math.sqrt(n if m is None else n * m / (n + m))
    x = (size + 0.12 + 0.11 / size) * statistic
    if x < 0.3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def quantile_t(p: float, dof: float) -> float:
    """Where Student's distribution reaches p, by bisection."""
    if p < 0.5:
        return -quantile_t(1 - p, dof)
    lo, hi = 0.0, 1.0
    while 1 - p_value_t(hi, dof) / 2 < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - p_value_t(mid, dof) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def student_interval(df: DataFrame, x: str, level: float = 0.95, *keys: str) -> DataFrame:
    """(mean, lower, upper) per key from Student's quantile of its own degrees of freedom; groups of one row have null ends."""
    v = _d(x)
    got = df.groupBy(*keys).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("__se"), (F.count(v) - 1).cast("double").alias("__dof"))

    @F.pandas_udf("double")
    def quantiles(dof: pd.Series) -> pd.Series:
        known = {d: quantile_t(0.5 + level / 2, d) if d > 0 else None for d in dof.unique()}
        return dof.map(known).astype("float64")

    half = quantiles("__dof") * F.col("__se")
    return got.select(*keys, "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def pca(df: DataFrame, cols: list[str], n_components: int | None = None):
    """(means, variances, components): eigenvectors of the covariance matrix, whose size is that of the columns."""
    import numpy as np

    p = len(cols)
    cov = np.zeros((p, p))
    for r in covariance_matrix(df, cols).collect():
        cov[r["i"], r["j"]] = r["v"]
    means = list(df.agg(*(F.avg(_d(c)) for c in cols)).first())
    w, v = np.linalg.eigh(cov)
    order = np.argsort(-w)[: n_components or p]
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    return means, w[order], v


def vector_moments(df: DataFrame, vec: str, dims: int) -> DataFrame:
    """(i, j, v) covariances of an array column: sums over exploded index pairs (i <= j), combined on the map side."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.transform(F.sequence(i, F.lit(dims - 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = df.select(F.col(vec).cast("array<double>").alias("x"))
    cells = rows.select("x", F.explode(pairs).alias("p")).select("p.i", "p.j", (F.get("x", F.col("p.i")) * F.get("x", F.col("p.j"))).alias("q"))
    means = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    got = cells.groupBy("i", "j").agg(F.sum("q").alias("q"), F.count("q").alias("n"))
    a, b = means.withColumnRenamed("m", "mi"), means.withColumnsRenamed({"i": "j", "m": "mj"})
    return got.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("i", "j", ((F.col("q") - F.col("n") * F.col("mi") * F.col("mj")) / (F.col("n") - 1)).alias("v"))
