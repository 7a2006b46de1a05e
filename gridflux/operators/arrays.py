"""Array operators over long-form frames: vec (i, v), mat (i, j, v), with optional key columns.

An array's order is its index column. Scans partition by key; a scan over one long unkeyed series goes by blocks with
offsets (`stats.running_sums`). Set operators keep distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridflux.functions import ieee
from gridflux.operators.stats import running_sums


# ---- creation ---------------------------------------------------------------------------------------------------
def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> DataFrame:
    n = max(0, -int(-(stop - start) // step))
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * float(step)).alias("v"))


def linspace(spark: SparkSession, a: float, b: float, n: int = 50, endpoint: bool = True) -> DataFrame:
    h = (b - a) / max(1, n - 1 if endpoint else n)
    v = F.when((F.col("id") == n - 1) & F.lit(endpoint and n > 1), F.lit(float(b))).otherwise(a + F.col("id") * h)
    return spark.range(n).select(F.col("id").alias("i"), v.alias("v"))


def logspace(spark: SparkSession, a: float, b: float, n: int = 50, base: float = 10.0) -> DataFrame:
    return linspace(spark, a, b, n).withColumn("v", F.pow(F.lit(base), F.col("v")))


def geomspace(spark: SparkSession, a: float, b: float, n: int = 50) -> DataFrame:
    import math

    return linspace(spark, math.log(a), math.log(b), n).withColumn("v", F.exp("v"))


def full(spark: SparkSession, n: int, value: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("v"))


def zeros(spark: SparkSession, n: int) -> DataFrame:
    return full(spark, n, 0.0)


def ones(spark: SparkSession, n: int) -> DataFrame:
    return full(spark, n, 1.0)


def identity(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> DataFrame:
    """Sparse: only the ones are rows."""
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") + k).alias("j"), F.lit(1.0).alias("v")).where((F.col("j") >= 0) & (F.col("j") < (m or n)))


def meshgrid(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, x, y): each row index j of y with each i of x; the smaller axis is what the planner broadcasts."""
    return x.select("i", F.col("v").alias("x")).crossJoin(y.select(F.col("i").alias("j"), F.col("v").alias("y")))


def indices(spark: SparkSession, *shape: int) -> DataFrame:
    """Every multi-index of a shape, in C order."""
    total = reduce(lambda a, b: a * b, shape, 1)
    return unravel_index(spark.range(total).withColumnRenamed("id", "flat"), "flat", shape)


def vander(df: DataFrame, n: int, increasing: bool = False) -> DataFrame:
    powers = [F.pow("v", F.lit(float(k))) for k in (range(n) if increasing else range(n - 1, -1, -1))]
    return df.select("i", F.posexplode(F.array(*powers)).alias("j", "v")).withColumn("j", F.col("j").cast("bigint"))


def window(spark: SparkSession, kind: str, m: int, beta: float = 14.0) -> DataFrame:
    """Symmetric windows hanning, hamming, blackman, bartlett, kaiser, boxcar."""
    from gridflux.functions.windows import window_value

    return spark.range(max(0, m)).select(F.col("id").alias("i"), window_value(kind, F.col("id"), m, beta=beta).alias("v"))


# ---- shape ------------------------------------------------------------------------------------------------------
def unravel_index(df: DataFrame, flat: str, shape: tuple[int, ...]) -> DataFrame:
    rest, cols = F.col(flat), []
    for k in range(len(shape) - 1, -1, -1):
        cols.append((rest % shape[k]).alias(f"i{k}"))
        rest = F.floor(rest / shape[k])
    return df.select("*", *reversed(cols))


def ravel_multi_index(cols: list[Column], shape: tuple[int, ...]) -> Column:
    out = F.lit(0).cast("bigint")
    for c, n in zip(cols, shape):
        out = out * n + c
    return out


def length(df: DataFrame) -> int:
    last = df.agg(F.max("i")).first()[0]
    return 0 if last is None else last + 1


def concatenate(*parts: DataFrame) -> DataFrame:
    """Vectors end to end: each part's index is moved by the lengths before it."""
    out, at = None, 0
    for p in parts:
        moved = p.withColumn("i", F.col("i") + at)
        out, at = moved if out is None else out.unionByName(moved), at + length(p)
    return out


def stack(*parts: DataFrame, axis: int = 0) -> DataFrame:
    a, b = ("i", "j") if axis == 0 else ("j", "i")
    rows = [p.select(F.lit(k).cast("bigint").alias(a), F.col("i").alias(b), "v") for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, rows).select("i", "j", "v")


def vstack(a: DataFrame, b: DataFrame, rows_a: int) -> DataFrame:
    return a.unionByName(b.withColumn("i", F.col("i") + rows_a))


def hstack(a: DataFrame, b: DataFrame, cols_a: int) -> DataFrame:
    return a.unionByName(b.withColumn("j", F.col("j") + cols_a))


def flip(df: DataFrame, n: int, axis: str = "i") -> DataFrame:
    return df.withColumn(axis, n - 1 - F.col(axis))


def roll(df: DataFrame, n: int, shift: int, axis: str = "i") -> DataFrame:
    return df.withColumn(axis, F.pmod(F.col(axis) + shift, F.lit(n)))


def tile(df: DataFrame, n: int, reps: int) -> DataFrame:
    return df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("i", F.col("i") + F.col("__r") * n).drop("__r")


def repeat(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("i", F.col("i") * reps + F.col("__r")).drop("__r")


def pad(df: DataFrame, n: int, before: int, after: int, mode: str = "constant", value: float = 0.0) -> DataFrame:
    """Modes constant, edge, wrap, reflect, symmetric."""
    spark, total = df.sparkSession, n + before + after
    k = F.col("id") - before
    if mode == "constant":
        grid = spark.range(total).select(F.col("id").alias("i"), k.alias("__s"))
        return grid.join(df.select(F.col("i").alias("__s"), "v"), "__s", "left").select("i", F.coalesce("v", F.lit(value)).alias("v"))
    two = 2 * n
    src = {
        "edge": F.greatest(F.lit(0), F.least(F.lit(n - 1), k)),
        "wrap": F.pmod(k, F.lit(n)),
        "symmetric": F.when(F.pmod(k, F.lit(two)) < n, F.pmod(k, F.lit(two))).otherwise(two - 1 - F.pmod(k, F.lit(two))),
        "reflect": F.lit(n - 1) - F.abs(F.pmod(k, F.lit(max(1, two - 2))) - (n - 1)),
    }
    if mode not in src:
        raise NotImplementedError(mode)
    grid = spark.range(total).select(F.col("id").alias("i"), src[mode].alias("__s"))
    return grid.join(df.select(F.col("i").alias("__s"), "v"), "__s").select("i", "v")


def insert(df: DataFrame, at: int, values: list[float]) -> DataFrame:
    new = df.sparkSession.createDataFrame([(at + k, float(v)) for k, v in enumerate(values)], "i bigint, v double")
    return df.withColumn("i", F.when(F.col("i") >= at, F.col("i") + len(values)).otherwise(F.col("i"))).unionByName(new)


def delete(df: DataFrame, positions: list[int], n: int) -> DataFrame:
    gone = sorted({p % n for p in positions})
    return df.where(~F.col("i").isin(gone)).withColumn("i", F.col("i") - sum((F.when(F.col("i") > p, 1).otherwise(0) for p in gone), F.lit(0)))


def take(df: DataFrame, picks: DataFrame) -> DataFrame:
    """v at the positions in picks (i, at)."""
    return picks.join(df.select(F.col("i").alias("at"), "v"), "at").select("i", "v")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def diag(v: DataFrame, k: int = 0) -> DataFrame:
    return v.select((F.col("i") + max(0, -k)).alias("i"), (F.col("i") + max(0, k)).alias("j"), "v")


def diagonal(m: DataFrame, k: int = 0) -> DataFrame:
    return m.where(F.col("j") - F.col("i") == k).select(F.least("i", "j").alias("i"), "v")


def triu(m: DataFrame, k: int = 0) -> DataFrame:
    return m.where(F.col("j") - F.col("i") >= k)


def tril(m: DataFrame, k: int = 0) -> DataFrame:
    return m.where(F.col("j") - F.col("i") <= k)


# ---- scans ------------------------------------------------------------------------------------------------------
def cumsum(df: DataFrame, v: str = "v", i: str = "i", keys: tuple[str, ...] = (), name: str = "cumsum") -> DataFrame:
    return running_sums(df, [i], {name: v}, *keys)


def cumprod(df: DataFrame, v: str = "v", i: str = "i", keys: tuple[str, ...] = ()) -> DataFrame:
    """By sums of logarithms with counts of signs and zeros."""
    x = F.col(v)
    rows = df.withColumn("__l", F.when(x == 0, 0.0).otherwise(F.log(F.abs(x)))).withColumn("__n", (x < 0).cast("int")).withColumn("__z", (x == 0).cast("int"))
    out = running_sums(rows, [i], {"__sl": "__l", "__sn": "__n", "__sz": "__z"}, *keys)
    sign = F.when(F.col("__sn") % 2 == 1, -1.0).otherwise(1.0)
    return out.select(*df.columns, F.when(F.col("__sz") > 0, 0.0).otherwise(sign * F.exp("__sl")).alias("cumprod"))


def neighbours(keys: tuple[str, ...], i: str):
    return Window.partitionBy(*keys).orderBy(i)


def diff(df: DataFrame, v: str = "v", i: str = "i", keys: tuple[str, ...] = (), name: str = "diff") -> DataFrame:
    """v - previous v; the first of each series has none and is left out."""
    return df.withColumn(name, F.col(v) - F.lag(v).over(neighbours(keys, i))).where(F.col(name).isNotNull())


def gradient(df: DataFrame, v: str = "v", x: str | None = None, i: str = "i", keys: tuple[str, ...] = (), name: str = "gradient") -> DataFrame:
    """Central quotients inside, one-sided at the ends; uneven coordinates use the two-point quotient."""
    w, p = neighbours(keys, i), F.col(x) if x else F.col(i).cast("double")
    up, down = F.coalesce(F.lead(v).over(w), F.col(v)), F.coalesce(F.lag(v).over(w), F.col(v))
    xu, xd = F.coalesce(F.lead(p).over(w), p), F.coalesce(F.lag(p).over(w), p)
    return df.withColumn(name, ieee.ieee_div(up - down, xu - xd))


def trapezoid_data(df: DataFrame, y: str, x: str, *keys: str) -> DataFrame:
    w = neighbours(keys, x)
    return df.withColumn("__a", (F.col(y) + F.lag(y).over(w)) * (F.col(x) - F.lag(x).over(w)) / 2).groupBy(*keys).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("integral"))


def cumulative_trapezoid(df: DataFrame, y: str, x: str, *keys: str, initial: float = 0.0) -> DataFrame:
    w = neighbours(keys, x)
    rows = df.withColumn("__a", F.coalesce((F.col(y) + F.lag(y).over(w)) * (F.col(x) - F.lag(x).over(w)) / 2, F.lit(0.0)))
    return running_sums(rows, [x], {"cumulative": "__a"}, *keys).withColumn("cumulative", F.col("cumulative") + initial).drop("__a")


def simpson_data(df: DataFrame, y: str, x: str, *keys: str) -> DataFrame:
    """Parabolas through triples of points, uneven spacing allowed; a trapezoid covers a last odd interval."""
    w = neighbours(keys, x)
    rows = df.withColumn("__n", F.row_number().over(w) - 1)
    y1, y2, x1, x2 = F.lead(y).over(w), F.lead(y, 2).over(w), F.lead(x).over(w), F.lead(x, 2).over(w)
    h0, h1 = x1 - F.col(x), x2 - x1
    s = h0 + h1
    three = s / 6 * ((2 - h1 / h0) * F.col(y) + s * s / (h0 * h1) * y1 + (2 - h0 / h1) * y2)
    last = F.when(x2.isNull() & x1.isNotNull(), h0 * (F.col(y) + y1) / 2)
    part = F.when(F.col("__n") % 2 == 0, F.coalesce(three, last))
    return rows.withColumn("__a", part).groupBy(*keys).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("integral"))


# ---- order, sets, search ----------------------------------------------------------------------------------------
def sort(df: DataFrame, v: str = "v", *keys: str) -> DataFrame:
    """i renumbered in the order of v; NaN last, as Spark orders it."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(v)) - 1)


def argsort(df: DataFrame, v: str = "v", i: str = "i", *keys: str) -> DataFrame:
    return df.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(v, i)) - 1).alias("rank"), F.col(i).alias("pos"))


def lexsort(df: DataFrame, cols: list[str], i: str = "i", *keys: str) -> DataFrame:
    """The last column is the first key."""
    return df.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(*reversed(cols), i)) - 1).alias("rank"), F.col(i).alias("pos"))


def argmax(df: DataFrame, v: str = "v", i: str = "i", *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(i, F.struct(v, (-F.col(i)).alias("b"))).alias("pos"), F.max(v).alias("value"))


def argmin(df: DataFrame, v: str = "v", i: str = "i", *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(i, F.struct(v, F.col(i).alias("b"))).alias("pos"), F.min(v).alias("value"))


def unique(df: DataFrame, v: str = "v", i: str | None = None) -> DataFrame:
    """Distinct values with counts, and the first position of each if i is named."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min(i).alias("first_index")] if i else [])
    return df.groupBy(F.col(v).alias("value")).agg(*aggs)


def union1d(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect1d(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def setdiff1d(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def in1d(a: DataFrame, col: str, b: DataFrame, col_b: str) -> DataFrame:
    """a plus is_in: a left join with the distinct values of b."""
    known = b.select(F.col(col_b).alias("__k")).where("__k is not null").distinct().withColumn("__in", F.lit(True))
    return a.join(known, a[col] == known["__k"], "left").withColumn("is_in", F.coalesce("__in", F.lit(False))).drop("__k", "__in")


def bincount(df: DataFrame, v: str, weight: str | None = None) -> DataFrame:
    """(bin, n) of every integer from 0 to the largest; n is a count or a sum of weights, 0 in empty bins."""
    got = df.groupBy(F.col(v).cast("bigint").alias("bin")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    bins = got.agg(F.max("bin").alias("last")).where("last >= 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("bin"))
    return bins.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def searchsorted(df: DataFrame, x: str, edges: list[float], side: str = "left") -> DataFrame:
    """Insertion point of x in a sorted list of edges, a parameter that rides in the expression."""
    hit = (lambda e: e < F.col(x)) if side == "left" else (lambda e: e <= F.col(x))
    return df.withColumn("slot", F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), hit)))


def digitize(df: DataFrame, x: str, edges: list[float]) -> DataFrame:
    return searchsorted(df, x, edges, "right")


def asof(queries: DataFrame, q: str, knots: DataFrame, k: str, values: list[str], *keys: str) -> DataFrame:
    """queries plus the values of the last knot at or before q: one sort of the union in place of a range join.

    Unkeyed queries are spread by bucket of the knots' quantiles; the last knot before a bucket is carried into it.
    """
    left = queries.withColumn("__q", F.col(q).cast("double")).withColumn("__side", F.lit(1)).withColumn("__row", F.monotonically_increasing_id())
    right = knots.select(*keys, F.col(k).cast("double").alias("__q"), F.lit(0).alias("__side"), *(F.col(c).alias(f"__v_{c}") for c in values))
    both = left.unionByName(right, allowMissingColumns=True)
    part = list(keys)
    if not keys:
        n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cuts = sorted(set(right.stat.approxQuantile("__q", [j / n for j in range(1, n)], 1.0 / (4 * n)))) if n > 1 else []
        block = sum((F.when(F.col("__q") >= c, 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)
        carried = right.withColumn("__block", block).groupBy("__block").agg(F.max_by(F.struct("__q", *(f"__v_{c}" for c in values)), "__q").alias("__m"))
        w = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
        all_blocks = queries.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__block"))
        carried = all_blocks.join(F.broadcast(carried), "__block", "left").select("__block", F.last("__m", ignorenulls=True).over(w).alias("__c"))
        both, part = both.withColumn("__block", block).join(F.broadcast(carried), "__block"), ["__block"]
    w = Window.partitionBy(*part).orderBy("__q", "__side").rowsBetween(Window.unboundedPreceding, 0)
    got = F.last(F.when(F.col("__side") == 0, F.struct("__q", *(f"__v_{c}" for c in values))), ignorenulls=True).over(w)
    if not keys:
        got = F.coalesce(got, F.col("__c"))
    out = both.withColumn("__hit", got).where("__side = 1")
    return out.select(*queries.columns, *(F.col("__hit")[f"__v_{c}"].alias(c) for c in values))


def interp(queries: DataFrame, q: str, knots: DataFrame, x: str, y: str, left: float | None = None, right: float | None = None, name: str = "interpolated") -> DataFrame:
    """Piecewise linear interpolation by an as-of search on (x, y, slope); beyond the ends the end values hold, unless given."""
    # knots are the small side by nature; their slopes need each one's successor
    k = knots.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).withColumn("__x1", F.lead("__x").over(Window.orderBy("__x"))).withColumn("__y1", F.lead("__y").over(Window.orderBy("__x")))
    first = knots.agg(F.min_by(y, x)).first()[0]
    got = asof(queries, q, k, "__x", ["__x", "__y", "__x1", "__y1"])
    t = (F.col(q) - F.col("__x")) / (F.col("__x1") - F.col("__x"))
    inside = F.when(F.col("__x1").isNull(), F.when(F.col(q) == F.col("__x"), F.col("__y")).otherwise(F.lit(right) if right is not None else F.col("__y"))).otherwise(F.col("__y") + t * (F.col("__y1") - F.col("__y")))
    return got.select(*queries.columns, F.when(F.col("__x").isNull(), F.lit(float(first if left is None else left))).otherwise(inside).alias(name))


# ---- comparison -------------------------------------------------------------------------------------------------
def allclose(a: DataFrame, b: DataFrame, on: list[str], rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> DataFrame:
    """One row: are all pairs close, and do both have the same indices?"""
    both = a.withColumnRenamed("v", "__a").join(b.withColumnRenamed("v", "__b"), on, "full")
    return both.agg(F.coalesce(F.bool_and(F.coalesce(ieee.isclose(F.col("__a"), F.col("__b"), rtol, atol, equal_nan), F.lit(False))), F.lit(True)).alias("close"))


def array_equal(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    both = a.withColumnRenamed("v", "__a").join(b.withColumnRenamed("v", "__b"), on, "full")
    return both.agg(F.coalesce(F.bool_and(F.coalesce((F.col("__a") == F.col("__b")) & ~F.isnan("__a"), F.lit(False))), F.lit(True)).alias("equal"))


def reduce_axis(m: DataFrame, how: str, *keep: str) -> DataFrame:
    """Reductions over the axes that are not kept: sum, prod, mean, var, std, min, max, any, all, ptp, count_nonzero."""
    v = F.col("v").cast("double")
    f = {
        "sum": F.sum(v), "prod": F.product(v), "mean": F.avg(v), "var": F.var_pop(v), "std": F.stddev_pop(v), "min": ieee.nan_min(v), "max": F.max(v),
        "any": F.bool_or(v != 0), "all": F.bool_and(v != 0), "ptp": F.max(v) - F.min(v), "count_nonzero": F.count(F.when(v != 0, 1)),
    }
    return m.groupBy(*keep).agg(f[how].alias(how))
