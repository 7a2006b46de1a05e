"""Matrices as relations (i, j, v) whose duplicates sum, vectors as (i, v).

Products are equi-joins followed by sums; there is no format but partitioning, so row- and column-compressed matrices are
the same rows hashed by i or by j. Iterative solvers keep their vectors in Parquet between rounds and send scalars only to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflux.operators.runtime import History, materialise


def coo(df: DataFrame) -> DataFrame:
    """Sum duplicates, drop zeros."""
    return df.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def from_rows(df: DataFrame, i: str, cols: list[str]) -> DataFrame:
    """Wide rows to (i, j, v)."""
    cells = F.array(*(F.struct(F.lit(j).cast("bigint").alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(cols)))
    return df.select(F.col(i).alias("i"), F.explode(cells).alias("c")).select("i", "c.j", "c.v").where("v <> 0")


def diags(spark: SparkSession, values: list[float], offsets: list[int], n: int, m: int | None = None) -> DataFrame:
    m = m or n
    parts = [spark.range(n).select(F.col("id").alias("i"), (F.col("id") + k).alias("j"), F.lit(float(v)).alias("v")) for v, k in zip(values, offsets)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where((F.col("j") >= 0) & (F.col("j") < m))


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    return coo(a.withColumn("v", alpha * F.col("v")).unionByName(b.withColumn("v", beta * F.col("v"))))


def scale(a: DataFrame, s: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * s)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    return coo(a).join(coo(b).withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of A x."""
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def spmv_t(a: DataFrame, x: DataFrame) -> DataFrame:
    return a.join(x.withColumnRenamed("v", "x"), "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def spmm(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("k"), F.col("j").alias("jj"), F.col("v").alias("w"))
    return a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", F.col("jj").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def gram_matrix(a: DataFrame) -> DataFrame:
    """AᵀA by a self-join on rows."""
    left, right = a.select("i", F.col("j").alias("p"), F.col("v").alias("x")), a.select("i", F.col("j").alias("q"), F.col("v").alias("y"))
    return left.join(right, "i").groupBy(F.col("p").alias("i"), F.col("q").alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def kron(a: DataFrame, b: DataFrame, rows_b: int, cols_b: int) -> DataFrame:
    """Every pair of entries is a result; the sides pair up because their product is what is asked for."""
    right = b.select(F.col("i").alias("p"), F.col("j").alias("q"), F.col("v").alias("w"))
    return a.crossJoin(right).select((F.col("i") * rows_b + F.col("p")).alias("i"), (F.col("j") * cols_b + F.col("q")).alias("j"), (F.col("v") * F.col("w")).alias("v"))


def outer(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.crossJoin(y.select(F.col("i").alias("j"), F.col("v").alias("w"))).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def vec(a: DataFrame, rows: int) -> DataFrame:
    """Columns stacked."""
    return a.select((F.col("j") * rows + F.col("i")).alias("i"), "v")


def unvec(x: DataFrame, rows: int) -> DataFrame:
    return x.select((F.col("i") % rows).alias("i"), F.floor(F.col("i") / rows).alias("j"), "v")


def matrix_power(a: DataFrame, p: int, n: int) -> DataFrame:
    """By repeated squaring, materialised between products."""
    from gridflux.operators.arrays import identity

    out, base = identity(a.sparkSession, n), a
    while p:
        if p & 1:
            out = materialise(spmm(out, base))
        base = materialise(spmm(base, base)) if p > 1 else base
        p >>= 1
    return out


def trace(a: DataFrame, k: int = 0) -> DataFrame:
    return a.agg(F.coalesce(F.sum(F.when(F.col("j") - F.col("i") == k, F.col("v"))), F.lit(0.0)).alias("trace"))


def dot(x: DataFrame, y: DataFrame) -> float:
    return float(x.join(y.withColumnRenamed("v", "w"), "i").agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0)


def norm(x: DataFrame, p="2") -> DataFrame:
    v = F.abs("v")
    f = {"1": F.sum(v), "2": F.sqrt(F.sum(F.col("v") * F.col("v"))), "inf": F.max(v), "-inf": F.min(v), "0": F.sum((F.col("v") != 0).cast("double"))}
    return x.agg((f[str(p)] if str(p) in f else F.pow(F.sum(F.pow(v, F.lit(float(p)))), F.lit(1.0 / float(p)))).alias("norm"))


def matrix_norm(a: DataFrame, p: str = "fro") -> DataFrame:
    """fro, 1 (largest column sum), inf (largest row sum), max."""
    if p == "fro":
        return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    if p == "max":
        return a.agg(F.max(F.abs("v")).alias("norm"))
    axis = "j" if p == "1" else "i"
    return a.groupBy(axis).agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm"))


def gershgorin_disks(a: DataFrame) -> DataFrame:
    """(i, center, radius)."""
    on = F.col("i") == F.col("j")
    return a.groupBy("i").agg(F.coalesce(F.sum(F.when(on, F.col("v"))), F.lit(0.0)).alias("center"), F.coalesce(F.sum(F.when(~on, F.abs("v"))), F.lit(0.0)).alias("radius"))


def is_diagonally_dominant(a: DataFrame, strict: bool = True) -> DataFrame:
    d = F.abs("center")
    return gershgorin_disks(a).agg(F.bool_and(d > F.col("radius") if strict else d >= F.col("radius")).alias("dominant"))


def is_symmetric(a: DataFrame, tol: float = 1e-12) -> DataFrame:
    t = a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    gap = F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0)))
    return a.join(t, ["i", "j"], "full").agg(F.coalesce(F.max(gap) <= tol, F.lit(True)).alias("symmetric"))


def bandwidth(a: DataFrame) -> DataFrame:
    return a.agg(F.max(F.greatest(F.col("i") - F.col("j"), F.lit(0))).alias("lower"), F.max(F.greatest(F.col("j") - F.col("i"), F.lit(0))).alias("upper"))


def sparsity(a: DataFrame, rows: int, cols: int) -> DataFrame:
    return a.agg((1 - F.count(F.when(F.col("v") != 0, 1)) / float(rows * cols)).alias("sparsity"))


def jacobi_preconditioner(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", (1 / F.when(F.col("v") == 0, 1.0).otherwise(F.col("v"))).alias("v"))


def residual_analysis(a: DataFrame, b: DataFrame, x: DataFrame) -> DataFrame:
    r = axpy(b, spmv(a, x), -1.0)
    return r.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.max(F.abs("v")).alias("largest"), F.avg("v").alias("mean"))


# ---- iterative solvers ------------------------------------------------------------------------------------------
def axpy(x: DataFrame, y: DataFrame, alpha: float) -> DataFrame:
    """x + alpha y over the union of their indices."""
    return x.unionByName(y.select("i", (F.col("v") * alpha).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))


def _zero(b: DataFrame) -> DataFrame:
    return b.select("i", F.lit(0.0).alias("v"))


def _length(x: DataFrame) -> float:
    return float(norm(x).first()[0] or 0.0)


def jacobi_iteration(a: DataFrame, b: DataFrame, tol: float = 1e-10, max_iter: int = 100):
    """(x, iterations, converged, history)."""
    d = materialise(a.where("i = j").groupBy("i").agg(F.sum("v").alias("d")))
    off, x, h = a.where("i <> j"), materialise(_zero(b)), History()
    size = _length(b) or 1.0
    for k in range(max_iter):
        new = materialise(axpy(b, spmv(off, x), -1.0).join(d, "i").select("i", (F.col("v") / F.col("d")).alias("v")))
        h.add(_length(axpy(new, x, -1.0)) / size)
        x = new
        if h.values[-1][1] < tol:
            return x, k + 1, True, h
    return x, max_iter, False, h


def richardson(a: DataFrame, b: DataFrame, omega: float, tol: float = 1e-10, max_iter: int = 100):
    x, h, size = materialise(_zero(b)), History(), _length(b) or 1.0
    for k in range(max_iter):
        r = materialise(axpy(b, spmv(a, x), -1.0))
        h.add(_length(r) / size)
        if h.values[-1][1] < tol:
            return x, k, True, h
        x = materialise(axpy(x, r, omega))
    return x, max_iter, False, h


def steepest_descent(a: DataFrame, b: DataFrame, tol: float = 1e-10, max_iter: int = 100):
    x, h, size = materialise(_zero(b)), History(), _length(b) or 1.0
    r = materialise(b.select("i", F.col("v").cast("double").alias("v")))
    for k in range(max_iter):
        rr = dot(r, r)
        h.add(rr**0.5 / size)
        if h.values[-1][1] < tol:
            return x, k, True, h
        ar = materialise(spmv(a, r))
        step = rr / dot(r, ar)
        x, r = materialise(axpy(x, r, step)), materialise(axpy(r, ar, -step))
    return x, max_iter, False, h


def conjugate_gradient(a: DataFrame, b: DataFrame, tol: float = 1e-10, max_iter: int = 100, inverse_diagonal: DataFrame | None = None):
    """Preconditioned if an inverse diagonal (i, v) is given; stops on the relative residual or on negative curvature."""

    def pre(r):
        return r if inverse_diagonal is None else materialise(r.join(inverse_diagonal.withColumnRenamed("v", "m"), "i").select("i", (F.col("v") * F.col("m")).alias("v")))

    x, h, size = materialise(_zero(b)), History(), _length(b) or 1.0
    r = materialise(b.select("i", F.col("v").cast("double").alias("v")))
    z = pre(r)
    p, rz = z, dot(r, z)
    for k in range(max_iter):
        h.add(_length(r) / size)
        if h.values[-1][1] < tol:
            return x, k, True, h
        ap = materialise(spmv(a, p))
        curve = dot(p, ap)
        if curve <= 0:
            return x, k, False, h
        alpha = rz / curve
        x, r = materialise(axpy(x, p, alpha)), materialise(axpy(r, ap, -alpha))
        z = pre(r)
        rz, old = dot(r, z), rz
        p = materialise(axpy(z, p, rz / old))
    return x, max_iter, False, h


def bicgstab(a: DataFrame, b: DataFrame, tol: float = 1e-10, max_iter: int = 100):
    x, h, size = materialise(_zero(b)), History(), _length(b) or 1.0
    r = materialise(b.select("i", F.col("v").cast("double").alias("v")))
    shadow, p, rho = r, r, dot(r, r)
    for k in range(max_iter):
        h.add(_length(r) / size)
        if h.values[-1][1] < tol:
            return x, k, True, h
        v = materialise(spmv(a, p))
        alpha = rho / dot(shadow, v)
        s = materialise(axpy(r, v, -alpha))
        t = materialise(spmv(a, s))
        tt = dot(t, t)
        omega = dot(t, s) / tt if tt else 0.0
        x = materialise(axpy(axpy(x, p, alpha), s, omega))
        r = materialise(axpy(s, t, -omega))
        rho, old = dot(shadow, r), rho
        if not rho or not omega:
            break
        p = materialise(axpy(r, axpy(p, v, -omega), rho / old * alpha / omega))
    return x, max_iter, _length(r) / size < tol, h


def power_iteration(a: DataFrame, n: int, tol: float = 1e-10, max_iter: int = 100):
    """(eigenvalue, vector, iterations, converged)."""
    x = materialise(a.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(n**-0.5).alias("v")))
    value = 0.0
    for k in range(max_iter):
        y = materialise(spmv(a, x))
        new, size = dot(x, y), _length(y)
        if not size:
            return 0.0, x, k, True
        x = materialise(y.withColumn("v", F.col("v") / size))
        if abs(new - value) < tol * max(1.0, abs(new)):
            return new, x, k + 1, True
        value = new
    return value, x, max_iter, False


def spectral_radius(a: DataFrame, n: int, **options) -> float:
    return abs(power_iteration(a, n, **options)[0])


def randomized_range(a: DataFrame, size: int, power_iterations: int = 1, seed: int = 0) -> DataFrame:
    """(i, j, v) spanning the range of A: A times a matrix of hashed normals, which no task has to store."""
    from gridflux.operators.stats import uniform_hash

    u1, u2 = uniform_hash(F.lit(seed), F.lit(1), F.col("i"), F.col("j")), uniform_hash(F.lit(seed), F.lit(2), F.col("i"), F.col("j"))
    cols = a.select(F.col("j").alias("i")).distinct()
    omega = cols.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).cast("bigint")).withColumn("v", F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * F.pi() * u2))
    y = materialise(spmm(a, omega))
    for _ in range(power_iterations):
        t = a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        y = materialise(spmm(a, materialise(spmm(t, y))))
    return y


