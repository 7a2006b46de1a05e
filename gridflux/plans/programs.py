"""Queries of exact derivatives, stochastic paths, generators, programs and adaptive quadrature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridflux.functions import autodiff as ad
from gridflux.kernels import programs
from gridflux.operators import adaptive, generators, sde
from gridflux.operators.batch import solve_columns, solve_rows
from gridflux.plans.base import query

# exact derivatives of one function of two columns

_XY = "(SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) / 5000 AS x, CAST(s_nationkey + 1 AS DOUBLE) / 10 AS y FROM supplier) p"
_FX, _FY = "y*cos(x*y) + 2*x/y + exp(-y)", "x*cos(x*y) - x*x/(y*y) - x*exp(-y)"
_FXX, _FXY, _FYY = "-y*y*sin(x*y) + 2/y", "cos(x*y) - x*y*sin(x*y) - 2*x/(y*y) - exp(-y)", "-x*x*sin(x*y) + 2*x*x/(y*y*y) + x*exp(-y)"


def _xy(t):
    return t("supplier").select("s_suppkey", (F.col("s_acctbal").cast("double") / 5000).alias("x"), ((F.col("s_nationkey") + 1).cast("double") / 10).alias("y"))


def _field(v):
    x, y = v
    return ad.sin(x * y) + x * x / y + ad.exp(-y) * x


def _pair(v):
    x, y = v
    return [x * y**2, ad.log(y) * ad.tanh(x)]


def _derivatives(name: str, sql: str, make) -> None:
    """make([x, y]) -> {column: expression}."""
    cols = [c.strip().split(" AS ")[-1] for c in sql.split(";")]

    @query(f"ad_{name}", doubles=" ".join(cols), ints="s_suppkey", digits=7, sql=f"SELECT s_suppkey, {sql.replace(';', ',')} FROM {_XY}")
    def plan(spark, t):
        return _xy(t).select("s_suppkey", *(e.alias(c) for c, e in make([F.col("x"), F.col("y")]).items()))


_GRADIENT = f"{_FX} AS fx; {_FY} AS fy"
_JACOBIAN = "y*y AS a; 2*x*y AS b; ln(y)*(1 - tanh(x)*tanh(x)) AS c; tanh(x)/y AS d"
_derivatives("forward_gradient", _GRADIENT, lambda v: dict(zip(("fx", "fy"), ad.forward_gradient(_field, v))))
_derivatives("gradient", _GRADIENT, lambda v: dict(zip(("fx", "fy"), ad.gradient(_field, v))))
_derivatives("value_and_grad", f"sin(x*y) + x*x/y + exp(-y)*x AS f; {_GRADIENT}", lambda v: dict(zip(("f", "fx", "fy"), (lambda r: (r[0], *r[1]))(ad.value_and_grad(_field, v)))))
_derivatives("hessian", f"{_FXX} AS xx; {_FXY} AS xy; {_FYY} AS yy", lambda v: (lambda h: {"xx": h[0][0], "xy": h[1][0], "yy": h[1][1]})(ad.hessian(_field, v)))
_derivatives("hessian_vector_product", f"2*({_FXX}) - ({_FXY}) AS hx; 2*({_FXY}) - ({_FYY}) AS hy", lambda v: dict(zip(("hx", "hy"), ad.hessian_vector_product(_field, v, [2.0, -1.0]))))
_derivatives("second_derivative", "-9*sin(3*x) + 6*x AS d", lambda v: {"d": ad.second_derivative(lambda x: ad.sin(3 * x) + x**3, v[0])})
_derivatives("derivative", "1/(1 + x*x) + cosh(x) AS d", lambda v: {"d": ad.derivative(lambda x: ad.arctan(x) + ad.sinh(x), v[0])})
_derivatives("forward_jacobian", _JACOBIAN, lambda v: dict(zip("abcd", sum(ad.forward_jacobian(_pair, v), []))))
_derivatives("jacobian", _JACOBIAN, lambda v: dict(zip("abcd", sum(ad.jacobian(_pair, v), []))))

# stochastic paths, driven by increments that SQL can repeat; x' = 0.3 x + 0.2 x noise

_W = "SELECT s_suppkey, CAST(s_nationkey + 1 AS DOUBLE) AS x0, k, 0.0625 AS h, 0.25 * sin(12.9898 * s_suppkey + 78.233 * k) AS w FROM supplier, range(16) r(k)"
_Z = "(0.3*h + 0.2*w)"
GROWTH = {
    "euler_maruyama": f"1 + {_Z}", "milstein": f"1 + {_Z} + 0.02*(w*w - h)", "stochastic_heun": f"1 + {_Z} + {_Z}*{_Z}/2",
    "stochastic_rk": f"1 + {_Z} + 0.2*(0.3*h + 0.2*sqrt(h))*(w*w - h)/(2*sqrt(h))", "implicit_milstein": "(1 + 0.15*h + 0.2*w + 0.02*(w*w - h)) / (1 - 0.15*h)",
}


def _noise(path, k):
    return F.sin(12.9898 * path + 78.233 * k)


def _paths(t):
    return t("supplier").select("s_suppkey", (F.col("s_nationkey") + 1).cast("double").alias("x0"))


def _growth(name: str) -> None:
    @query(f"sde_{name}", doubles="x", ints="s_suppkey", digits=6, sql=f"SELECT s_suppkey, max(x0) * product({GROWTH[name]}) AS x FROM ({_W}) w GROUP BY 1")
    def plan(spark, t):
        return sde.simulate(_paths(t), "s_suppkey", "x0", lambda x: 0.3 * x, lambda x: 0.2 * x, 1.0, 16, name, noise=_noise)


for _name in GROWTH:
    _growth(_name)

_PATH = f"b AS (SELECT s_suppkey, k + 1 AS k, (k + 1) * h AS t, sum(w) OVER (PARTITION BY s_suppkey ORDER BY k) AS w FROM ({_W}) d UNION ALL SELECT s_suppkey, 0, 0, 0 FROM supplier)"


@query("sde_brownian_path", doubles="t w", ints="s_suppkey k", sql=f"WITH {_PATH} SELECT * FROM b")
def sde_brownian_path(spark, t):
    return sde.brownian_paths(_paths(t), "s_suppkey", 1.0, 16, _noise)


@query("sde_brownian_bridge", doubles="x", ints="s_suppkey k", sql=f"WITH {_PATH} SELECT s_suppkey, k, 2 + w + t * (3 - max(CASE WHEN k = 16 THEN w END) OVER (PARTITION BY s_suppkey)) AS x FROM b")
def sde_brownian_bridge(spark, t):
    return sde.brownian_bridges(_paths(t), "s_suppkey", 1.0, 16, 2.0, 5.0, _noise).drop("t")


@query("sde_geometric_brownian_motion", doubles="x", ints="s_suppkey k", sql=f"WITH {_PATH} SELECT s_suppkey, k, (s_nationkey + 1) * exp(0.28 * t + 0.2 * w) AS x FROM b JOIN supplier USING (s_suppkey)")
def sde_geometric_brownian_motion(spark, t):
    return sde.geometric_brownian_motion(_paths(t), "s_suppkey", "x0", 0.3, 0.2, 1.0, 16, _noise).drop("t")


@query("sde_ornstein_uhlenbeck", doubles="x", ints="s_suppkey", sql=f"SELECT s_suppkey, 1.5 + (max(x0) - 1.5) * exp(-2) + sum(0.4 * sqrt((1 - exp(-4*h)) / 4) * 4 * w * exp(-2*h*(15 - k))) AS x FROM ({_W}) w GROUP BY 1")
def sde_ornstein_uhlenbeck(spark, t):
    return sde.ornstein_uhlenbeck(_paths(t), "s_suppkey", "x0", 2.0, 1.5, 0.4, 1.0, 16, _noise)


# generators


def _states(name: str, step: str, make) -> None:
    sql = f"WITH RECURSIVE s(n, x) AS (SELECT CAST(0 AS BIGINT), CAST(7 AS BIGINT) UNION ALL SELECT n + 1, {step} FROM s WHERE n < 300) SELECT n, x FROM s"

    @query(f"rng_{name}", ints="n x", sql=sql)
    def plan(spark, t):
        return spark.range(301).select(F.col("id").alias("n"), make(F.col("id")).alias("x"))


_states("lcg", "(1103515245 * x + 12345) % 2147483648", lambda n: generators.lcg(n, 7))
_states("park_miller", "16807 * x % 2147483647", lambda n: generators.park_miller(n, 7))


@query("rng_middle_square", doubles="u", ints="n_nationkey k", digits=4, sql="WITH RECURSIVE s(n_nationkey, k, x) AS (SELECT n_nationkey, CAST(-1 AS BIGINT), CAST(1234 + 17 * n_nationkey AS BIGINT) FROM nation UNION ALL SELECT n_nationkey, k + 1, x * x // 100 % 10000 FROM s WHERE k < 19) SELECT n_nationkey, k, x / 10000.0 AS u FROM s WHERE k >= 0")
def rng_middle_square(spark, t):
    return generators.middle_square(t("nation").select("n_nationkey", (1234 + 17 * F.col("n_nationkey")).alias("seed")), "n_nationkey", "seed", 20)


@query("rng_latin_hypercube", ints="stratum n0 n1", sql="SELECT range AS stratum, 1 AS n0, 1 AS n1 FROM range(1000)")
def rng_latin_hypercube(spark, t):
    """Points per stratum of both dimensions: one each."""
    points = generators.latin_hypercube(spark, 1000, 2).select(F.explode(F.array(*(F.struct(F.lit(k).alias("d"), F.floor(F.col(f"x{k}") * 1000).alias("stratum")) for k in (0, 1)))).alias("p"))
    return points.groupBy("p.stratum").agg(*(F.count_if(F.col("p.d") == k).alias(f"n{k}") for k in (0, 1)))


# programs: one per nation


def _nations(t):
    return t("nation").select("n_nationkey", (F.col("n_nationkey") + 1).cast("double").alias("k"), (F.col("n_nationkey") / 10.0 + 1).alias("a"), (F.col("n_regionkey") / 10.0 + 2).alias("b"))


def _linear(name: str) -> None:
    @query(f"opt_linprog_{name}", doubles="x y value", ints="n_nationkey", digits=4, sql="SELECT n_nationkey, 3.0 * (n_nationkey + 1) AS x, 1.0 * (n_nationkey + 1) AS y, -11.0 * (n_nationkey + 1) AS value FROM nation")
    def plan(spark, t):
        def kernel(k):
            x, value = programs.linprog([-3, -2], [[1, 1], [1, 3], [1, 0]], [4 * k, 9 * k, 3 * k], method=name)
            return {"x": x[0], "y": x[1], "value": value}

        return solve_rows(_nations(t), kernel, ["k"], "x double, y double, value double", ["n_nationkey"])


for _name in programs.SOLVERS:
    _linear(_name)

# the nearest point to (a, b) within x + y <= 1
NEAREST = {
    "solve_qp": lambda a, b, f, g: programs.solve_qp(2 * np.eye(2), [-2 * a, -2 * b], [[1, 1]], [1])[0],
    "active_set_qp": lambda a, b, f, g: programs.active_set_qp(2 * np.eye(2), [-2 * a, -2 * b], [[1, 1], [1, -1]], [1, 50]),
    "penalty_method": lambda a, b, f, g: programs.penalty_method(f, [0.0, 0.0], ineq=g), "augmented_lagrangian": lambda a, b, f, g: programs.augmented_lagrangian(f, [0.0, 0.0], ineq=g),
    "barrier_method": lambda a, b, f, g: programs.barrier_method(f, [0.0, 0.0], g),
}


def _nearest(name: str) -> None:
    @query(f"opt_{name}", doubles="x y", ints="n_nationkey", digits=3, sql="SELECT n_nationkey, (n_nationkey - n_regionkey) / 20.0 AS x, 1 - (n_nationkey - n_regionkey) / 20.0 AS y FROM nation")
    def plan(spark, t):
        def kernel(a, b):
            x = NEAREST[name](a, b, lambda v: (v[0] - a) ** 2 + (v[1] - b) ** 2, lambda v: v[0] + v[1] - 1)
            return {"x": float(x[0]), "y": float(x[1])}

        return solve_rows(_nations(t), kernel, ["a", "b"], "x double, y double", ["n_nationkey"])


for _name in NEAREST:
    _nearest(_name)


@query("opt_assignment", doubles="cost", ints="n_nationkey i j", sql="SELECT n_nationkey, i, 4 - i AS j, 35.0 * (n_nationkey + 1) AS cost FROM nation, range(5) r(i)")
def opt_assignment(spark, t):
    """Costs are products of row and column numbers, so that the order turns round."""

    def kernel(k):
        js, cost = programs.assignment(k * np.outer(np.arange(1, 6), np.arange(1, 6)))
        return {"js": js.astype(float), "cost": cost}

    out = solve_rows(_nations(t), kernel, ["k"], "js array<double>, cost double", ["n_nationkey"])
    return out.select("n_nationkey", "cost", F.posexplode("js").alias("i", "j"))


# adaptive quadrature
INTEGRALS = {
    "adaptive_gauss": ("(1 - exp(-k)) / k", lambda k: adaptive.adaptive(lambda p, x: np.exp(-p * x), k, 0 * k, 0 * k + 1)),
    "adaptive_simpson": ("(1 - exp(-k)) / k", lambda k: adaptive.adaptive(lambda p, x: np.exp(-p * x), k, 0 * k, 0 * k + 1, "simpson")),
    "adaptive_trapezoid": ("(1 - exp(-k)) / k", lambda k: adaptive.adaptive(lambda p, x: np.exp(-p * x), k, 0 * k, 0 * k + 1, "trapezoid", 1e-8)),
    "adaptive_root": ("2 * pow(k, 1.5) / 3", lambda k: adaptive.adaptive(lambda p, x: np.sqrt(x), k, 0 * k, k)),
    "quad_line": ("sqrt(pi() / k)", lambda k: adaptive.quad(lambda p, x: np.exp(-p * x * x), k, -np.inf, np.inf)),
    "quad_half_line": ("1 / k", lambda k: adaptive.quad(lambda p, x: np.exp(-p * x), k, 0.0, np.inf)),
    "quad_left_half_line": ("1 / k", lambda k: adaptive.quad(lambda p, x: np.exp(p * x), k, -np.inf, 0.0)),
}


def _integral(name: str) -> None:
    formula, solve = INTEGRALS[name]

    @query(f"quad_{name}", doubles="integral", ints="n_nationkey converged", digits=6, sql=f"SELECT n_nationkey, {formula} AS integral, 1 AS converged FROM (SELECT n_nationkey, CAST(n_nationkey + 1 AS DOUBLE) AS k FROM nation) n")
    def plan(spark, t):
        def kernel(k):
            value, _, ok = solve(k)
            return {"integral": value, "converged": ok.astype("int64")}

        return solve_columns(_nations(t), kernel, ["k"], "integral double, converged bigint", ["n_nationkey"])


for _name in INTEGRALS:
    _integral(_name)
