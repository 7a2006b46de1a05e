"""Queries of differential equations on grids: every row is a problem that starts from one wave, whose growth per step SQL knows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridflux.kernels import boundary, pde
from gridflux.operators.batch import solve_columns, solve_rows
from gridflux.plans.base import query

#: a is the size of the wave, k from 1 to 25 sets the coefficient of the problem.
_WAVES = "SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) / 1000 AS a, CAST(s_nationkey + 1 AS DOUBLE) AS k FROM supplier"


def _wave(name: str, sql: str, solve, digits: int = 6, **values: str) -> None:
    """solve(a, k) -> u at the point where the wave has its size; `values` are columns that `sql` uses."""
    inner = ", ".join(f"{v} AS {c}" for c, v in values.items())
    text = f"SELECT s_suppkey, {sql} AS u FROM (SELECT *{', ' + inner if inner else ''} FROM ({_WAVES}) w) v"

    @query(f"pde_{name}", doubles="u", ints="s_suppkey", digits=digits, sql=text)
    def plan(spark, t):
        rows = t("supplier").select("s_suppkey", (F.col("s_acctbal").cast("double") / 1000).alias("a"), (F.col("s_nationkey") + 1).cast("double").alias("k"))
        return solve_columns(rows, lambda a, k: {"u": solve(a, k)}, ["a", "k"], "u double")


def _arch(a: np.ndarray, n: int = 20) -> np.ndarray:
    """Half a sine over n cells, zero at both ends."""
    return a[:, None] * np.sin(np.pi * np.arange(n + 1) / n)


def _dome(a: np.ndarray, n: int = 20) -> np.ndarray:
    s = np.sin(np.pi * np.arange(n + 1) / n)
    return a[:, None, None] * np.outer(s, s)


def _ring(a: np.ndarray, n: int = 32) -> np.ndarray:
    """A cosine around a periodic grid of n points."""
    return a[:, None] * np.cos(2 * np.pi * np.arange(n) / n)


_S = "pow(sin(pi() / 40), 2)"
_HEAT = {"r": "k / 60", "s": _S}
_wave("heat_ftcs", "a * pow(1 - 4 * r * s, 30)", lambda a, k: pde.heat_ftcs(_arch(a), k / 60, 30)[:, 10], **_HEAT)
_wave("heat_btcs", "a * pow(1 / (1 + 4 * r * s), 30)", lambda a, k: pde.heat_btcs(_arch(a), k / 60, 30)[:, 10], **_HEAT)
_wave("heat_crank_nicolson", "a * pow((1 - 2 * r * s) / (1 + 2 * r * s), 30)", lambda a, k: pde.heat_crank_nicolson(_arch(a), k / 60, 30)[:, 10], **_HEAT)
_wave("heat_theta", "a * pow((1 - 1.2 * r * s) / (1 + 2.8 * r * s), 30)", lambda a, k: pde.heat_theta(_arch(a), k / 60, 30, 0.7)[:, 10], **_HEAT)
_wave("heat_2d_adi", "a * pow((1 - 2 * r * s) / (1 + 2 * r * s), 20)", lambda a, k: pde.heat_2d_adi(_dome(a), k / 60, 10)[:, 10, 10], **_HEAT)
_wave("diffusion_reaction", "a * pow(0.99 / (1 + 4 * r * s), 30)", lambda a, k: pde.diffusion_reaction(_arch(a), k / 60, 0.01, lambda u: -u, 30)[:, 10], **_HEAT)


def _lines(a, k):
    def rhs(t, y):
        out = np.zeros_like(y)
        out[:, 1:-1] = (k / 60)[:, None] * pde.curvature(y)
        return out

    return pde.method_of_lines(_arch(a), rhs, 30.0, 30)[:, 10]


_wave("method_of_lines", "a * pow(1 + z + z * z / 2 + z * z * z / 6 + z * z * z * z / 24, 30)", _lines, z=f"-4 * k / 60 * {_S}")
_wave("wave_explicit", "a * cos(25 * acos(1 - 2 * c * c * s))", lambda a, k: pde.wave(_arch(a), 0 * _arch(a), k / 30, 1.0, 25)[:, 10], c="k / 30", s=_S)
_wave("wave_implicit", "a * cos(25 * acos(1 - 2 * c * c * s / (1 + c * c * s)))", lambda a, k: pde.wave(_arch(a), 0 * _arch(a), k / 10, 1.0, 25, 0.25)[:, 10], c="k / 10", s=_S)

# transport: the factor of a wave per step as real and imaginary part; p is its phase between neighbouring points
_UPWIND = ("1 - c * (1 - cos(p))", "-c * sin(p)")
_SYMBOLS = {
    "advection_upwind": _UPWIND,
    "lax_friedrichs": ("cos(p)", "-c * sin(p)"),
    "lax_wendroff": ("1 - c * c * (1 - cos(p))", "-c * sin(p)"),
    "maccormack": ("1 - c * c * (1 - cos(p))", "-c * sin(p)"),
    "beam_warming": ("1 - c / 2 * (3 - 4 * cos(p) + cos(2 * p)) + c * c / 2 * (1 - 2 * cos(p) + cos(2 * p))", "-c / 2 * (4 * sin(p) - sin(2 * p)) + c * c / 2 * (2 * sin(p) - sin(2 * p))"),
}


def _transport(name: str, symbol: tuple[str, str], solve) -> None:
    re, im = (x.replace("c *", "(k / 30) *").replace("c /", "(k / 30) /").replace("(p)", "(pi() / 16)").replace("* p)", "* pi() / 16)") for x in symbol)
    _wave(name, "a * pow(sqrt(re * re + im * im), 20) * cos(20 * atan2(im, re))", solve, re=re, im=im)


for _name, _symbol in _SYMBOLS.items():
    _transport(_name, _symbol, lambda a, k, n=_name: pde.advect(n, _ring(a), k / 30, 20)[:, 0])


def _volumes(numerical):
    def solve(a, k):
        c = k[:, None] / 30
        return pde.conservation_law(_ring(a), lambda u: c * u, lambda u: c + 0 * u, 1.0, 1.0, 20, numerical)[:, 0]

    return solve


_transport("fvm_rusanov", _UPWIND, _volumes("rusanov"))
_transport("fvm_hll", _UPWIND, _volumes("hll"))
_transport("fvm_lax_friedrichs", _SYMBOLS["lax_friedrichs"], _volumes(pde.lax_friedrichs_flux(1.0)))
_wave("fourier_heat", "a * exp(-k / 10)", lambda a, k: pde.fourier_heat(_ring(a), k / 10, 1.0)[:, 0])
_wave("fourier_advection", "a * cos(k)", lambda a, k: pde.fourier_advection(_ring(a), k, 1.0)[:, 0])

# elliptic: the right side is a wave, and so is the solution
_wave("poisson_1d", "-a / 400 / (4 * s)", lambda a, k: pde.poisson_1d(_arch(a)[:, 1:-1], 0.05)[:, 9], s=_S)
_wave("poisson_2d", "-a / 400 / (8 * s)", lambda a, k: pde.poisson_2d(_dome(a)[:, 1:-1, 1:-1], 0.05)[:, 9, 9], s=_S)
_wave("poisson_9point", "a / 400 * (1 - 2 * s / 3) / (-8 * s + 8 * s * s / 3)", lambda a, k: pde.poisson_2d(_dome(a)[:, 1:-1, 1:-1], 0.05, 9)[:, 9, 9], s=_S)
_wave("helmholtz_2d", "a / (k * k / 100 - 3200 * s)", lambda a, k: pde.poisson_2d(_dome(a)[:, 1:-1, 1:-1], 0.05, 5, k / 10)[:, 9, 9], s=_S)
_wave("poisson_periodic", "-a / 1024 / (4 * s)", lambda a, k: pde.poisson_periodic(np.repeat(_ring(a)[:, :, None], 8, axis=2), 1 / 32)[:, 0, 0], s="pow(sin(pi() / 32), 2)")
_wave("poisson_neumann", "-a * cos(pi() / 32) / 256 / (4 * s)", lambda a, k: pde.poisson_neumann(np.repeat((a[:, None] * np.cos(np.pi * (np.arange(16) + 0.5) / 16))[:, :, None], 4, axis=2), 1 / 16)[:, 0, 0], s="pow(sin(pi() / 32), 2)")
for _name in ("jacobi", "gauss_seidel", "sor"):
    _wave(f"poisson_{_name}", "-a / 64 / (8 * s)", lambda a, k, n=_name: pde.poisson_2d_iterative(_dome(a, 8), 1 / 8, n)[:, 4, 4], s="pow(sin(pi() / 16), 2)")
for _name in ("v", "w", "full"):
    _wave(f"multigrid_{_name}", "-a / 256 / (8 * s)", lambda a, k, n=_name: pde.multigrid_solve(_dome(a, 16), 1 / 16, n)[:, 8, 8], s="pow(sin(pi() / 32), 2)")
for _order in (1, 2):
    _wave(f"fem_1d_order{_order}", "a / sqrt(k + 0.5) / 8", lambda a, k, o=_order: pde.fem_1d(np.linspace(0, 1, 11), np.repeat((a / np.sqrt(k + 0.5))[:, None], 10, axis=1), order=o)[:, 5 * o])

# boundary values: y'' = k^2 y from 0 to 1; the middle is half the inverse of a hyperbolic cosine
_ZERO = np.zeros_like
_MIDDLE = "SELECT n_nationkey, 1 / (exp(m) + exp(-m)) AS y FROM (SELECT n_nationkey, {m} AS m FROM (SELECT n_nationkey, {w} AS w, (n_nationkey + 1) / 5.0 AS k FROM nation) a) b"
_STEPPED = "ln(w + sqrt(w * w - 1))"
_K2 = "pow((n_nationkey + 1) / 5.0, 2)"
_BOUNDARY = {
    "shooting": ("k / 2", "0", lambda k: boundary.shooting(lambda t, y, d: k * k * y, (0, 1), 0.0, 1.0)[1][100]),
    "linear_shooting": ("k / 2", "0", lambda k: boundary.linear_shooting(lambda t: 0.0, lambda t: k * k, lambda t: 0.0, (0, 1), 0.0, 1.0)[1][100]),
    "collocation": ("k / 2", "0", lambda k: boundary.collocation_bvp(lambda t, y, d: k * k * y, (0, 1), 0.0, 1.0)[1][8]),
    "finite_difference": (f"50 * {_STEPPED}", f"1 + {_K2} / 20000", lambda k: boundary.finite_difference_bvp(_ZERO, lambda t: k * k + 0 * t, _ZERO, (0, 1), 0.0, 1.0)[1][50]),
    "nonlinear_fd": (f"50 * {_STEPPED}", f"1 + {_K2} / 20000", lambda k: boundary.nonlinear_fd_bvp(lambda t, y, d: k * k * y, (0, 1), 0.0, 1.0)[1][50]),
    "galerkin": (f"10 * {_STEPPED}", f"(1 + {_K2} / 1200) / (1 - {_K2} / 2400)", lambda k: boundary.galerkin_bvp(lambda t: k * k, lambda t: 0.0, (0, 1), 0.0, 1.0)[1][10]),
}


def _ends(name: str) -> None:
    middle, w, solve = _BOUNDARY[name]

    @query(f"bvp_{name}", doubles="y", ints="n_nationkey", digits=5, sql=_MIDDLE.format(m=middle, w=w))
    def plan(spark, t):
        return solve_rows(t("nation").select("n_nationkey", ((F.col("n_nationkey") + 1) / 5).cast("double").alias("k")), lambda k: {"y": float(solve(k))}, ["k"], "y double")


for _name in _BOUNDARY:
    _ends(_name)


@query("bvp_sturm_liouville", doubles="first second", ints="n_nationkey", digits=5, sql="SELECT n_nationkey, 40000 * pow(sin(pi() / 200), 2) / (n_nationkey + 1) AS first, 40000 * pow(sin(pi() / 100), 2) / (n_nationkey + 1) AS second FROM nation")
def _sturm_liouville(spark, t):
    def kernel(k):
        first, second = boundary.sturm_liouville(np.ones_like, np.zeros_like, lambda s: k + 0 * s, (0, 1), 100, 2)
        return {"first": float(first), "second": float(second)}

    return solve_rows(t("nation").select("n_nationkey", (F.col("n_nationkey") + 1).cast("double").alias("k")), kernel, ["k"], "first double, second double")
