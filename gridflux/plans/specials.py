"""Queries of the special functions and orthogonal polynomials, by closed forms and by identities between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridflux.functions import polynomials as poly
from gridflux.kernels import special as sp
from gridflux.plans.base import query


def _each(f):
    """f element by element, for kernels that take one number."""
    return lambda x: np.array([float(f(float(v))) for v in x])


# name: (kernel over x, SQL over x); x runs from 0.1 to 5
IDENTITIES = {
    "gamma": (_each(lambda x: sp.gamma(x)), "gamma(x)"), "log_gamma": (_each(lambda x: sp.log_gamma(x)), "lgamma(x)"), "beta": (_each(lambda x: sp.beta(x, 2.0)), "1 / (x * (x + 1))"), "log_beta": (_each(lambda x: sp.log_beta(x, 2.0)), "-ln(x * (x + 1))"),
    "factorial": (_each(lambda x: sp.factorial(round(x * 2))), "factorial(CAST(round(x * 2) AS INTEGER))"), "binomial": (_each(lambda x: sp.binomial(round(x * 2) + 2, 2)), "(round(x * 2) + 2) * (round(x * 2) + 1) / 2"),
    "logistic": (sp.logistic, "1 / (1 + exp(-x))"), "logit": (lambda x: sp.logit(1 / (1 + np.exp(-x))), "x"), "erfinv": (_each(lambda x: np.vectorize(__import__("math").erf)(sp.erfinv(x / 10))), "x / 10"),
    "digamma": (lambda x: sp.digamma(x + 1) - sp.digamma(x), "1 / x"), "trigamma": (lambda x: sp.trigamma(x) - sp.trigamma(x + 1), "1 / (x * x)"), "polygamma": (lambda x: sp.polygamma(2, x + 1) - sp.polygamma(2, x), "2 / (x * x * x)"),
    "regularized_gamma_p": (_each(lambda x: sp.regularized_gamma_p(1.0, x)), "1 - exp(-x)"), "regularized_gamma_q": (_each(lambda x: sp.regularized_gamma_q(2.0, x)), "exp(-x) * (1 + x)"),
    "incomplete_gamma_lower": (_each(lambda x: sp.incomplete_gamma_lower(1.0, x)), "1 - exp(-x)"), "incomplete_gamma_upper": (_each(lambda x: sp.incomplete_gamma_upper(2.0, x)), "exp(-x) * (1 + x)"),
    "incomplete_beta": (_each(lambda x: sp.incomplete_beta(1.0, 2.0, x / 5.1)), "1 - (1 - x / 5.1) * (1 - x / 5.1)"),
    "bessel_j_y": (lambda x: sp.bessel_j1(x) * sp.bessel_y0(x) - sp.bessel_j0(x) * sp.bessel_y1(x), "2 / (pi() * x)"), "bessel_jn": (lambda x: sp.bessel_jn(3, x) + sp.bessel_j1(x) - 4 / x * sp.bessel_jn(2, x), "0 * x"),
    "bessel_yn": (lambda x: sp.bessel_yn(2, x) + sp.bessel_y0(x) - 2 / x * sp.bessel_y1(x), "0 * x"), "bessel_i_k": (lambda x: sp.bessel_i0(x) * sp.bessel_k1(x) + sp.bessel_i1(x) * sp.bessel_k0(x), "1 / x"),
    "bessel_in": (lambda x: sp.bessel_in(2, x) - sp.bessel_i0(x) + 2 / x * sp.bessel_i1(x), "0 * x"), "bessel_kn": (lambda x: sp.bessel_kn(2, x) - sp.bessel_k0(x) - 2 / x * sp.bessel_k1(x), "0 * x"),
    "elliptic": (_each(lambda x: sp.elliptic_e(x / 6) * sp.elliptic_k(1 - x / 6) + sp.elliptic_e(1 - x / 6) * sp.elliptic_k(x / 6) - sp.elliptic_k(x / 6) * sp.elliptic_k(1 - x / 6)), "pi() / 2 + 0 * x"),
    "expint_n": (_each(lambda x: 2 * sp.expint_n(3, x) + x * sp.expint_n(2, x)), "exp(-x)"), "lambert_w": (lambda x: sp.lambert_w(x * np.exp(x)), "x"), "zeta": (_each(lambda x: sp.zeta(2.0)), "pi() * pi() / 6 + 0 * x"),
    "hyp1f1": (_each(lambda x: sp.hyp1f1(1.0, 2.0, x)), "(exp(x) - 1) / x"), "hyp2f1": (_each(lambda x: sp.hyp2f1(1.0, 1.0, 2.0, -x / 6)), "ln(1 + x / 6) * 6 / x"),
    "spherical_bessel_j": (lambda x: sp.spherical_bessel_j(1, x), "sin(x) / (x * x) - cos(x) / x"), "spherical_bessel_y": (lambda x: sp.spherical_bessel_y(0, x), "-cos(x) / x"),
}


def _identity(name: str) -> None:
    kernel, formula = IDENTITIES[name]

    @query(f"special_{name}", doubles="v", ints="k", digits=6, sql=f"SELECT k, {formula} AS v FROM (SELECT k, k / 10.0 AS x FROM (SELECT DISTINCT p_size AS k FROM part) d) p")
    def plan(spark, t):
        rows = t("part").select(F.col("p_size").alias("k")).distinct()
        return rows.select("k", sp.column(lambda x: np.asarray(kernel(x), float))((F.col("k") / 10.0).cast("double")).alias("v"))


for _name in IDENTITIES:
    _identity(_name)

# polynomials in closed form, on (0, 1]
ORTHOGONAL = {
    "legendre": (lambda x: poly.legendre(3, x), "(5*x*x*x - 3*x) / 2"), "chebyshev_t": (lambda x: poly.chebyshev_t(4, x), "8*x*x*x*x - 8*x*x + 1"), "chebyshev_u": (lambda x: poly.chebyshev_u(3, x), "8*x*x*x - 4*x"),
    "hermite_physicists": (lambda x: poly.hermite_physicists(3, x), "8*x*x*x - 12*x"), "hermite_probabilists": (lambda x: poly.hermite_probabilists(3, x), "x*x*x - 3*x"), "laguerre": (lambda x: poly.laguerre(2, x), "(x*x - 4*x + 2) / 2"),
    "generalized_laguerre": (lambda x: poly.generalized_laguerre(2, 1.0, x), "(x*x - 6*x + 6) / 2"), "gegenbauer": (lambda x: poly.gegenbauer(2, 1.5, x), "(15*x*x - 3) / 2"), "jacobi": (lambda x: poly.jacobi_polynomial(1, 1.0, 2.0, x), "2 + 5 * (x - 1) / 2 "),
    "horner": (lambda x: poly.horner([2.0, -3.0, 1.0], x), "2*x*x - 3*x + 1"), "horner_derivative": (lambda x: poly.horner(poly.polyder([2.0, -3.0, 1.0, 5.0]), x), "6*x*x - 6*x + 1"),
    "polyint": (lambda x: poly.horner(poly.polyint([3.0, 2.0]), x), "1.5*x*x + 2*x"), "polymul": (lambda x: poly.horner(poly.polymul([1.0, 1.0], [1.0, -1.0]), x), "x*x - 1"),
    "polyadd": (lambda x: poly.horner(poly.polyadd([1.0, 0.0, 2.0], [3.0, 1.0]), x), "x*x + 3*x + 3"), "polysub": (lambda x: poly.horner(poly.polysub([1.0, 0.0, 2.0], [3.0, 1.0]), x), "x*x - 3*x + 1"),
    "polydiv": (lambda x: poly.horner(poly.polydiv([1.0, 0.0, -1.0], [1.0, -1.0])[0], x), "x + 1"), "deflate": (lambda x: poly.horner(poly.deflate([1.0, -3.0, 2.0], 1.0), x), "x - 2"),
    "bezier": (lambda x: poly.bezier([1.0, 3.0, 2.0], x), "(1-x)*(1-x) + 6*x*(1-x) + 2*x*x"), "rational_bezier": (lambda x: poly.rational_bezier([1.0, 3.0, 2.0], [1.0, 2.0, 1.0], x), "((1-x)*(1-x) + 12*x*(1-x) + 2*x*x) / ((1-x)*(1-x) + 4*x*(1-x) + x*x)"),
    "clenshaw": (lambda x: poly.chebyshev_evaluate([1.0, 2.0, 3.0], x), "1 + 2*x + 3*(2*x*x - 1)"), "minmod": (lambda x: poly.minmod(x, x * 2 - 0.5), "CASE WHEN 2*x - 0.5 <= 0 THEN 0 ELSE least(x, 2*x - 0.5) END"),
    "project_box": (lambda x: poly.project_box(x, 0.3, 0.6), "least(greatest(x, 0.3), 0.6)"), "prox_l1": (lambda x: poly.prox_l1(x, 0.4), "greatest(x - 0.4, 0)"),
}


def _orthogonal(name: str) -> None:
    column, formula = ORTHOGONAL[name]

    @query(f"poly_{name}", doubles="v", ints="k", digits=8, sql=f"SELECT k, {formula} AS v FROM (SELECT k, k / 50.0 AS x FROM (SELECT DISTINCT p_size AS k FROM part) d) p")
    def plan(spark, t):
        rows = t("part").select(F.col("p_size").alias("k")).distinct().withColumn("x", (F.col("k") / 50.0).cast("double"))
        return rows.select("k", column(F.col("x")).alias("v"))


for _name in ORTHOGONAL:
    _orthogonal(_name)
