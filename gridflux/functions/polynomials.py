"""Polynomials and orthogonal families as column expressions. Coefficients run from the highest degree, as lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def horner(coeffs: list, x: Column) -> Column:
    out = _c(coeffs[0])
    for c in coeffs[1:]:
        out = out * x + _c(c)
    return out


polyval = horner


def horner_array(coeffs: Column, x: Column) -> Column:
    """For an array column of coefficients."""
    return F.aggregate(coeffs, F.lit(0.0), lambda a, c: a * x + c)


def polyder(coeffs: list[float], m: int = 1) -> list[float]:
    for _ in range(m):
        n = len(coeffs) - 1
        coeffs = [c * (n - k) for k, c in enumerate(coeffs[:-1])] or [0.0]
    return coeffs


def polyint(coeffs: list[float], k: float = 0.0) -> list[float]:
    n = len(coeffs)
    return [c / (n - j) for j, c in enumerate(coeffs)] + [k]


def polyadd(a: list[float], b: list[float]) -> list[float]:
    n = max(len(a), len(b))
    return [x + y for x, y in zip([0.0] * (n - len(a)) + list(a), [0.0] * (n - len(b)) + list(b))]


def polysub(a: list[float], b: list[float]) -> list[float]:
    return polyadd(a, [-x for x in b])


def polymul(a: list[float], b: list[float]) -> list[float]:
    out = [0.0] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return out


def polydiv(a: list[float], b: list[float]) -> tuple[list[float], list[float]]:
    rest, q = list(map(float, a)), []
    while len(rest) >= len(b):
        f = rest[0] / b[0]
        q.append(f)
        for k, y in enumerate(b):
            rest[k] -= f * y
        rest.pop(0)
    return q or [0.0], rest or [0.0]


def horner_derivative(coeffs: list, x: Column) -> Column:
    p, d = _c(coeffs[0]), F.lit(0.0)
    for c in coeffs[1:]:
        d, p = d * x + p, p * x + _c(c)
    return F.struct(p.alias("value"), d.alias("derivative"))


def synthetic_division(coeffs: list[float], r: float) -> tuple[list[float], float]:
    out = [coeffs[0]]
    for c in coeffs[1:]:
        out.append(c + out[-1] * r)
    return out[:-1], out[-1]


def deflate(coeffs: list[float], root: float) -> list[float]:
    return synthetic_division(coeffs, root)[0]


def root_bounds(coeffs: list[float]) -> tuple[float, float]:
    """Cauchy's bounds on the moduli of the roots."""
    lead, tail = abs(coeffs[0]), abs(coeffs[-1])
    upper = 1 + max((abs(c) / lead for c in coeffs[1:]), default=0.0)
    lower = tail / (tail + max((abs(c) for c in coeffs[:-1]), default=1.0)) if tail else 0.0
    return lower, upper


def _three_term(n: int, x: Column, first: Column, step) -> Column:
    """p_{k+1} = step(k, p_k, p_{k-1}); values ride in an array, so that the expression stays of constant size in n."""
    if n == 0:
        return F.lit(1.0) + 0.0 * x
    start = F.array(F.lit(1.0) + 0.0 * x, first)
    out = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>"), start, lambda a, k: F.array(a[1], step(k.cast("double"), a[1], a[0])))
    return out[1]


def legendre(n: int, x: Column) -> Column:
    return _three_term(n, x, x, lambda k, p, q: ((2 * k + 1) * x * p - k * q) / (k + 1))


def chebyshev_t(n: int, x: Column) -> Column:
    return _three_term(n, x, x, lambda k, p, q: 2 * x * p - q)


def chebyshev_u(n: int, x: Column) -> Column:
    return _three_term(n, x, 2 * x, lambda k, p, q: 2 * x * p - q)


def hermite_physicists(n: int, x: Column) -> Column:
    return _three_term(n, x, 2 * x, lambda k, p, q: 2 * x * p - 2 * k * q)


def hermite_probabilists(n: int, x: Column) -> Column:
    return _three_term(n, x, x, lambda k, p, q: x * p - k * q)


def generalized_laguerre(n: int, alpha: float, x: Column) -> Column:
    return _three_term(n, x, 1 + alpha - x, lambda k, p, q: ((2 * k + 1 + alpha - x) * p - (k + alpha) * q) / (k + 1))


def laguerre(n: int, x: Column) -> Column:
    return generalized_laguerre(n, 0.0, x)


def gegenbauer(n: int, alpha: float, x: Column) -> Column:
    return _three_term(n, x, 2 * alpha * x, lambda k, p, q: (2 * (k + alpha) * x * p - (k + 2 * alpha - 1) * q) / (k + 1))


def jacobi_polynomial(n: int, a: float, b: float, x: Column) -> Column:
    def step(k, p, q):
        m = k + 1
        s = 2 * m + a + b
        return ((s - 1) * (s * (s - 2) * x + a * a - b * b) * p - 2 * (m + a - 1) * (m + b - 1) * s * q) / (2 * m * (m + a + b) * (s - 2))

    return _three_term(n, x, (a + 1) + (a + b + 2) * (x - 1) / 2, step)


def clenshaw(coeffs: list[float], t: Column) -> Column:
    """Sum of c_k T_k(t), lowest degree first."""
    out = F.aggregate(F.array(*(F.lit(float(c)) for c in reversed(coeffs[1:]))) if len(coeffs) > 1 else F.array().cast("array<double>"), F.array(F.lit(0.0), F.lit(0.0)), lambda a, c: F.array(2 * t * a[0] - a[1] + c, a[0]))
    return coeffs[0] + t * out[0] - out[1]


def chebyshev_evaluate(coeffs: list[float], x: Column, a: float = -1.0, b: float = 1.0) -> Column:
    return clenshaw(coeffs, (2 * x - a - b) / (b - a))


def lagrange_coefficients(xs: list[float], ys: list[float]) -> list[float]:
    out = [0.0] * len(xs)
    for i, (xi, yi) in enumerate(zip(xs, ys)):
        p = [1.0]
        for j, xj in enumerate(xs):
            if j != i:
                p = [c / (xi - xj) for c in polymul(p, [1.0, -xj])]
        out = polyadd(out, [yi * c for c in p])
    return out


def bspline_basis(i: int, k: int, knots: list[float], t: Column) -> Column:
    """Cox-de Boor; the last knot belongs to the last interval."""
    if k == 0:
        last = knots[i + 1] == knots[-1] and knots[i] < knots[i + 1]
        return F.when((t >= knots[i]) & ((t <= knots[i + 1]) if last else (t < knots[i + 1])), 1.0).otherwise(0.0)
    out = F.lit(0.0)
    if knots[i + k] > knots[i]:
        out = out + (t - knots[i]) / (knots[i + k] - knots[i]) * bspline_basis(i, k - 1, knots, t)
    if knots[i + k + 1] > knots[i + 1]:
        out = out + (knots[i + k + 1] - t) / (knots[i + k + 1] - knots[i + 1]) * bspline_basis(i + 1, k - 1, knots, t)
    return out


def bspline(points: list[float], knots: list[float], degree: int, t: Column) -> Column:
    terms = [p * bspline_basis(i, degree, knots, t) for i, p in enumerate(points)]
    return sum(terms[1:], terms[0])


def nurbs(points: list[float], weights: list[float], knots: list[float], degree: int, t: Column) -> Column:
    return bspline([p * w for p, w in zip(points, weights)], knots, degree, t) / bspline(weights, knots, degree, t)


def bezier(points: list[float], t: Column) -> Column:
    """De Casteljau on one coordinate of the control points."""
    level: list = [F.lit(float(p)) for p in points]
    while len(level) > 1:
        level = [(1 - t) * a + t * b for a, b in zip(level, level[1:])]
    return level[0]


def rational_bezier(points: list[float], weights: list[float], t: Column) -> Column:
    return bezier([p * w for p, w in zip(points, weights)], t) / bezier(weights, t)


def bezier_derivative(points: list[float], order: int = 1) -> list[float]:
    for _ in range(order):
        n = len(points) - 1
        points = [n * (b - a) for a, b in zip(points, points[1:])]
    return points


def open_uniform_knots(n_control: int, degree: int) -> list[float]:
    inner = n_control - degree - 1
    return [0.0] * (degree + 1) + [(k + 1) / (inner + 1) for k in range(inner)] + [1.0] * (degree + 1)


def project_box(x: Column, lower: float, upper: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lower))), F.lit(float(upper)))


def prox_l1(x: Column, t: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def flux_limiter(r: Column, kind: str) -> Column:
    zero, one, two = F.lit(0.0), F.lit(1.0), F.lit(2.0)
    return {
        "minmod": lambda: F.greatest(zero, F.least(one, r)),
        "superbee": lambda: F.greatest(zero, F.least(two * r, one), F.least(r, two)),
        "van_leer": lambda: (r + F.abs(r)) / (1 + F.abs(r)),
        "mc": lambda: F.greatest(zero, F.least(two * r, (1 + r) / 2, two)),
        "van_albada": lambda: F.when(r > 0, (r * r + r) / (r * r + 1)).otherwise(0.0),
    }[kind]()


def minmod(a: Column, b: Column) -> Column:
    return F.when(a * b <= 0, 0.0).when(F.abs(a) < F.abs(b), a).otherwise(b)
