"""Derivatives of column-valued functions: stencils, complex-free dual numbers, Richardson extrapolation."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def fornberg_weights(z: float, nodes: list[float], order: int) -> list[list[float]]:
    """Weights of derivatives 0..order at z on arbitrary nodes, by exact moments of Lagrange polynomials in z-centred powers."""
    from gridflux.functions.polynomials import polymul

    out = [[0.0] * len(nodes) for _ in range(order + 1)]
    for i, xi in enumerate(nodes):
        p = [1.0]
        for j, xj in enumerate(nodes):
            if j != i:
                p = [c / (xi - xj) for c in polymul(p, [1.0, z - xj])]
        for k in range(min(order, len(p) - 1) + 1):
            out[k][i] = p[len(p) - 1 - k] * math.factorial(k)
    return out


def finite_difference_weights(order: int, accuracy: int = 2, kind: str = "central") -> tuple[list[int], list[float]]:
    n = order + accuracy - (1 if kind == "central" and order % 2 == 0 else 0)
    if kind == "central":
        half = (order + 1) // 2 + accuracy // 2 - 1
        at = list(range(-half, half + 1))
    else:
        at = list(range(n)) if kind == "forward" else list(range(-n + 1, 1))
    return at, fornberg_weights(0.0, [float(a) for a in at], order)[order]


def stencil(f: Fn, x: Column, h: float, order: int = 1, accuracy: int = 2, kind: str = "central") -> Column:
    at, w = finite_difference_weights(order, accuracy, kind)
    terms = [c * f(x + k * h) for k, c in zip(at, w) if abs(c) > 1e-15]
    return sum(terms[1:], terms[0]) / h**order


def forward_difference(f: Fn, x: Column, h: float = 1e-6, order: int = 1) -> Column:
    return stencil(f, x, h, order, 1, "forward")


def backward_difference(f: Fn, x: Column, h: float = 1e-6, order: int = 1) -> Column:
    return stencil(f, x, h, order, 1, "backward")


def central_difference(f: Fn, x: Column, h: float = 1e-5, order: int = 1) -> Column:
    return stencil(f, x, h, order, 2)


def second_derivative(f: Fn, x: Column, h: float = 1e-4) -> Column:
    return stencil(f, x, h, 2, 2)


def third_derivative(f: Fn, x: Column, h: float = 1e-3) -> Column:
    return stencil(f, x, h, 3, 2)


def fourth_derivative(f: Fn, x: Column, h: float = 1e-2) -> Column:
    return stencil(f, x, h, 4, 2)


def five_point_stencil(f: Fn, x: Column, h: float = 1e-3) -> Column:
    return stencil(f, x, h, 1, 4)


def richardson_derivative(f: Fn, x: Column, h: float = 0.1, levels: int = 4) -> Column:
    row = [(f(x + h / 2**k) - f(x - h / 2**k)) / (2 * h / 2**k) for k in range(levels)]
    for j in range(1, levels):
        row = [(4**j * b - a) / (4**j - 1) for a, b in zip(row, row[1:])]
    return row[0]


def optimal_step_size(order: int = 1, accuracy: int = 2, scale: float = 1.0) -> float:
    return scale * 2.220446049250313e-16 ** (1 / (order + accuracy + 1))


class Dual:
    """value + derivative * eps over columns: forward-mode differentiation inside the plan."""

    def __init__(self, value, deriv=None):
        self.value = value if isinstance(value, Column) else F.lit(float(value))
        self.deriv = deriv if isinstance(deriv, Column) else F.lit(float(deriv or 0.0))

    @staticmethod
    def of(x) -> Dual:
        return x if isinstance(x, Dual) else Dual(x)

    def __add__(self, o):
        o = Dual.of(o)
        return Dual(self.value + o.value, self.deriv + o.deriv)

    def __sub__(self, o):
        o = Dual.of(o)
        return Dual(self.value - o.value, self.deriv - o.deriv)

    def __mul__(self, o):
        o = Dual.of(o)
        return Dual(self.value * o.value, self.deriv * o.value + self.value * o.deriv)

    def __truediv__(self, o):
        o = Dual.of(o)
        return Dual(self.value / o.value, (self.deriv * o.value - self.value * o.deriv) / (o.value * o.value))

    def __neg__(self):
        return Dual(-self.value, -self.deriv)

    def __pow__(self, p):
        if isinstance(p, Dual):
            return (p * self.log()).exp()
        return Dual(F.pow(self.value, F.lit(float(p))), p * F.pow(self.value, F.lit(float(p - 1))) * self.deriv)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o):
        return Dual.of(o) - self

    def __rtruediv__(self, o):
        return Dual.of(o) / self

    def chain(self, f: Fn, df: Fn) -> Dual:
        return Dual(f(self.value), df(self.value) * self.deriv)

    def exp(self):
        return self.chain(F.exp, F.exp)

    def log(self):
        return self.chain(F.log, lambda v: 1 / v)

    def sin(self):
        return self.chain(F.sin, F.cos)

    def cos(self):
        return self.chain(F.cos, lambda v: -F.sin(v))

    def tan(self):
        return self.chain(F.tan, lambda v: 1 + F.tan(v) * F.tan(v))

    def sqrt(self):
        return self.chain(F.sqrt, lambda v: 0.5 / F.sqrt(v))

    def tanh(self):
        return self.chain(F.tanh, lambda v: 1 - F.tanh(v) * F.tanh(v))


def derivative(f: Callable[[Dual], Dual], x: Column) -> Column:
    return Dual.of(f(Dual(x, 1.0))).deriv


def value_and_grad(f: Callable[..., Dual], *xs: Column) -> tuple[Column, list[Column]]:
    grads = [Dual.of(f(*(Dual(x, 1.0 if i == k else 0.0) for i, x in enumerate(xs)))) for k in range(len(xs))]
    return grads[0].value, [g.deriv for g in grads]


def gradient(f: Callable[..., Dual], *xs: Column) -> list[Column]:
    return value_and_grad(f, *xs)[1]


def jacobian(fs: list[Callable[..., Dual]], *xs: Column) -> list[list[Column]]:
    return [gradient(f, *xs) for f in fs]
