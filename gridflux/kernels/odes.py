"""Initial value problems for columns of problems: y has a row per problem and a column per component.

A Runge-Kutta method is its tableau (A, b, c); one routine steps all explicit ones, one all implicit ones. Multistep methods
start by a Runge-Kutta method of their order. Adaptive methods hold a step size per problem.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Rhs = Callable[[np.ndarray, np.ndarray], np.ndarray]

_R3, _R2, _R6 = np.sqrt(3.0), np.sqrt(2.0), np.sqrt(6.0)
# fixed values: tableaus (rows of A, b, embedded b where there is one)
EXPLICIT: dict[str, tuple] = {
    "euler": ([[0]], [1]),
    "heun": ([[0, 0], [1, 0]], [1 / 2, 1 / 2]),
    "midpoint_method": ([[0, 0], [1 / 2, 0]], [0, 1]),
    "ralston": ([[0, 0], [2 / 3, 0]], [1 / 4, 3 / 4]),
    "rk3": ([[0, 0, 0], [1 / 2, 0, 0], [-1, 2, 0]], [1 / 6, 2 / 3, 1 / 6]),
    "rk4": ([[0, 0, 0, 0], [1 / 2, 0, 0, 0], [0, 1 / 2, 0, 0], [0, 0, 1, 0]], [1 / 6, 1 / 3, 1 / 3, 1 / 6]),
    "rk38": ([[0, 0, 0, 0], [1 / 3, 0, 0, 0], [-1 / 3, 1, 0, 0], [1, -1, 1, 0]], [1 / 8, 3 / 8, 3 / 8, 1 / 8]),
}
EMBEDDED: dict[str, tuple] = {
    "bogacki_shampine": (3, [[0, 0, 0, 0], [1 / 2, 0, 0, 0], [0, 3 / 4, 0, 0], [2 / 9, 1 / 3, 4 / 9, 0]], [2 / 9, 1 / 3, 4 / 9, 0], [7 / 24, 1 / 4, 1 / 3, 1 / 8]),
    "rkf45": (5, [[0] * 6, [1 / 4] + [0] * 5, [3 / 32, 9 / 32] + [0] * 4, [1932 / 2197, -7200 / 2197, 7296 / 2197, 0, 0, 0], [439 / 216, -8, 3680 / 513, -845 / 4104, 0, 0], [-8 / 27, 2, -3544 / 2565, 1859 / 4104, -11 / 40, 0]], [16 / 135, 0, 6656 / 12825, 28561 / 56430, -9 / 50, 2 / 55], [25 / 216, 0, 1408 / 2565, 2197 / 4104, -1 / 5, 0]),
    "cash_karp": (5, [[0] * 6, [1 / 5] + [0] * 5, [3 / 40, 9 / 40] + [0] * 4, [3 / 10, -9 / 10, 6 / 5, 0, 0, 0], [-11 / 54, 5 / 2, -70 / 27, 35 / 27, 0, 0], [1631 / 55296, 175 / 512, 575 / 13824, 44275 / 110592, 253 / 4096, 0]], [37 / 378, 0, 250 / 621, 125 / 594, 0, 512 / 1771], [2825 / 27648, 0, 18575 / 48384, 13525 / 55296, 277 / 14336, 1 / 4]),
    "dormand_prince": (5, [[0] * 7, [1 / 5] + [0] * 6, [3 / 40, 9 / 40] + [0] * 5, [44 / 45, -56 / 15, 32 / 9, 0, 0, 0, 0], [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729, 0, 0, 0], [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656, 0, 0], [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0]], [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0], [5179 / 57600, 0, 7571 / 16695, 393 / 640, -92097 / 339200, 187 / 2100, 1 / 40]),
}
_G, _L = 1 - 1 / _R2, 0.4358665215084590
IMPLICIT: dict[str, tuple] = {
    "backward_euler": ([[1]], [1]),
    "implicit_midpoint": ([[1 / 2]], [1]),
    "trapezoidal": ([[0, 0], [1 / 2, 1 / 2]], [1 / 2, 1 / 2]),
    "crank_nicolson_ode": ([[0, 0], [1 / 2, 1 / 2]], [1 / 2, 1 / 2]),
    "gauss_legendre_irk": ([[1 / 4, 1 / 4 - _R3 / 6], [1 / 4 + _R3 / 6, 1 / 4]], [1 / 2, 1 / 2]),
    "radau_iia": ([[5 / 12, -1 / 12], [3 / 4, 1 / 4]], [3 / 4, 1 / 4]),
    "radau_iia3": ([[(88 - 7 * _R6) / 360, (296 - 169 * _R6) / 1800, (-2 + 3 * _R6) / 225], [(296 + 169 * _R6) / 1800, (88 + 7 * _R6) / 360, (-2 - 3 * _R6) / 225], [(16 - _R6) / 36, (16 + _R6) / 36, 1 / 9]], [(16 - _R6) / 36, (16 + _R6) / 36, 1 / 9]),
    "lobatto_iiic": ([[1 / 2, -1 / 2], [1 / 2, 1 / 2]], [1 / 2, 1 / 2]),
    "sdirk": ([[_G, 0], [1 - _G, _G]], [1 - _G, _G]),
    "tr_bdf2": ([[0, 0, 0], [_G, _G, 0], [_R2 / 4, _R2 / 4, _G]], [_R2 / 4, _R2 / 4, _G]),
}


def _grid(y0, t0: float, t1: float, n: int) -> tuple[np.ndarray, float, np.ndarray]:
    return np.array(y0, float), (t1 - t0) / n, t0 + (t1 - t0) / n * np.arange(n + 1)


def _stages(f: Rhs, t, y: np.ndarray, h, a: np.ndarray) -> list[np.ndarray]:
    k: list[np.ndarray] = []
    for row in a:
        k.append(f(t + h * row.sum(), y + np.reshape(h, (-1, 1)) * sum((c * s for c, s in zip(row, k) if c), np.zeros_like(y))))
    return k


def rk_general(f: Rhs, y0, t0: float, t1: float, n: int, a, b) -> np.ndarray:
    """y at t1 after n equal steps of an explicit tableau."""
    y, h, ts = _grid(y0, t0, t1, n)
    a = np.array(a, float)
    for t in ts[:-1]:
        y = y + h * sum(w * k for w, k in zip(b, _stages(f, t, y, h, a)))
    return y


def explicit(name: str, f: Rhs, y0, t0: float, t1: float, n: int) -> np.ndarray:
    return rk_general(f, y0, t0, t1, n, *EXPLICIT[name])


def adaptive_rk(f: Rhs, y0, t0: float, t1: float, name: str = "dormand_prince", rtol: float = 1e-8, atol: float = 1e-10, max_steps: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y at t1, accepted steps, reached) by an embedded pair with a step size per problem."""
    order, a, b, b2 = EMBEDDED[name]
    a, y = np.array(a, float), np.array(y0, float)
    t, h, used = np.full(len(y), t0, float), np.full(len(y), (t1 - t0) / 100), np.zeros(len(y), int)
    for _ in range(max_steps):
        left = t1 - t
        live = left > 1e-14 * max(abs(t1), 1)
        if not live.any():
            break
        h = np.where(live, np.minimum(h, left), 0.0)
        k = []
        for row in a:
            k.append(f(t + h * row.sum(), y + h[:, None] * sum((c * s for c, s in zip(row, k) if c), np.zeros_like(y))))
        new = y + h[:, None] * sum(w * s for w, s in zip(b, k))
        gap = h[:, None] * sum((w - v) * s for w, v, s in zip(b, b2, k))
        err = np.sqrt((((gap / (atol + rtol * np.maximum(np.abs(y), np.abs(new)))) ** 2).mean(1)))
        ok = live & (err <= 1)
        y, t, used = np.where(ok[:, None], new, y), np.where(ok, t + h, t), used + ok
        h = np.where(live, h * np.clip(0.9 * np.maximum(err, 1e-10) ** (-1 / order), 0.2, 5.0), h)
    return y, used, t1 - t <= 1e-12 * max(abs(t1), 1)


def solve_ivp(f: Rhs, y0, t0: float, t1: float, method: str = "dormand_prince", n: int = 100, **options) -> np.ndarray:
    """y at t1 by a method's name, whatever its family."""
    if method in EMBEDDED:
        return adaptive_rk(f, y0, t0, t1, method, **options)[0]
    if method in EXPLICIT:
        return explicit(method, f, y0, t0, t1, n)
    if method in IMPLICIT:
        return implicit(method, f, y0, t0, t1, n)
    return MULTISTEP[method](f, y0, t0, t1, n, **options)


def _slopes(f: Rhs, t, y: np.ndarray) -> np.ndarray:
    """df/dy of every problem: (problems, d, d), by central differences."""
    d, out = y.shape[1], []
    for j in range(d):
        e = np.zeros_like(y)
        e[:, j] = 1e-6 * np.maximum(1, np.abs(y[:, j]))
        out.append((f(t, y + e) - f(t, y - e)) / (2 * e[:, j : j + 1]))
    return np.stack(out, axis=2)


def implicit_rk(f: Rhs, y0, t0: float, t1: float, n: int, a, b, tol: float = 1e-12, most: int = 30) -> np.ndarray:
    """n equal steps of an implicit tableau; the stages of a step are found by Newton's method."""
    y, h, ts = _grid(y0, t0, t1, n)
    a, s, d = np.array(a, float), len(b), y.shape[1]
    for t in ts[:-1]:
        c = a.sum(1)
        k = np.stack([f(t, y)] * s, axis=1)
        for _ in range(most):
            at = y[:, None] + h * np.einsum("ij,pjd->pid", a, k)
            gap = k - np.stack([f(t + h * c[i], at[:, i]) for i in range(s)], axis=1)
            jac = np.stack([_slopes(f, t + h * c[i], at[:, i]) for i in range(s)], axis=1)
            big = np.eye(s * d)[None] - h * np.einsum("ij,pide->pidje", a, jac).reshape(len(y), s * d, s * d)
            step = np.linalg.solve(big, gap.reshape(len(y), s * d, 1)).reshape(k.shape)
            k = k - step
            if np.abs(step).max() <= tol * (1 + np.abs(k).max()):
                break
        y = y + h * np.einsum("i,pid->pd", np.array(b, float), k)
    return y


def implicit(name: str, f: Rhs, y0, t0: float, t1: float, n: int) -> np.ndarray:
    return implicit_rk(f, y0, t0, t1, n, *IMPLICIT[name])


def theta_method(f: Rhs, y0, t0: float, t1: float, n: int, theta: float = 0.5) -> np.ndarray:
    return implicit_rk(f, y0, t0, t1, n, [[0, 0], [1 - theta, theta]], [1 - theta, theta])


def adams_coefficients(k: int, implicit: bool = False) -> np.ndarray:
    """Weights of the last k slopes, newest first: the integral over the next step of the polynomial through them."""
    nodes = np.arange(1, 1 - k, -1) if implicit else np.arange(0, -k, -1)
    powers = np.vander(nodes, increasing=True).T.astype(float)
    return np.linalg.solve(powers, 1 / np.arange(1, k + 1))


def _started(f: Rhs, y0, t0: float, t1: float, n: int, k: int):
    y, h, ts = _grid(y0, t0, t1, n)
    ys = [y]
    for t in ts[: k - 1]:
        ys.append(rk_general(f, ys[-1], t, t + h, 1, *EXPLICIT["rk4"]))
    return ys, [f(t, y) for t, y in zip(ts, ys)], h, ts


def _corrected(f: Rhs, t, guess: np.ndarray, base: np.ndarray, weight: float, tol: float = 1e-13, most: int = 50) -> np.ndarray:
    """y = base + weight f(t, y), by Newton's method."""
    y = guess
    for _ in range(most):
        jac = np.eye(y.shape[1])[None] - weight * _slopes(f, t, y)
        step = np.linalg.solve(jac, (y - base - weight * f(t, y))[:, :, None])[:, :, 0]
        y = y - step
        if np.abs(step).max() <= tol * (1 + np.abs(y).max()):
            break
    return y


def adams_bashforth(f: Rhs, y0, t0: float, t1: float, n: int, k: int = 4) -> np.ndarray:
    ys, fs, h, ts = _started(f, y0, t0, t1, n, k)
    w, y = adams_coefficients(k), ys[-1]
    for t in ts[k:]:
        y = y + h * sum(c * s for c, s in zip(w, fs[::-1]))
        fs = [*fs[1:], f(t, y)]
    return y


def adams_moulton(f: Rhs, y0, t0: float, t1: float, n: int, k: int = 4) -> np.ndarray:
    ys, fs, h, ts = _started(f, y0, t0, t1, n, k - 1)
    w, y = adams_coefficients(k, implicit=True), ys[-1]
    for t in ts[k - 1 :]:
        y = _corrected(f, t, y + h * fs[-1], y + h * sum(c * s for c, s in zip(w[1:], fs[::-1])), h * w[0])
        fs = [*fs[1:], f(t, y)]
    return y


def predictor_corrector(f: Rhs, y0, t0: float, t1: float, n: int, k: int = 4, corrections: int = 1) -> np.ndarray:
    """Adams-Bashforth of k steps predicts, Adams-Moulton of the same order corrects."""
    ys, fs, h, ts = _started(f, y0, t0, t1, n, k)
    p, c, y = adams_coefficients(k), adams_coefficients(k, implicit=True), ys[-1]
    for t in ts[k:]:
        new = y + h * sum(w * s for w, s in zip(p, fs[::-1]))
        for _ in range(corrections):
            new = y + h * (c[0] * f(t, new) + sum(w * s for w, s in zip(c[1:], fs[::-1])))
        y, fs = new, [*fs[1:], f(t, new)]
    return y


def abm4(f: Rhs, y0, t0: float, t1: float, n: int) -> np.ndarray:
    return predictor_corrector(f, y0, t0, t1, n, 4)


def nystrom(f: Rhs, y0, t0: float, t1: float, n: int) -> np.ndarray:
    """Explicit midpoint steps over two intervals, begun by Heun's method."""
    y, h, ts = _grid(y0, t0, t1, n)
    old, y = y, rk_general(f, y, ts[0], ts[1], 1, *EXPLICIT["heun"])
    for t in ts[1:-1]:
        old, y = y, old + 2 * h * f(t, y)
    return y


def milne_simpson(f: Rhs, y0, t0: float, t1: float, n: int) -> np.ndarray:
    """Milne's predictor over four intervals, Simpson's corrector over two."""
    ys, fs, h, ts = _started(f, y0, t0, t1, n, 4)
    for t in ts[4:]:
        guess = ys[-4] + 4 * h / 3 * (2 * fs[-1] - fs[-2] + 2 * fs[-3])
        y = ys[-2] + h / 3 * (f(t, guess) + 4 * fs[-1] + fs[-2])
        ys, fs = [*ys[1:], y], [*fs[1:], f(t, y)]
    return ys[-1]


def bdf(f: Rhs, y0, t0: float, t1: float, n: int, k: int = 2) -> np.ndarray:
    """Backward differences over k steps: the polynomial through them has the slope f at the new point."""
    ys, _, h, ts = _started(f, y0, t0, t1, n, k)
    nodes = np.arange(0, -k - 1, -1)
    alpha = np.linalg.solve(np.vander(nodes, increasing=True).T.astype(float), np.eye(k + 1)[1])
    for t in ts[k:]:
        base = -sum(c * y for c, y in zip(alpha[1:], ys[::-1])) / alpha[0]
        ys = [*ys[1:], _corrected(f, t, ys[-1], base, h / alpha[0])] if k > 1 else [_corrected(f, t, ys[-1], base, h / alpha[0])]
    return ys[-1]


MULTISTEP: dict[str, Callable] = {"adams_bashforth": adams_bashforth, "adams_moulton": adams_moulton, "predictor_corrector": predictor_corrector, "abm4": abm4, "nystrom": nystrom, "milne_simpson": milne_simpson, "bdf": bdf}

# fixed values: weights of position (c) and velocity (d) steps of the splittings
_Y = 1 / (2 - 2 ** (1 / 3))
_P = (0.1786178958448091, -0.2123418310626054, -0.06626458266981849)
SPLITTINGS: dict[str, tuple] = {
    "symplectic_euler": ([1.0], [1.0]),
    "position_verlet": ([1 / 2, 1 / 2], [1.0, 0.0]),
    "leapfrog": ([1 / 2, 1 / 2], [1.0, 0.0]),
    "velocity_verlet": ([0.0, 1.0], [1 / 2, 1 / 2]),
    "stormer_verlet": ([0.0, 1.0], [1 / 2, 1 / 2]),
    "ruth3": ([1.0, -2 / 3, 2 / 3], [-1 / 24, 3 / 4, 7 / 24]),
    "forest_ruth": ([_Y / 2, (1 - _Y) / 2, (1 - _Y) / 2, _Y / 2], [_Y, 1 - 2 * _Y, _Y, 0.0]),
    "yoshida4": ([_Y / 2, (1 - _Y) / 2, (1 - _Y) / 2, _Y / 2], [_Y, 1 - 2 * _Y, _Y, 0.0]),
    "pefrl": ([_P[0], _P[2], 1 - 2 * (_P[2] + _P[0]), _P[2], _P[0]], [(1 - 2 * _P[1]) / 2, _P[1], _P[1], (1 - 2 * _P[1]) / 2, 0.0]),
}


def symplectic(name: str, force: Callable, q0, p0, t: float, n: int, mass: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(q, p) of H = p^2 / 2m + V(q) after n steps; force is -V'."""
    q, p, h = np.array(q0, float), np.array(p0, float), t / n
    for _ in range(n):
        for c, d in zip(*SPLITTINGS[name]):
            if name == "symplectic_euler":
                p = p + d * h * force(q)
                q = q + c * h * p / mass
            else:
                q = q + c * h * p / mass
                if d:
                    p = p + d * h * force(q)
    return q, p


def energy_drift(energy: Callable, q0, p0, q, p) -> np.ndarray:
    return energy(q, p) - energy(np.asarray(q0, float), np.asarray(p0, float))


def modified_midpoint(f: Rhs, y: np.ndarray, t: float, big: float, n: int) -> np.ndarray:
    h = big / n
    old, new = y, y + h * f(t, y)
    for k in range(1, n):
        old, new = new, old + 2 * h * f(t + k * h, new)
    return (old + new + h * f(t + big, new)) / 2


def gragg_bulirsch_stoer(f: Rhs, y0, t0: float, t1: float, n: int = 10, levels: int = 5) -> np.ndarray:
    """Modified midpoint values of 2, 4, 6 ... substeps, extrapolated in the square of the substep."""
    y, h, ts = _grid(y0, t0, t1, n)
    for t in ts[:-1]:
        rows: list[list[np.ndarray]] = []
        for i in range(levels):
            row = [modified_midpoint(f, y, t, h, 2 * (i + 1))]
            for j in range(i):
                row.append(row[j] + (row[j] - rows[-1][j]) / (((i + 1) / (i - j)) ** 2 - 1))
            rows.append(row)
        y = rows[-1][-1]
    return y


def richardson_ode(f: Rhs, y0, t0: float, t1: float, n: int, name: str = "rk4", order: int = 4) -> np.ndarray:
    one, two = (explicit(name, f, y0, t0, t1, k) for k in (n, 2 * n))
    return two + (two - one) / (2**order - 1)


def stiffness_ratio(jac) -> float:
    parts = np.abs(np.linalg.eigvals(jac).real)
    return float(parts.max() / parts[parts > 0].min())
