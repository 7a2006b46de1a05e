"""Linear and quadratic programs, assignments and constrained minima: kernels for one problem, to be run over rows of problems."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from gridflux.kernels.minima import bfgs, numerical_gradient, numerical_hessian


class Infeasible(ValueError):
    """No point meets the constraints."""


class Unbounded(ValueError):
    """The objective falls without end."""


def _rows(a, width: int) -> np.ndarray:
    return np.zeros((0, width)) if a is None else np.atleast_2d(np.asarray(a, float))


def _values(b) -> np.ndarray:
    return np.zeros(0) if b is None else np.atleast_1d(np.asarray(b, float))


def standard_form(c, a_ub=None, b_ub=None, a_eq=None, b_eq=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, A, b) with A x = b, x >= 0 and b >= 0: a slack column per inequality."""
    c = np.asarray(c, float)
    upper, equal = _rows(a_ub, len(c)), _rows(a_eq, len(c))
    a = np.block([[upper, np.eye(len(upper))], [equal, np.zeros((len(equal), len(upper)))]])
    b = np.concatenate([_values(b_ub), _values(b_eq)])
    sign = np.where(b < 0, -1.0, 1.0)
    return np.concatenate([c, np.zeros(len(upper))]), a * sign[:, None], b * sign


def simplex_basis(c, a, b, basis, most: int = 10_000, tol: float = 1e-10) -> tuple[np.ndarray, float, np.ndarray]:
    """Minimum of c x over A x = b, x >= 0 from a feasible basis: (x, value, basis). Prices come from the basis' own equations at each step; of equal choices the first is taken, which cannot cycle."""
    c, a, b, basis = np.asarray(c, float), np.asarray(a, float), np.asarray(b, float), np.array(basis, int)
    for _ in range(most):
        square = a[:, basis]
        level = np.linalg.solve(square, b)
        gain = c - np.linalg.solve(square.T, c[basis]) @ a
        gain[basis] = 0.0
        worth = np.flatnonzero(gain < -tol)
        if not len(worth):
            x = np.zeros(len(c))
            x[basis] = level
            return x, float(c @ x), basis
        enter = worth[0]
        pace = np.linalg.solve(square, a[:, enter])
        blocks = np.flatnonzero(pace > tol)
        if not len(blocks):
            raise Unbounded("a ray of the feasible set lowers the objective for ever")
        room = np.maximum(level[blocks], 0) / pace[blocks]
        ties = blocks[room <= room.min() + tol]
        basis[ties[np.argmin(basis[ties])]] = enter
    raise ArithmeticError("no optimal basis within the steps allowed")


def two_phase_simplex(c, a, b, most: int = 10_000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """A feasible basis by an artificial column per row, then the objective itself. Rows that repeat others go."""
    c, a, b = np.asarray(c, float), np.asarray(a, float), np.asarray(b, float)
    sign = np.where(b < 0, -1.0, 1.0)
    a, b, m, n = a * sign[:, None], b * sign, *np.shape(a)
    wide = np.hstack([a, np.eye(m)])
    _, rest, basis = simplex_basis(np.r_[np.zeros(n), np.ones(m)], wide, b, np.arange(n, n + m), most, tol)
    if rest > 1e-8 * max(1.0, np.abs(b).max(initial=0)):
        raise Infeasible("the constraints contradict each other")
    rows = np.ones(m, bool)
    for at in np.flatnonzero(basis >= n):
        line = np.linalg.solve(wide[:, basis].T, np.eye(m)[at]) @ a
        line[basis[basis < n]] = 0.0
        swap = int(np.abs(line).argmax()) if n else 0
        if n and abs(line[swap]) > 1e-9:
            basis[at] = swap
        else:
            rows[basis[at] - n] = False
    x, value, _ = simplex_basis(c, a[rows], b[rows], basis[basis < n], most, tol)
    return x, value


def big_m_simplex(c, a, b, big: float = 1e6, most: int = 10_000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """One phase in which artificial columns cost `big`."""
    c, a, b = np.asarray(c, float), np.asarray(a, float), np.asarray(b, float)
    sign = np.where(b < 0, -1.0, 1.0)
    a, b, m, n = a * sign[:, None], b * sign, *np.shape(a)
    x, _, _ = simplex_basis(np.r_[c, np.full(m, big)], np.hstack([a, np.eye(m)]), b, np.arange(n, n + m), most, tol)
    if x[n:].sum() > 1e-6:
        raise Infeasible("artificial columns stay in use")
    return x[:n], float(c @ x[:n])


def interior_point(c, a, b, tol: float = 1e-10, most: int = 200) -> tuple[np.ndarray, float]:
    """Primal-dual path following with a predicted and a corrected step."""
    c, a, b = np.asarray(c, float), np.asarray(a, float), np.asarray(b, float)
    gram = a @ a.T + 1e-12 * np.eye(len(b))
    x, y = a.T @ np.linalg.solve(gram, b), np.linalg.solve(gram, a @ c)
    s = c - a.T @ y
    x, s = x + max(1.0, -1.5 * x.min()), s + max(1.0, -1.5 * s.min())

    def step(rp, rd, rc):
        d = x / s
        dy = np.linalg.solve(a @ (d[:, None] * a.T) + 1e-14 * np.eye(len(b)), rp + a @ (d * rd - rc / s))
        ds = rd - a.T @ dy
        return (rc - x * ds) / s, dy, ds

    def reach(v, dv):
        down = dv < 0
        return min(1.0, 0.995 * float((-v[down] / dv[down]).min())) if down.any() else 1.0

    for _ in range(most):
        rp, rd, gap = b - a @ x, c - a.T @ y - s, float(x @ s) / len(x)
        if max(np.abs(rp).max(initial=0), np.abs(rd).max(), gap) < tol * max(1.0, np.abs(b).max(initial=0), np.abs(c).max()):
            return x, float(c @ x)
        dx, _, ds = step(rp, rd, -x * s)
        ahead = float((x + reach(x, dx) * dx) @ (s + reach(s, ds) * ds)) / len(x)
        dx, dy, ds = step(rp, rd, (ahead / gap) ** 3 * gap - x * s - dx * ds)
        x, far = x + reach(x, dx) * dx, reach(s, ds)
        y, s = y + far * dy, s + far * ds
    raise ArithmeticError("the path did not end within the steps allowed")


SOLVERS = {"simplex": two_phase_simplex, "big_m": big_m_simplex, "interior_point": interior_point}


def linprog(c, a_ub=None, b_ub=None, a_eq=None, b_eq=None, method: str = "simplex", **options) -> tuple[np.ndarray, float]:
    x, _ = SOLVERS[method](*standard_form(c, a_ub, b_ub, a_eq, b_eq), **options)
    x = x[: len(np.asarray(c))]
    return x, float(np.dot(c, x))


def assignment(cost, maximize: bool = False) -> tuple[np.ndarray, float]:
    """Column of each row at the least total cost, by shortest augmenting paths over reduced costs. Rows must not outnumber columns."""
    given = np.atleast_2d(np.asarray(cost, float))
    c = -given if maximize else given
    n, m = c.shape
    if n > m:
        raise ValueError("more rows than columns")
    row_of, price_row, price_col = np.full(m, -1), np.zeros(n), np.zeros(m)
    for start in range(n):
        far, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, reached, at = start, 0.0, -1
        while True:
            through = reached + c[row] - price_row[row] - price_col
            better = ~done & (through < far)
            far[better], came[better] = through[better], at
            at = int(np.where(done, np.inf, far).argmin())
            reached, done[at] = far[at], True
            if row_of[at] < 0:
                break
            row = row_of[at]
        settled = done & (row_of >= 0)
        price_row[start] += reached
        price_row[row_of[settled]] += reached - far[settled]
        price_col[done] -= reached - far[done]
        while at >= 0:
            before = came[at]
            row_of[at] = start if before < 0 else row_of[before]
            at = before
    cols = np.empty(n, int)
    cols[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return cols, float(given[np.arange(n), cols].sum())


def solve_qp(g, c, a=None, b=None) -> tuple[np.ndarray, np.ndarray]:
    """(x, multipliers) of min x G x / 2 + c x over A x = b, by the stationarity equations."""
    c = np.asarray(c, float)
    a = _rows(a, len(c))
    k = np.block([[np.asarray(g, float), a.T], [a, np.zeros((len(a), len(a)))]])
    z = np.linalg.lstsq(k, np.r_[-c, _values(b)], rcond=None)[0]
    return z[: len(c)], z[len(c) :]


def active_set_qp(g, c, a_ineq=None, b_ineq=None, a_eq=None, b_eq=None, x0=None, most: int = 200, tol: float = 1e-9) -> np.ndarray:
    """min x G x / 2 + c x over A x <= b and equalities, of a convex form: walks from a feasible point, holding the bounds it meets and letting go the one that pulls hardest."""
    g, c = np.asarray(g, float), np.asarray(c, float)
    a, b, e, f = _rows(a_ineq, len(c)), _values(b_ineq), _rows(a_eq, len(c)), _values(b_eq)
    if x0 is None:
        halves = [np.hstack([m, -m]) if len(m) else None for m in (a, e)]
        z, _ = linprog(np.zeros(2 * len(c)), halves[0], b if len(b) else None, halves[1], f if len(f) else None)
        x0 = z[: len(c)] - z[len(c) :]
    x, held = np.asarray(x0, float), []
    for _ in range(most):
        hold = np.vstack([e, a[held]])
        move, pull = solve_qp(g, g @ x + c, hold, np.zeros(len(hold)))
        if np.abs(move).max(initial=0) < tol:
            bounds = pull[len(e) :]
            if not len(bounds) or bounds.min() >= -tol:
                return x
            held.pop(int(bounds.argmin()))
            continue
        far, meets = 1.0, None
        for i in sorted(set(range(len(b))) - set(held)):
            speed = a[i] @ move
            if speed > tol and (b[i] - a[i] @ x) / speed < far:
                far, meets = max(0.0, (b[i] - a[i] @ x) / speed), i
        x = x + far * move
        if meets is not None:
            held.append(meets)
    raise ArithmeticError("no optimal set of bounds within the steps allowed")


Constraint = Callable[[np.ndarray], np.ndarray]


def _read(h: Constraint | None, x: np.ndarray) -> np.ndarray:
    return np.zeros(0) if h is None else np.atleast_1d(np.asarray(h(x), float))


def _inner(f, x):
    return np.asarray(bfgs(f, x)[0], float)


def penalty_method(f, x0, eq: Constraint | None = None, ineq: Constraint | None = None, weight: float = 1.0, growth: float = 10.0, rounds: int = 9, tol: float = 1e-8) -> np.ndarray:
    """Squares of what the constraints h = 0, g <= 0 miss, at growing weights."""
    x = np.asarray(x0, float)
    for _ in range(rounds):
        x = _inner(lambda v, w=weight: f(v) + w / 2 * ((_read(eq, v) ** 2).sum() + (np.maximum(_read(ineq, v), 0) ** 2).sum()), x)
        if np.abs(_read(eq, x)).max(initial=0) < tol and _read(ineq, x).max(initial=0) < tol:
            break
        weight *= growth
    return x


def augmented_lagrangian(f, x0, eq: Constraint | None = None, ineq: Constraint | None = None, weight: float = 10.0, growth: float = 5.0, rounds: int = 50, tol: float = 1e-9) -> np.ndarray:
    """Multipliers take over from the penalty, whose weight grows only while the miss does not shrink to a quarter."""
    x, last = np.asarray(x0, float), np.inf
    lam, mu = 0.0 * _read(eq, x), 0.0 * _read(ineq, x)
    for _ in range(rounds):
        def whole(v, w=weight, lam=lam, mu=mu):
            h, g = _read(eq, v), np.maximum(0, mu + w * _read(ineq, v))
            return f(v) + lam @ h + w / 2 * h @ h + (g @ g - mu @ mu) / (2 * w)

        x = _inner(whole, x)
        h, g = _read(eq, x), _read(ineq, x)
        miss = max(np.abs(h).max(initial=0), np.abs(np.maximum(g, -mu / weight)).max(initial=0))
        lam, mu = lam + weight * h, np.maximum(0, mu + weight * g)
        if miss < tol:
            break
        if miss > last / 4 and weight < 1e6:
            weight *= growth
        last = miss
    return x


def barrier_method(f, x0, ineq: Constraint, weight: float = 1.0, shrink: float = 0.2, rounds: int = 30, tol: float = 1e-9) -> np.ndarray:
    """Logarithms of the room left, at falling weights, from a point within."""
    x = np.asarray(x0, float)
    if _read(ineq, x).max() >= 0:
        raise Infeasible("the first point must lie within the constraints")

    def walled(v, w):
        room = -_read(ineq, v)
        return f(v) - w * np.log(room).sum() if room.min() > 0 else np.inf

    for _ in range(rounds):
        x = _newton_within(lambda v, w=weight: walled(v, w), x)
        if weight * len(_read(ineq, x)) < tol:
            break
        weight *= shrink
    return x


def _newton_within(f, x, most: int = 30):
    """Newton steps halved until the value falls; ends where the differences would step through a wall."""

    def slope(v):
        return np.asarray(numerical_gradient(f, v), float)

    for _ in range(most):
        with np.errstate(invalid="ignore"):
            grad, hess = slope(x), np.asarray(numerical_hessian(slope, x), float)
        if not (np.isfinite(grad).all() and np.isfinite(hess).all()):
            return x
        w, v = np.linalg.eigh((hess + hess.T) / 2)
        move, far, here = -v @ ((v.T @ grad) / np.maximum(np.abs(w), 1e-8)), 1.0, f(x)
        while far > 1e-12 and not f(x + far * move) < here:
            far /= 2
        if far <= 1e-12 or np.abs(far * move).max() < 1e-12:
            return x
        x = x + far * move
    return x


def kkt_residual(grad, eq_jac=None, ineq_jac=None, lam=None, mu=None, eq=None, ineq=None) -> float:
    """Largest miss among stationarity, feasibility, signs and complementarity."""
    grad = np.asarray(grad, float)
    lam, mu, g = _values(lam), _values(mu), _values(ineq)
    pull = grad + _rows(eq_jac, len(grad)).T @ lam + _rows(ineq_jac, len(grad)).T @ mu
    parts = [pull, _values(eq), np.maximum(g, 0), np.minimum(mu, 0), mu * g if len(g) == len(mu) else g[:0]]
    return max(float(np.abs(p).max(initial=0)) for p in parts)
