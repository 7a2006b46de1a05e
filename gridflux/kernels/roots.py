"""Root finding for columns of problems: every element is a problem of its own and stops moving once it has converged.

Scalar methods take f on arrays and return (root, iterations, converged), arrays of the problems' shape. An element whose bracket
holds no change of sign gets NaN and is not converged. Methods on polynomials and systems take one problem.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _arrays(*xs) -> list[np.ndarray]:
    return [np.array(x, float) for x in np.broadcast_arrays(*xs)]


def _bracketed(f: Callable, a, b, tol: float, max_iter: int, choose: Callable) -> Found:
    """Shrink brackets: choose(state) gives the next point inside each; state holds a, b, fa, fb and what choose keeps."""
    a, b = _arrays(a, b)
    s = {"a": a, "b": b, "fa": f(a), "fb": f(b), "step": 0}
    odd = s["fa"] * s["fb"] > 0
    x = np.where(np.abs(s["fa"]) <= np.abs(s["fb"]), a, b)
    done, used = odd | (s["fa"] == 0) | (s["fb"] == 0), np.zeros(a.shape, int)
    for s["step"] in range(1, max_iter + 1):
        if done.all():
            break
        with np.errstate(all="ignore"):
            c = choose(s, f)
        c = np.where(np.isfinite(c), c, (s["a"] + s["b"]) / 2)
        fc, old = f(c), x
        x = np.where(done, x, c)
        used += ~done
        left = np.sign(s["fa"]) * np.sign(fc) < 0  # the root lies between a and c
        kept = s.get("side", np.zeros(a.shape)), left
        fa, fb = s["fa"], s["fb"]
        weigh = s.get("weigh")
        if weigh is not None:  # the end that stays a second time counts less
            fa = np.where(left & (kept[0] == -1), fa * weigh(fb, fc), fa)
            fb = np.where(~left & (kept[0] == 1), fb * weigh(fa, fc), fb)
        s["a"], s["fa"] = np.where(left, s["a"], c), np.where(left, fa, fc)
        s["b"], s["fb"] = np.where(left, c, s["b"]), np.where(left, fc, fb)
        s["side"] = np.where(left, -1, 1)
        done |= (fc == 0) | (np.abs(s["b"] - s["a"]) <= tol) | (s["step"] > 1) & (np.abs(x - old) <= tol * (1 + np.abs(x)))
    return np.where(odd, np.nan, x), used, done & ~odd


def bisection(f, a, b, tol: float = 1e-12, max_iter: int = 200) -> Found:
    return _bracketed(f, a, b, tol, max_iter, lambda s, f: (s["a"] + s["b"]) / 2)


def _chord(s, f) -> np.ndarray:
    return s["b"] - s["fb"] * (s["b"] - s["a"]) / (s["fb"] - s["fa"])


def false_position(f, a, b, tol: float = 1e-12, max_iter: int = 2000) -> Found:
    return _bracketed(f, a, b, tol, max_iter, _chord)


def illinois(f, a, b, tol: float = 1e-12, max_iter: int = 200) -> Found:
    """False position; an end that stays twice has its value halved."""

    def choose(s, f):
        s["weigh"] = lambda other, new: 0.5
        return _chord(s, f)

    return _bracketed(f, a, b, tol, max_iter, choose)


def pegasus(f, a, b, tol: float = 1e-12, max_iter: int = 200) -> Found:
    """False position; an end that stays twice is weighed by the last two values on the other side."""

    def choose(s, f):
        s["weigh"] = lambda other, new: other / (other + new)
        return _chord(s, f)

    return _bracketed(f, a, b, tol, max_iter, choose)


def ridders(f, a, b, tol: float = 1e-12, max_iter: int = 200) -> Found:
    def choose(s, f):
        m = (s["a"] + s["b"]) / 2
        fm = f(m)
        return m + (m - s["a"]) * np.sign(s["fa"] - s["fb"]) * fm / np.sqrt(fm * fm - s["fa"] * s["fb"])

    return _bracketed(f, a, b, tol, max_iter, choose)


def itp(f, a, b, tol: float = 1e-12, max_iter: int = 200, k1: float = 0.2, k2: float = 2.0, slack: int = 1) -> Found:
    """Interpolate, truncate, project: never more steps than bisection and `slack`."""
    a0, b0 = _arrays(a, b)
    most = np.ceil(np.log2(np.maximum(np.abs(b0 - a0) / (2 * tol), 1))) + slack

    def choose(s, f):
        lo, hi, m = s["a"], s["b"], (s["a"] + s["b"]) / 2
        chord, side = _chord(s, f), np.sign(m - _chord(s, f))
        delta = np.minimum(k1 * np.abs(hi - lo) ** k2 / np.maximum(np.abs(b0 - a0), 1e-300), np.abs(m - chord))
        radius = np.maximum(tol * 2.0 ** (most - s["step"] + 1) - np.abs(hi - lo) / 2, 0)
        near = chord + side * delta
        return np.where(np.abs(near - m) <= radius, near, m - side * radius)

    return _bracketed(f, a, b, tol, max_iter, choose)


def brent(f, a, b, tol: float = 1e-12, max_iter: int = 200) -> Found:
    """Inverse quadratic or chord steps where they halve the step before last, bisection elsewhere."""

    def choose(s, f):
        a, b, fa, fb = s["a"], s["b"], s["fa"], s["fb"]
        c, fc = s.get("c", a), s.get("fc", fa)
        r, q, t = fb / fa, fb / fc, fa / fc
        quad = b + (b - a) * r * (t * (q - t) * (c - b) / (b - a) - (1 - q)) / ((t - 1) * (q - 1) * (r - 1))
        chord = b - fb * (b - a) / (fb - fa)
        x = np.where((fc != fa) & (fc != fb) & np.isfinite(quad), quad, chord)
        lo, hi, m = np.minimum(a, b), np.maximum(a, b), (a + b) / 2
        width = hi - lo
        slow = width > 0.5 * s.get("width2", np.full(a.shape, np.inf))
        s["width2"], s["width"] = s.get("width", np.full(a.shape, np.inf)), width
        s["c"], s["fc"] = np.where(np.abs(fa) > np.abs(fb), a, b), np.where(np.abs(fa) > np.abs(fb), fa, fb)
        return np.where((x > lo) & (x < hi) & ~slow, x, m)

    return _bracketed(f, a, b, tol, max_iter, choose)


def _iterated(x0, step: Callable, tol: float, max_iter: int) -> Found:
    """x <- step(x) until the change is below tol, each element on its own."""
    (x,) = _arrays(x0)
    done, used = np.zeros(x.shape, bool), np.zeros(x.shape, int)
    for _ in range(max_iter):
        with np.errstate(all="ignore"):
            new = step(x)
        used += ~done
        small = np.abs(new - x) <= tol * (1 + np.abs(x))
        x = np.where(done | ~np.isfinite(new), x, new)
        done |= small
        if done.all():
            break
    return x, used, done


def newton(f, df, x0, tol: float = 1e-13, max_iter: int = 100) -> Found:
    return _iterated(x0, lambda x: x - f(x) / df(x), tol, max_iter)


def halley(f, df, d2f, x0, tol: float = 1e-13, max_iter: int = 100) -> Found:
    return _iterated(x0, lambda x: x - 2 * f(x) * df(x) / (2 * df(x) ** 2 - f(x) * d2f(x)), tol, max_iter)


def chebyshev_method(f, df, d2f, x0, tol: float = 1e-13, max_iter: int = 100) -> Found:
    def step(x):
        u = f(x) / df(x)
        return x - u * (1 + u * d2f(x) / (2 * df(x)))

    return _iterated(x0, step, tol, max_iter)


def steffensen(f, x0, tol: float = 1e-13, max_iter: int = 100) -> Found:
    def step(x):
        y = f(x)
        slope = np.where(y == 0, 1.0, (f(x + y) - y) / np.where(y == 0, 1.0, y))
        return x - y / slope

    return _iterated(x0, step, tol, max_iter)


def fixed_point(g, x0, tol: float = 1e-12, max_iter: int = 1000) -> Found:
    return _iterated(x0, g, tol, max_iter)


def aitken_accelerated(g, x0, tol: float = 1e-12, max_iter: int = 200) -> Found:
    def step(x):
        y, z = g(x), g(g(x))
        bend = z - 2 * y + x
        return np.where(np.abs(bend) < 1e-300, z, x - (y - x) ** 2 / np.where(bend == 0, 1, bend))

    return _iterated(x0, step, tol, max_iter)


def _history(f, points: list, new: Callable, tol: float, max_iter: int) -> Found:
    """The next point follows from the last ones; an element that has converged keeps its point."""
    xs = _arrays(*points)
    fs = [f(x) for x in xs]
    done, used = fs[-1] == 0, np.zeros(xs[0].shape, int)
    for _ in range(max_iter):
        if done.all():
            break
        with np.errstate(all="ignore"):
            x = new(xs, fs)
        x = np.where(done | ~np.isfinite(x), xs[-1], x)
        used += ~done
        fx = f(x)
        done |= (np.abs(x - xs[-1]) <= tol * (1 + np.abs(x))) | (fx == 0)
        xs, fs = [*xs[1:], x], [*fs[1:], fx]
    return xs[-1], used, done


def secant(f, x0, x1, tol: float = 1e-13, max_iter: int = 100) -> Found:
    return _history(f, [x0, x1], lambda x, y: x[1] - y[1] * (x[1] - x[0]) / (y[1] - y[0]), tol, max_iter)


def muller(f, x0, x1, x2, tol: float = 1e-13, max_iter: int = 100) -> Found:
    """The nearer real root of the parabola through the last three points."""

    def new(x, y):
        h = x[2] - x[1]
        d1, d0 = (y[2] - y[1]) / h, (y[1] - y[0]) / (x[1] - x[0])
        a = (d1 - d0) / (x[2] - x[0])
        b = a * h + d1
        root = np.sqrt(np.maximum(b * b - 4 * a * y[2], 0))
        return x[2] - 2 * y[2] / np.where(b >= 0, b + root, b - root)

    return _history(f, [x0, x1, x2], new, tol, max_iter)


def inverse_quadratic(f, x0, x1, x2, tol: float = 1e-13, max_iter: int = 100) -> Found:
    def new(x, y):
        return sum(x[i] * y[j] * y[k] / ((y[i] - y[j]) * (y[i] - y[k])) for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))

    return _history(f, [x0, x1, x2], new, tol, max_iter)


def bracket_root(f, a, b, grow: float = 1.6, max_iter: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Widen (a, b) on the side of the smaller value until the sign changes: (a, b, found)."""
    a, b = _arrays(a, b)
    for _ in range(max_iter):
        fa, fb = f(a), f(b)
        same = fa * fb > 0
        if not same.any():
            break
        low = np.abs(fa) < np.abs(fb)
        a, b = np.where(same & low, a + grow * (a - b), a), np.where(same & ~low, b + grow * (b - a), b)
    return a, b, f(a) * f(b) <= 0


def find_all_roots(f, a: float, b: float, n: int = 200, tol: float = 1e-12) -> np.ndarray:
    """The roots that n equal cells of one interval bracket."""
    x = np.linspace(a, b, n + 1)
    y = f(x)
    hit = x[y == 0]
    cells = np.flatnonzero(y[:-1] * y[1:] < 0)
    return np.sort(np.concatenate([hit, brent(f, x[cells], x[cells + 1], tol)[0]]))


# polynomials: coefficients from the highest power down


def companion_roots(p) -> np.ndarray:
    p = np.trim_zeros(np.asarray(p, complex), "f")
    n = len(p) - 1
    c = np.diag(np.ones(n - 1, complex), -1) if n > 0 else np.zeros((0, 0))
    if n > 0:
        c[0] = -p[1:] / p[0]
    return np.linalg.eigvals(c)


def _start(p: np.ndarray) -> np.ndarray:
    n = len(p) - 1
    radius = 1 + np.abs(p[1:] / p[0]).max()
    return radius * np.exp(2j * np.pi * (np.arange(n) + 0.25) / n) / 2


def durand_kerner(p, tol: float = 1e-13, max_iter: int = 1000) -> np.ndarray:
    """All roots at once by Weierstrass' corrections."""
    p = np.asarray(p, complex) / p[0]
    z = _start(p)
    for _ in range(max_iter):
        gaps = z[:, None] - z[None, :] + np.eye(len(z))
        step = np.polyval(p, z) / gaps.prod(1)
        z = z - step
        if np.abs(step).max() <= tol * (1 + np.abs(z).max()):
            break
    return z


def aberth_ehrlich(p, tol: float = 1e-14, max_iter: int = 300) -> np.ndarray:
    """All roots at once by Newton steps that the other roots push away."""
    p = np.asarray(p, complex)
    d, z = np.polyder(p), _start(p)
    for _ in range(max_iter):
        with np.errstate(all="ignore"):
            ratio = np.polyval(p, z) / np.polyval(d, z)
        ratio = np.where(np.isfinite(ratio), ratio, 0)
        gaps = z[:, None] - z[None, :]
        np.fill_diagonal(gaps, np.inf)
        step = ratio / (1 - ratio * (1 / gaps).sum(1))
        z = z - step
        if np.abs(step).max() <= tol * (1 + np.abs(z).max()):
            break
    return z


def laguerre_root(p, x0: complex = 0.0, tol: float = 1e-14, max_iter: int = 100) -> complex:
    p, x = np.asarray(p, complex), complex(x0)
    n, d1 = len(p) - 1, np.polyder(p)
    d2 = np.polyder(d1)
    for _ in range(max_iter):
        y = np.polyval(p, x)
        if abs(y) == 0:
            break
        g = np.polyval(d1, x) / y
        root = np.sqrt((n - 1) * (n * (g * g - np.polyval(d2, x) / y) - g * g) + 0j)
        down = max(g + root, g - root, key=abs)
        step = n / down if down else 1.0
        x -= step
        if abs(step) <= tol * (1 + abs(x)):
            break
    return x


def bairstow(p, tol: float = 1e-13, max_iter: int = 500) -> np.ndarray:
    """Roots of a real polynomial by its quadratic factors x^2 - r x - s."""
    p, out = np.asarray(p, float), []
    while len(p) > 3:
        r, s = p[1] / p[0], p[2] / p[0]
        for _ in range(max_iter):
            q, rest = np.polydiv(p, [1, -r, -s])
            rest = np.concatenate([np.zeros(2 - len(rest)), rest])
            _, rest2 = np.polydiv(q, [1, -r, -s])
            rest2 = np.concatenate([np.zeros(max(0, 2 - len(rest2))), rest2])
            c1, c0 = rest2  # d rest / d s and, times x, d rest / d r
            jac = np.array([[c1 * r + c0, c1], [c1 * s, c0]])
            try:
                dr, ds = np.linalg.solve(jac, -rest)
            except np.linalg.LinAlgError:
                dr, ds = 0.1, 0.1
            r, s = r + dr, s + ds
            if abs(dr) + abs(ds) <= tol * (1 + abs(r) + abs(s)):
                break
        out += list(np.roots([1, -r, -s]))
        p = np.polydiv(p, [1, -r, -s])[0]
    return np.array([*out, *np.roots(p)])


def newton_polynomial(p, x0: float, tol: float = 1e-13, max_iter: int = 100) -> Found:
    d = np.polyder(np.asarray(p, float))
    return newton(lambda x: np.polyval(p, x), lambda x: np.polyval(d, x), x0, tol, max_iter)


def jenkins_traub_like(p) -> np.ndarray:
    """Roots one after another, the smallest first, each polished on the whole polynomial."""
    whole, rest, out = np.asarray(p, complex), np.asarray(p, complex), []
    while len(rest) > 1:
        x = laguerre_root(whole, laguerre_root(rest))
        out.append(x)
        rest = np.polydiv(rest, [1, -x])[0]
    return np.array(out)


def polynomial_roots(p, method: str = "companion") -> np.ndarray:
    return {"companion": companion_roots, "durand_kerner": durand_kerner, "aberth": aberth_ehrlich, "bairstow": bairstow, "laguerre": jenkins_traub_like}[method](p)


def sturm_chain(p) -> list[np.ndarray]:
    chain = [np.asarray(p, float), np.polyder(np.asarray(p, float))]
    while len(chain[-1]) > 1:
        rest = np.trim_zeros(np.where(np.abs(r := -np.polydiv(chain[-2], chain[-1])[1]) < 1e-12, 0, r), "f")
        if not len(rest):
            break
        chain.append(rest / np.abs(rest).max())
    return chain


def count_real_roots(p, a: float, b: float) -> int:
    """Distinct real roots in (a, b]."""

    def changes(x: float) -> int:
        s = [v for q in sturm_chain(p) if (v := np.sign(np.polyval(q, x)))]
        return sum(u != v for u, v in zip(s, s[1:]))

    return changes(a) - changes(b)


# systems: one problem; f maps a vector to a vector


def jacobian(f, x, h: float = 1e-7) -> np.ndarray:
    y, cols = np.asarray(f(x), float), []
    for i in range(len(x)):
        d = h * max(1.0, abs(x[i]))
        e = np.zeros(len(x))
        e[i] = d
        cols.append((np.asarray(f(x + e)) - np.asarray(f(x - e))) / (2 * d))
    return np.array(cols).T.reshape(len(y), len(x))


def newton_system(f, x0, jac=None, tol: float = 1e-12, max_iter: int = 100, damped: bool = False):
    """(x, iterations, converged); damped halves a step until the residual falls."""
    x = np.array(x0, float)
    for k in range(1, max_iter + 1):
        y = np.asarray(f(x), float)
        step = np.linalg.lstsq(jac(x) if jac else jacobian(f, x), -y, rcond=None)[0]
        t = 1.0
        while damped and t > 1e-10 and np.linalg.norm(f(x + t * step)) > (1 - 1e-4 * t) * np.linalg.norm(y):
            t /= 2
        x = x + t * step
        if np.linalg.norm(t * step) <= tol * (1 + np.linalg.norm(x)):
            return x, k, True
    return x, max_iter, False


def damped_newton_system(f, x0, **options):
    return newton_system(f, x0, damped=True, **options)


def _broyden(f, x0, good: bool, tol: float, max_iter: int):
    x = np.array(x0, float)
    y, inv = np.asarray(f(x), float), np.linalg.inv(jacobian(f, x))
    for k in range(1, max_iter + 1):
        s = -inv @ y
        x = x + s
        new = np.asarray(f(x), float)
        dy, y = new - y, new
        if np.linalg.norm(s) <= tol * (1 + np.linalg.norm(x)):
            return x, k, True
        if good:
            inv = inv + np.outer(s - inv @ dy, s @ inv) / (s @ inv @ dy)
        else:
            inv = inv + np.outer(s - inv @ dy, dy) / (dy @ dy)
    return x, max_iter, False


def broyden_good(f, x0, tol: float = 1e-11, max_iter: int = 200):
    return _broyden(f, x0, True, tol, max_iter)


def broyden_bad(f, x0, tol: float = 1e-11, max_iter: int = 200):
    return _broyden(f, x0, False, tol, max_iter)


def fixed_point_system(g, x0, tol: float = 1e-12, max_iter: int = 1000):
    x = np.array(x0, float)
    for k in range(1, max_iter + 1):
        new = np.asarray(g(x), float)
        if np.linalg.norm(new - x) <= tol * (1 + np.linalg.norm(x)):
            return new, k, True
        x = new
    return x, max_iter, False


def anderson_acceleration(g, x0, depth: int = 4, tol: float = 1e-12, max_iter: int = 200):
    """Fixed points by the combination of the last iterates whose residuals cancel best."""
    xs, gs = [np.array(x0, float)], []
    for k in range(1, max_iter + 1):
        gs.append(np.asarray(g(xs[-1]), float))
        res = [b - a for a, b in zip(xs[-len(gs) :], gs)]
        if np.linalg.norm(res[-1]) <= tol * (1 + np.linalg.norm(xs[-1])):
            return gs[-1], k, True
        new = gs[-1]
        if len(gs) > 1:
            dr = np.array([res[-1] - r for r in res[:-1]]).T
            w = np.linalg.lstsq(dr, res[-1], rcond=None)[0]
            new = new - sum(c * (gs[-1] - y) for c, y in zip(w, gs[:-1]))
        xs.append(new)
        xs, gs = xs[-depth - 1 :], gs[-depth:]
    return xs[-1], max_iter, False


def continuation(f, x0, ts, tol: float = 1e-10):
    """Follow a root of f(x, t) over the parameters ts: a row of x for every t."""
    x, out = np.array(x0, float), []
    for t in ts:
        x, _, ok = newton_system(lambda v, t=t: f(v, t), x, tol=tol)
        if not ok:
            raise ValueError(f"no root followed to t = {t}")
        out.append(x)
    return np.array(out)


def homotopy(f, x0, steps: int = 10):
    """A root of f by way of f(x) - (1 - t) f(x0)."""
    y0 = np.asarray(f(np.array(x0, float)), float)
    return continuation(lambda x, t: np.asarray(f(x)) - (1 - t) * y0, x0, np.linspace(0, 1, steps + 1)[1:])[-1]
