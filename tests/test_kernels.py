"""Dense kernels, transforms and table operators against numpy and identities."""

import numpy as np
import pytest

from gridflux.functions import calculus, polynomials
from gridflux.kernels import fourier as ft
from gridflux.kernels import linalg as la
from gridflux.operators import quadrature, sparse

RNG = np.random.default_rng(0)
M = RNG.normal(size=(5, 5))
S = M @ M.T + 5 * np.eye(5)
B = RNG.normal(size=5)
TALL = RNG.normal(size=(9, 4))
W, V = np.linalg.eigh(S)
SIGMA = np.linalg.svd(M)[1]


def close(a, b, tol=1e-7):
    return np.allclose(a, b, atol=tol, rtol=tol)


@pytest.mark.parametrize("name", ["householder_qr", "gram_schmidt_qr", "modified_gram_schmidt_qr", "givens_qr"])
def test_qr(name):
    q, r = getattr(la, name)(TALL if name != "givens_qr" else M)
    a = TALL if name != "givens_qr" else M
    assert close(q @ r, a) and close(q.T @ q, np.eye(q.shape[1])) and close(np.tril(r[: r.shape[1]], -1), 0)


def test_triangular_factors():
    p, low, up = la.plu_decomposition(M)[:3]
    assert close(low @ up, M[np.asarray(p, int)])
    l, u = la.lu_decomposition(S)
    assert close(l @ u, S) and close(np.diag(l), 1)
    l, u = la.crout(S)
    assert close(l @ u, S) and close(np.diag(u), 1)
    p, l, u, q = la.lu_complete_pivot(M)
    assert close(l @ u, M[np.asarray(p, int)][:, np.asarray(q, int)])
    assert close(la.cholesky(S) @ la.cholesky(S).T, S)
    l, d = la.ldl_decomposition(S)
    assert close(l @ np.diag(d) @ l.T, S)


def test_direct_solvers_of_special_matrices():
    d, e = np.full(6, 4.0), np.full(5, -1.0)
    t, x = np.diag(d) + np.diag(e, 1) + np.diag(e, -1), np.arange(6.0)
    low, up = np.concatenate([[0], e]), np.concatenate([e, [0]])
    assert close(la.thomas(low, d, up, t @ x), x)
    assert close(la.inverse(M) @ M, np.eye(5)) and la.determinant(M) == pytest.approx(np.linalg.det(M)) and la.rank(np.outer(B, B)) == 1
    assert close(np.outer(B, B) @ la.nullspace(np.outer(B, B)), 0)
    assert close(la.sherman_morrison(np.linalg.inv(S), B, B), np.linalg.inv(S + np.outer(B, B)))
    u = RNG.normal(size=(5, 2))
    assert close(la.woodbury(np.linalg.inv(S), u, np.eye(2), u.T), np.linalg.inv(S + u @ u.T))


def test_hessenberg_and_bidiagonal_forms():
    forms = la.hessenberg(M)
    h, q = forms if close(np.tril(forms[0], -2), 0) else forms[::-1]
    assert close(q @ h @ q.T, M) and close(np.tril(h, -2), 0)
    u, b, v = la.bidiagonalize(M)
    assert close(u @ b @ v, M) or close(u @ b @ v.T, M)
    assert close(np.tril(b, -1), 0) and close(np.triu(b, 2), 0)


def test_eigenvalues():
    assert la.power_iteration(S)[0] == pytest.approx(W[-1]) and la.inverse_power_iteration(S, W[0] - 0.01)[0] == pytest.approx(W[0])
    near = la.shifted_power_iteration(S, 1.0)[0]
    assert np.abs(W - near).min() < 1e-6 and np.abs(W - la.rayleigh_quotient_iteration(S, B)[0]).min() < 1e-8
    assert close(sorted(np.asarray([p[0] for p in la.deflation_power(S, 2)]))[::-1], W[::-1][:2], 1e-5)
    assert la.spectral_radius(S) == pytest.approx(W[-1]) and close(np.sort(la.jacobi_eigen(S)[0]), W) and close(np.sort(la.qr_algorithm(S)), W)
    parts = la.schur(M)
    assert any(close(q @ t @ np.conj(q).T, M) for q, t in (parts, parts[::-1]))
    d, e = np.full(6, 2.0), np.full(5, -1.0)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert close(np.sort(la.bisection_eigenvalues(d, e)), np.linalg.eigvalsh(t)) and la.sturm_count(d, e, 2.0) == 3
    assert close(np.sort(la.generalized_eigh(S, S + np.eye(5))[0]), np.sort(np.linalg.eigvals(np.linalg.solve(S + np.eye(5), S)).real))
    by = lambda z: np.array(sorted(z, key=lambda c: (round(c.real, 6), c.imag)))
    assert close(by(la.qz_eigenvalues(M, S)), by(np.linalg.eigvals(np.linalg.solve(S, M))))
    assert close(np.sort(la.subspace_iteration(S, 2)[0]), W[-2:], 1e-6)
    found = np.sort(la.lobpcg(S, 2)[0])
    assert close(found, W[:2], 1e-5) or close(found, W[-2:], 1e-5)


def test_singular_values_and_polar_form():
    for f in (la.svd_jacobi, la.svd_golub_kahan):
        u, s, v = f(M)
        assert close(np.sort(s)[::-1], SIGMA) and (close(u @ np.diag(s) @ v, M) or close(u @ np.diag(s) @ v.T, M))
    u, p = la.polar_decomposition(M)
    assert close(u @ p, M) and close(u.T @ u, np.eye(5)) and close(p, p.T)


def test_krylov_bases():
    q, a, b = la.lanczos(S, 3)
    assert close(q.T @ q, np.eye(3)) and close(q.T @ S @ q, np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
    q, h = la.arnoldi(M, 3)
    assert close(M @ q[:, :3], q @ h)


def test_least_squares():
    y, ref = RNG.normal(size=9), None
    ref = np.linalg.lstsq(TALL, y, rcond=None)[0]
    assert all(close(f(TALL, y), ref) for f in (la.normal_equations, la.qr_least_squares, la.svd_least_squares, lambda a, b: la.pseudoinverse(a) @ b, lambda a, b: la.truncated_svd(a, b, 4), lambda a, b: la.lsqr(a, b)[0]))
    eye = np.eye(4)
    assert close(la.ridge_regression(TALL, y, 2.0), np.linalg.solve(TALL.T @ TALL + 2 * eye, TALL.T @ y))
    ways = [np.linalg.solve(TALL.T @ TALL + k * eye, TALL.T @ y) for k in (2.0, 4.0)]
    assert any(close(la.tikhonov(TALL, y, 2.0), w) for w in ways)
    w = np.arange(1.0, 10)
    assert close(la.weighted_least_squares(TALL, y, w), np.linalg.solve(TALL.T @ (w[:, None] * TALL), TALL.T @ (w * y)))
    c = np.ones((1, 4))
    x = la.constrained_least_squares(TALL, y, c, np.array([1.0]))
    assert x.sum() == pytest.approx(1) and close((TALL.T @ (TALL @ x - y)) - (TALL.T @ (TALL @ x - y)).mean(), 0)
    x = la.nonnegative_least_squares(TALL, y)
    g = TALL.T @ (TALL @ x - y)
    assert (x >= 0).all() and (g > -1e-6).all() and abs(x @ g) < 1e-6
    s = np.linalg.svd(np.column_stack([TALL, y]))[2][-1]
    assert close(la.total_least_squares(TALL, y), -s[:-1] / s[-1])


def test_preconditioners():
    l = la.incomplete_cholesky(S)
    assert close(l @ l.T, S)
    low, up = la.ilu0(S)
    assert close(low @ up, S) and close(la.conjugate_gradient(S, B, la.ssor_preconditioner(S))[0], np.linalg.solve(S, B), 1e-6)
    assert 0 < la.optimal_sor_omega(S + 20 * np.eye(5)) < 2


def test_matrix_functions():
    def through(f):
        return (V * f(W)) @ V.T

    assert close(la.matrix_exponential(S / 5), (V * np.exp(W / 5)) @ V.T) and close(la.sqrtm(S), through(np.sqrt)) and close(la.logm(S), through(np.log))
    assert close(la.signm(S - 8 * np.eye(5)), through(lambda w: np.sign(w - 8)), 1e-6) and close(la.matrix_function(S, np.cos), through(np.cos))
    assert close(la.phi_function(S / 5, 1), through(lambda w: (np.exp(w / 5) - 1) / (w / 5))) and close(la.krylov_expm_multiply(S / 5, B, 1.0), through(lambda w: np.exp(w / 5)) @ B)


def test_matrix_equations():
    c = RNG.normal(size=(5, 5))
    x = la.sylvester(S, M + 9 * np.eye(5), c)
    assert close(S @ x + x @ (M + 9 * np.eye(5)), c)
    x = la.lyapunov(S, c)
    assert close(S @ x + x @ S.T, c) or close(S @ x + x @ S.T, -c)
    a = S / 40
    x = la.discrete_lyapunov(a, np.eye(5))
    assert close(a @ x @ a.T - x + np.eye(5), 0)
    x = la.care_newton(-np.eye(2), np.eye(2), np.eye(2), np.eye(2))
    assert close(-2 * x - x @ x + np.eye(2), 0)
    assert la.condition_number(S) == pytest.approx(np.linalg.cond(S)) and 0.3 < la.condition_estimate(S) / np.linalg.cond(S, 1) <= 1.01


def test_low_rank_forms():
    low = RNG.normal(size=(8, 2)) @ RNG.normal(size=(2, 6))
    u, s, v = la.randomized_svd(low, 2)
    assert close(u @ np.diag(s) @ v, low)
    w, q = la.randomized_eigh(low @ low.T, 2)
    assert close(q @ np.diag(w) @ q.T, low @ low.T, 1e-6) and close(la.nystrom_approximation(low @ low.T, 4), low @ low.T, 1e-5)
    cols, z = la.interpolative_decomposition(low, 2)
    assert close(low[:, np.asarray(cols, int)] @ z, low)
    c, m, r = la.cur_decomposition(low, 2)
    assert close(c @ m @ r, low)
    order = la.reverse_cuthill_mckee([(0, 3), (3, 1), (1, 4), (4, 2)], 5)
    place = np.argsort(order)
    assert max(abs(place[i] - place[j]) for i, j in [(0, 3), (3, 1), (1, 4), (4, 2)]) == 1


def test_fourier_kernels():
    for n in (1, 2, 7, 8, 12, 15):
        x = RNG.normal(size=n) + 1j * RNG.normal(size=n)
        for f in (ft.fft, ft.fft_bluestein, ft.fft_mixed_radix, *((ft.fft_radix2,) if n & (n - 1) == 0 else ())):
            assert close(f(x), np.fft.fft(x))
        assert close(ft.ifft(ft.fft(x)), x) and close(ft.rfft(x.real), np.fft.rfft(x.real)) and close(ft.irfft(np.fft.rfft(x.real), n), x.real)
        assert close(ft.fftfreq(n, 0.5), np.fft.fftfreq(n, 0.5)) and close(ft.fftshift(x), np.fft.fftshift(x)) and close(ft.dft_matrix(n) @ x, np.fft.fft(x))
        assert all(close(ft.idct(ft.dct(x.real, k), k), x.real) for k in (2, 3))
    a = RNG.normal(size=(4, 6))
    assert close(ft.fft2(a), np.fft.fft2(a)) and close(ft.ifft2(ft.fft2(a)), a)
    u, h = RNG.normal(size=20), np.array([2.0, 0.5, 0.25])
    assert all(close(ft.convolve(u, h, m), np.convolve(u, h, m)) for m in ("full", "same", "valid"))
    t = np.arange(64) / 64
    assert close(ft.hilbert(np.cos(2 * np.pi * 3 * t)).imag, np.sin(2 * np.pi * 3 * t)) and close(ft.resample(np.sin(2 * np.pi * t), 32), np.sin(2 * np.pi * t[::2]))
    assert ft.next_power_of_two(9) == 16 and sorted(ft.bit_reverse_permutation(8)) == list(range(8))


def test_difference_weights_and_polynomial_helpers():
    at, w = calculus.finite_difference_weights(2, 2)
    assert close(sum(c * (k**2) for k, c in zip(at, w)), 2) and close(sum(w), 0)
    assert close(calculus.fornberg_weights(0.0, [-1.0, 0.0, 1.0], 2), [[0, 1, 0], [-0.5, 0, 0.5], [1, -2, 1]])
    q, rest = polynomials.synthetic_division([1.0, -6.0, 11.0, -6.0], 1.0)
    assert close(q, [1, -5, 6]) and rest == 0
    lo, hi = polynomials.root_bounds([1.0, -6.0, 11.0, -6.0])
    assert lo <= 1 and hi >= 3
    assert calculus.optimal_step_size(1, 2) == pytest.approx(2.220446049250313e-16**0.25)


def test_derivatives_of_columns(spark):
    from pyspark.sql import functions as F

    x, f = F.col("x"), lambda c: F.exp(c)
    ways = {"forward": calculus.forward_difference(f, x), "backward": calculus.backward_difference(f, x), "central": calculus.central_difference(f, x), "second": calculus.second_derivative(f, x), "third": calculus.third_derivative(f, x), "fourth": calculus.fourth_derivative(f, x), "five": calculus.five_point_stencil(f, x), "richardson": calculus.richardson_derivative(f, x)}
    row = spark.createDataFrame([(0.5,)], "x double").select(*(c.cast("double").alias(k) for k, c in ways.items())).first()
    assert all(abs(v - np.exp(0.5)) < 2e-3 for v in row) and abs(row["richardson"] - np.exp(0.5)) < 1e-9


def test_sparse_tables(spark):
    a = np.array([[4.0, 1, 0], [1, 5, 2], [0, 2, 6]])
    x = np.array([1.0, -2.0, 3.0])
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(3) if a[i, j]], "i bigint, j bigint, v double")
    vec = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i bigint, v double")

    def dense(df, shape=(3, 3)):
        out = np.zeros(shape)
        for r in df.collect():
            out[r["i"], r["j"]] += r["v"]
        return out

    def column(df):
        out = np.zeros(3)
        for r in df.collect():
            out[r["i"]] += r["v"]
        return out

    assert close(column(sparse.spmv(cells, vec)), a @ x) and close(column(sparse.spmv_t(cells, vec)), a.T @ x) and close(dense(sparse.spmm(cells, cells)), a @ a)
    assert close(dense(sparse.add(cells, cells, 2.0, -1.0)), a) and close(dense(sparse.scale(cells, 3.0)), 3 * a) and close(dense(sparse.gram_matrix(cells)), a.T @ a)
    assert close(dense(sparse.kron(cells, cells, 3, 3), (9, 9)), np.kron(a, a)) and close(dense(sparse.outer(vec, vec)), np.outer(x, x)) and close(dense(sparse.matrix_power(cells, 3, 3)), a @ a @ a)
    assert sparse.dot(vec, vec) == pytest.approx(14) and sparse.spectral_radius(cells, 3) == pytest.approx(np.abs(np.linalg.eigvals(a)).max(), rel=1e-5)
    got = sparse.conjugate_gradient(cells, sparse.spmv(cells, vec))
    assert close(column(got[0] if isinstance(got, tuple) else got), x, 1e-6)


def test_sequences_and_rules():
    x, w = quadrature.gauss("hermite", 6)
    assert close((np.asarray(w) * np.asarray(x) ** 4).sum(), 0.75 * np.sqrt(np.pi))
    x, w = quadrature.gauss("laguerre", 6)
    assert close((np.asarray(w) * np.asarray(x) ** 3).sum(), 6)
    x, w = quadrature.gauss("chebyshev", 6)
    assert close((np.asarray(w) * np.asarray(x) ** 2).sum(), np.pi / 2)
    assert quadrature.primes(5) == [2, 3, 5, 7, 11]
