"""Solvers that no query reaches, against closed forms and numpy; p-values against the distributions they name."""

import math

import numpy as np
import pytest

from gridflux.kernels import minima, odes, roots
from gridflux.operators import arrays, stats

LAM = np.array([0.5, 1.0, 2.0])


def decay(t, y):
    return -LAM[:, None] * y


@pytest.mark.parametrize("name", sorted(odes.MULTISTEP))
def test_multistep_methods_converge(name):
    errors = [np.abs(odes.solve_ivp(decay, np.ones((3, 1)), 0.0, 1.0, name, n)[:, 0] - np.exp(-LAM)).max() for n in (40, 80)]
    assert errors[0] < 5e-4 and errors[0] / errors[1] > 3


def test_coefficients_of_adams_methods():
    assert np.allclose(odes.adams_coefficients(4) * 24, [55, -59, 37, -9]) and np.allclose(odes.adams_coefficients(3, True) * 12, [5, 8, -1])


@pytest.mark.parametrize("name", sorted(odes.SPLITTINGS))
def test_splittings_follow_the_oscillator_and_keep_its_energy(name):
    energy = lambda q, p: (q * q + p * p) / 2
    q0 = np.array([1.0, 0.3])
    q, p = odes.symplectic(name, lambda q: -q, q0, np.zeros(2), 20.0, 2000)
    assert np.abs(odes.energy_drift(energy, q0, np.zeros(2), q, p)).max() < 6e-3
    assert np.abs(q - q0 * math.cos(20)).max() < 2e-2


def test_adaptive_steps_differ_by_problem_and_stiffness_is_told():
    y, steps, reached = odes.adaptive_rk(decay, np.ones((3, 1)), 0.0, 5.0)
    assert reached.all() and steps[2] > steps[0] and np.allclose(y[:, 0], np.exp(-5 * LAM), atol=1e-7)
    assert odes.stiffness_ratio(np.diag([-1.0, -1000.0])) == pytest.approx(1000)


def test_nonlinear_implicit_steps():
    y = odes.implicit("radau_iia3", lambda t, y: -50 * (y - np.cos(t)), np.zeros((1, 1)), 0.0, 2.0, 40)
    exact = 50 * (50 * math.cos(2) + math.sin(2)) / 2501
    assert abs(y[0, 0] - exact) < 1e-6


def test_brackets_without_a_change_of_sign_are_told():
    x, _, ok = roots.brent(lambda x: x * x + np.array([1.0, -1.0]), np.zeros(2), np.full(2, 3.0))
    assert math.isnan(x[0]) and not ok[0] and ok[1] and x[1] == pytest.approx(1)
    assert roots.brent(lambda x: x * x - 2, np.zeros(1), np.full(1, 2.0))[1][0] <= 20


def test_other_roots():
    assert np.allclose(roots.find_all_roots(np.sin, 1, 10), np.pi * np.arange(1, 4))
    assert roots.newton_polynomial([1.0, 0, -2], 1.0)[0] == pytest.approx(math.sqrt(2))
    assert roots.fixed_point_system(lambda v: np.cos(v), [0.5])[0] == pytest.approx(0.7390851332)
    assert roots.anderson_acceleration(lambda v: np.cos(v), [0.5])[1] < 15
    path = roots.continuation(lambda x, t: x**2 - t, [1.0], [1.0, 2.0, 3.0])
    assert np.allclose(path[:, 0], np.sqrt([1, 2, 3]))
    assert len(roots.sturm_chain([1.0, 0, -1])) == 3


def rosen(v):
    return (1 - v[0]) ** 2 + 5 * (v[1] - v[0] ** 2) ** 2


@pytest.mark.parametrize("name", sorted(set(minima.METHODS) - {"rmsprop", "coordinate_descent", "steepest_descent_opt"}))
def test_minimisers_on_a_curved_valley(name):
    x, value, _, _ = minima.minimize(rosen, [-0.5, 1.0], name)
    assert np.abs(x - 1).max() < 1e-2 and value < 1e-4


def test_line_searches_meet_their_conditions():
    x, g = np.array([3.0, 2.0]), minima.numerical_gradient(rosen, np.array([3.0, 2.0]))
    for search in (minima.backtracking, minima.goldstein, minima.wolfe, minima.strong_wolfe, minima.exact_line_search):
        t = search(rosen, x, -g, g)
        assert t > 0 and rosen(x - t * g) < rosen(x)


def test_boxes_sparse_fits_and_curves():
    bowl = lambda v: (v[0] - 1) ** 2 + 2 * (v[1] + 0.5) ** 2
    assert np.allclose(minima.lbfgsb(bowl, [3.0, 2.0], [1.5, -5], [5, 5])[0], [1.5, -0.5], atol=1e-5)
    rng = np.random.default_rng(1)
    a = rng.normal(size=(20, 4))
    b = a @ [1, 0, -2, 0] + 0.01 * rng.normal(size=20)
    fits = [f(a, b, 0.5) for f in (minima.lasso, minima.fista, minima.ista, minima.admm_lasso)]
    assert all(np.allclose(f, fits[0], atol=1e-7) for f in fits) and fits[0][1] == 0
    assert np.allclose(minima.elastic_net(a, b, 0.0, 2.0), np.linalg.solve(a.T @ a + 2 * np.eye(4), a.T @ b))
    x = np.linspace(0, 2, 20)
    assert np.allclose(minima.curve_fit(lambda x, s, k: s * np.exp(-k * x), x, 3 * np.exp(-1.3 * x), [1.0, 1.0]), [3, 1.3])
    assert np.allclose(minima.gauss_newton(lambda p: p[0] * np.exp(-p[1] * x) - 3 * np.exp(-1.3 * x), [2.0, 1.0])[0], [3, 1.3])
    assert np.allclose(minima.project_simplex(np.array([0.5, 2.0, -1.0])), [0, 1, 0]) and np.linalg.norm(minima.project_ball(np.ones(4))) == pytest.approx(1)
    for step in (minima.dogleg, minima.steihaug_cg, minima.cauchy_point):
        assert np.allclose(minima.trust_region(bowl, [3.0, 2.0], step=step)[0], [1, -0.5], atol=1e-5)


def test_p_values():
    assert stats.p_value_t(1.7, 1) == pytest.approx(1 - 2 / math.pi * math.atan(1.7))
    assert stats.p_value_chi_square(3.0, 2) == pytest.approx(math.exp(-1.5))
    assert stats.p_value_f(2.5, 1, 7) == pytest.approx(stats.p_value_t(math.sqrt(2.5), 7))
    assert stats.quantile_t(0.975, 1) == pytest.approx(math.tan(0.475 * math.pi)) and stats.quantile_t(0.025, 30) == pytest.approx(-2.0422724563, rel=1e-6)
    assert stats.p_value_ks(0.0, 50) == 1 and stats.p_value_ks(0.9, 50) < 1e-6 and stats.p_value_ks(0.2, 50, 60) > stats.p_value_ks(0.3, 50, 60)


def test_student_interval(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0)], "k string, x double")
    got = {r.k: r for r in stats.student_interval(df, "x", 0.95, "k").collect()}
    half = 4.302652729911275 * math.sqrt(7 / 3) / math.sqrt(3)
    assert got["a"].upper == pytest.approx(7 / 3 + half) and got["b"].lower is None or math.isnan(got["b"].lower)


def test_vectors_of_one_element_and_empty_bins(spark):
    one = spark.createDataFrame([(0, 1.0)], "i bigint, v double")
    two = spark.createDataFrame([(0, 2.0)], "i bigint, v double")
    assert sorted((r.i, r.v) for r in arrays.concatenate(one, two).collect()) == [(0, 1.0), (1, 2.0)]
    df = spark.createDataFrame([(1.0,), (1.1,), (9.9,)], "x double")
    assert [r.n for r in stats.histogram(df, "x", 5, (0, 10)).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    assert [r.n for r in arrays.bincount(spark.createDataFrame([(3,), (1,), (3,)], "v int"), "v").orderBy("bin").collect()] == [0, 1, 0, 2]
