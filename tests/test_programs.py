"""Exact derivatives, stochastic paths, generators, programs and random quadrature against brute force or known values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflux.functions import autodiff as ad
from gridflux.kernels import programs
from gridflux.operators import adaptive, generators, sde, stats


def test_powers_and_quotients_by_both_ways(spark):
    rows = spark.createDataFrame([(-2.0, 0.5), (1.5, 3.0)], "x double, y double")

    def f(v):
        return (v[0] ** 3 - 2) / (1 + v[1] * v[1]) + 2 / v[1] + ad.sqrt(v[1]) * ad.cos(v[0]) - 3 * v[0]

    x = [F.col("x"), F.col("y")]
    for r in rows.select("x", "y", *(c.alias(n) for n, c in zip("abcd", ad.gradient(f, x) + ad.forward_gradient(f, x)))).collect():
        gx = 3 * r.x**2 / (1 + r.y**2) - math.sqrt(r.y) * math.sin(r.x) - 3
        gy = -(r.x**3 - 2) * 2 * r.y / (1 + r.y**2) ** 2 - 2 / r.y**2 + 0.5 / math.sqrt(r.y) * math.cos(r.x)
        assert np.allclose([r.a, r.b, r.c, r.d], [gx, gy, gx, gy])


def test_a_function_that_ignores_a_variable_has_zero_slope(spark):
    got = spark.range(1).select(*(c.alias(f"g{i}") for i, c in enumerate(ad.gradient(lambda v: v[0] * 2.0, [F.lit(1.0), F.lit(2.0)])))).first()
    assert tuple(got) == (2.0, 0.0)


def test_paths_meet_their_moments(spark):
    paths = spark.range(20_000).select("id", F.lit(1.0).alias("x0"))
    got = sde.simulate(paths, "id", "x0", lambda x: 0.5 * x, lambda x: 0.3 * x, 1.0, 20, "milstein").agg(F.avg("x"), F.var_samp("x")).first()
    assert got[0] == pytest.approx(math.exp(0.5), rel=0.02) and got[1] == pytest.approx(math.exp(1.0) * (math.exp(0.09) - 1), rel=0.08)
    assert sde.cox_ingersoll_ross(paths, "id", "x0", 2.0, 0.7, 0.4, 1.0, 20).agg(F.avg("x")).first()[0] == pytest.approx(0.7 + 0.3 * math.exp(-2), rel=0.03)
    n = sde.poisson_process(paths.limit(2000), "id", 3.0, 4.0).groupBy("id").count().agg(F.avg("count"), F.var_samp("count")).first()
    assert n[0] == pytest.approx(12, rel=0.03) and n[1] == pytest.approx(12, rel=0.15)


def test_paths_do_not_depend_on_partitions(spark):
    paths = spark.range(50).select("id", F.lit(1.0).alias("x0"))
    one, many = (dict(sde.ornstein_uhlenbeck(p, "id", "x0", 1.0, 0.0, 1.0, 1.0, 8).select("id", "x").collect()) for p in (paths.coalesce(1), paths.repartition(7)))
    assert one == many


def test_tamed_step_stays_finite(spark):
    got = sde.simulate(spark.range(100).select("id", F.lit(30.0).alias("x0")), "id", "x0", lambda x: -x * x * x, lambda x: x * 0 + 0.1, 1.0, 50, "tamed_euler")
    assert got.agg(F.max(F.abs("x"))).first()[0] < 5


def test_generators(spark):
    word, x, want = 2**64 - 1, 12345, []
    for _ in range(5):
        x = x ^ (x << 13 & word)
        x = x ^ (x >> 7)
        x = x ^ (x << 17 & word)
        want.append(x / 2**64)
    seeds = spark.createDataFrame([(1, 12345)], "s int, seed long")
    assert [r.u for r in generators.xorshift(seeds, "s", "seed", 5).orderBy("k").collect()] == want
    first = generators.mersenne_twister(spark.createDataFrame([(1, 5489)], "s int, seed long"), "s", "seed", 2).orderBy("k").collect()
    assert [round(r.u * 2**32) for r in first] == [3499211612, 581869302]  # the published first outputs
    far = spark.range(1).select(generators.lcg(F.lit(10**9), 1).alias("x")).first().x
    a, c, k, m = 1103515245, 12345, 10**9, 2**31
    assert far == (pow(a, k, m) + c * (pow(a, k, m * (a - 1)) - 1) // (a - 1)) % m


def test_discrete_draws_keep_their_weights(spark):
    got = dict(generators.sample_discrete(spark.range(40_000), "id", [1, 2, 0, 5]).groupBy("outcome").count().collect())
    assert set(got) == {0, 1, 3} and [got[k] / 40_000 for k in (0, 1, 3)] == pytest.approx([0.125, 0.25, 0.625], abs=0.012)


@pytest.mark.parametrize("method", programs.SOLVERS)
def test_linear_programs_equal_the_best_vertex(method):
    rng = np.random.default_rng(3)
    for _ in range(10):
        a, c = rng.uniform(0.1, 1, (4, 3)), rng.uniform(-1, 0.2, 3)
        planes, ends = np.vstack([a, -np.eye(3)]), np.r_[np.ones(4), np.zeros(3)]
        best = 0.0
        for rows in itertools.combinations(range(7), 3):
            p = planes[list(rows)]
            if abs(np.linalg.det(p)) > 1e-9 and (planes @ (v := np.linalg.solve(p, ends[list(rows)])) <= ends + 1e-9).all():
                best = min(best, float(c @ v))
        assert programs.linprog(c, a, np.ones(4), method=method)[1] == pytest.approx(best, abs=1e-6)


def test_programs_without_an_answer_and_with_repeated_rows():
    with pytest.raises(programs.Infeasible):
        programs.linprog([1.0], [[1.0], [-1.0]], [1.0, -2.0])
    with pytest.raises(programs.Unbounded):
        programs.linprog([-1.0, 0.0], [[0.0, 1.0]], [1.0])
    x, value = programs.linprog([1.0, 2.0], a_eq=[[1, 1], [2, 2]], b_eq=[3, 6])
    assert value == pytest.approx(3) and x == pytest.approx([3, 0])


def test_assignments_equal_all_permutations():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        cost = rng.integers(-9, 9, (n, m)).astype(float)
        sums = [sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)]
        cols, total = programs.assignment(cost)
        assert total == min(sums) and len(set(cols)) == n and programs.assignment(cost, True)[1] == max(sums)


def test_quadratic_program_meets_its_conditions():
    rng = np.random.default_rng(7)
    for _ in range(10):
        m = rng.normal(size=(4, 4))
        g, c, a, b = m @ m.T + np.eye(4), rng.normal(size=4) * 3, rng.normal(size=(5, 4)), np.full(5, 0.5)
        x = programs.active_set_qp(g, c, a, b)
        held = np.flatnonzero(a @ x > b - 1e-7)
        mu = np.zeros(5)
        mu[held] = np.linalg.lstsq(a[held].T, -(g @ x + c), rcond=None)[0]
        assert programs.kkt_residual(g @ x + c, ineq_jac=a, mu=mu, ineq=a @ x - b) < 1e-6


def test_random_quadrature_lies_within_its_errors(spark):
    true = 1 - math.exp(-1)
    f = lambda x: F.exp(-x)
    got = [
        adaptive.stratified(spark, f, 0.0, 1.0), adaptive.antithetic(spark, f, 0.0, 1.0), adaptive.control_variates(spark, f, lambda x: x, 0.5, 0.0, 1.0),
        adaptive.importance(spark, lambda x: F.exp(-x) * (x <= 1).cast("double"), lambda u: -F.log1p(-u) / 2, lambda x: 2 * F.exp(-2 * x)), adaptive.hit_or_miss(spark, f, 0.0, 1.0, 1.0),
    ]
    for df in got:
        r = df.first()
        assert abs(r.integral - true) < 4 * r.std_error and 0 < r.std_error < 0.01


def test_adaptive_reports_what_it_cannot_reach():
    value, error, ok = adaptive.adaptive(lambda p, x: np.where(x > p, 1.0, 0.0), np.array([0.3, 2.0]), np.zeros(2), np.ones(2), "simpson", 1e-12, 10)
    assert value == pytest.approx([0.7, 0.0], abs=1e-3) and list(ok) == [False, True]


def test_permutations_keep_group_sizes(spark):
    rows = [(i, "a" if i < 6 else "b", float(i * i % 11)) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = stats.permutation_test(df, "v", "g", "a", "b", "id", 3000).first()
    v = np.array([r[2] for r in rows])
    gap = lambda s: v[list(s)].mean() - np.delete(v, list(s)).mean()
    seen, all_gaps = gap(range(6)), [gap(s) for s in itertools.combinations(range(10), 6)]
    assert got.observed == pytest.approx(seen) and got.p_value == pytest.approx(np.mean(np.abs(all_gaps) >= abs(seen) - 1e-12), abs=0.04)
