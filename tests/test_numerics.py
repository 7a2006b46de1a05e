"""Statistics that SQL does not check, against numpy on generated inputs."""

import numpy as np
import pytest

from gridflux.operators import stats


@pytest.fixture(scope="module")
def xy():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    p = 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - 2 * x[:, 1])))
    return x, (rng.random(400) < p).astype(float)


def test_linear_regression_equals_lstsq(spark, xy):
    x, y = xy
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "x1 double, x2 double, y double")
    row = stats.linear_regression(df, "y", ["x1", "x2"]).first()
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)
    assert np.allclose([row["c_0"], row["c_1"], row["c_2"]], want, atol=1e-9)


def test_describe_handles_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    row = stats.describe(df, "x").first()
    assert row["n"] == 2 and row["mean"] == 2.0


def test_welford_is_stable(spark):
    df = spark.createDataFrame([(1e9 + i,) for i in range(1, 5)], "x double")
    row = stats.welford_mean_var(df, "x").first()
    assert row["variance"] == pytest.approx(5 / 3, rel=1e-9)


def test_elliptic_integrals_end_for_every_parameter():
    from gridflux.kernels import special

    for m in (np.arange(1, 51) / 60, np.linspace(1e-9, 1 - 1e-9, 2001)):
        k, e, kc, ec = special.elliptic_k(m), special.elliptic_e(m), special.elliptic_k(1 - m), special.elliptic_e(1 - m)
        assert np.allclose(kc * e + ec * k - k * kc, np.pi / 2, rtol=1e-9)
    assert np.isfinite(special.elliptic_k(np.linspace(-5, 0.9999, 2000))).all()
