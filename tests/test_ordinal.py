import math
import random

import numpy as np
import pytest

from zoneloom.operators.ordinal import (
    coefficient_table, counterfactual_mean, fit_ordinal, interval_table, simulate_draws,
)

LEVELS, NAMES = ["A", "B", "C", "D"], ["u", "v", "w"]


def sample(n=3000, seed=2, missing=True):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [rng.randint(0, 1), rng.randint(0, 1), rng.choice([0, 1, 2])]
        eta = -0.8 * x[0] + 0.5 * x[1] + 0.3 * x[2]
        noise = math.log(1 / (1 - rng.random()) - 1) * -1
        rows.append((LEVELS[sum(eta + noise > c for c in (-1.0, 0.2, 1.3))], *x))
    if missing:
        rows += [(None, 1, 1, 1), ("A", None, 0, 0), ("E", 1, 1, 1)]
    return rows


def log_likelihood(theta, rows):
    """Straight from the definition, row by row."""
    beta, cuts = theta[:3], [-np.inf, *theta[3:], np.inf]
    total = 0.0
    for y, *x in rows:
        eta, k = float(np.dot(beta, x)), LEVELS.index(y)
        below = [1 / (1 + math.exp(eta - c)) if np.isfinite(c) else float(c > 0) for c in cuts[k : k + 2]]
        total += math.log(below[1] - below[0])
    return total


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(sample(), "y string, u int, v int, w int")
    return df, fit_ordinal(df, "y", NAMES, LEVELS)


def test_fit_is_the_maximum(fitted):
    """The likelihood, worked out independently, is flat at the estimates, and its curvature gives the errors."""
    _, fit = fitted
    rows = [r for r in sample(missing=False)]
    theta, h = np.array([*fit.beta, *fit.cuts]), 1e-3
    base = log_likelihood(theta, rows)
    assert fit.log_likelihood == pytest.approx(base, rel=1e-10)
    unit = np.eye(6) * h
    slope = [(log_likelihood(theta + e, rows) - log_likelihood(theta - e, rows)) / (2 * h) for e in unit]
    assert np.allclose(slope, 0, atol=2e-3)
    curve = np.array([[
        (log_likelihood(theta + a + b, rows) - log_likelihood(theta + a - b, rows) - log_likelihood(theta - a + b, rows) + log_likelihood(theta - a - b, rows)) / (4 * h * h)
        for b in unit] for a in unit])
    assert np.allclose(np.sqrt(np.diag(np.linalg.inv(-curve))), np.sqrt(np.diag(fit.covariance)), rtol=1e-4)
    assert np.max(np.abs(fit.gradient)) < 1e-4
    assert np.allclose(theta, [-0.8, 0.5, 0.3, -1.0, 0.2, 1.3], atol=0.25)


def test_repeated_rows_keep_the_estimates(spark, fitted):
    df, fit = fitted
    twice = fit_ordinal(df.unionAll(df), "y", NAMES, LEVELS)
    assert np.allclose(twice.beta, fit.beta, atol=1e-7) and np.allclose(twice.cuts, fit.cuts, atol=1e-7)
    assert np.allclose(twice.covariance * 2, fit.covariance, rtol=1e-5)


def test_coefficient_table(spark, fitted):
    table = {r.term: r for r in coefficient_table(spark, fitted[1]).collect()}
    assert list(table) == ["u", "v", "w", "A|B", "B|C", "C|D"]
    r = table["u"]
    assert r.t_value == pytest.approx(r.estimate / r.std_error) and r.estimate < 0
    assert r.p_value == pytest.approx(math.erfc(abs(r.t_value) / math.sqrt(2)))


def test_counterfactual_mean(fitted):
    df, fit = fitted
    rows = counterfactual_mean(df, NAMES, fit.beta, fit.cuts[-1], "u", [0, 1]).collect()
    data = [r[1:] for r in [*sample(missing=False), (None, 1, 1, 1), ("E", 1, 1, 1)]]

    def mean(v):
        return np.mean([1 - 1 / (1 + math.exp(-(fit.cuts[-1] - np.dot(fit.beta, [v, *x[1:]])))) for x in data])

    assert [r.mean_prob for r in rows] == [pytest.approx(mean(0)), pytest.approx(mean(1))]
    assert rows[0].difference == pytest.approx(mean(1) - mean(0))


def test_simulated_intervals(fitted):
    df, fit = fitted
    draws = simulate_draws(df, fit, "u", [0, 1], n_draws=400, seed=1).cache()
    assert draws.count() == 400 * 2 * 4
    sums = draws.groupBy("draw", "effect_value").sum("prob").collect()
    assert all(r[2] == pytest.approx(1.0) for r in sums)
    table = {(r.outcome, r.effect_value): r for r in interval_table(draws).collect()}
    rows = counterfactual_mean(df, NAMES, fit.beta, fit.cuts[-1], "u", [0, 1]).collect()
    for r in rows:
        found = table[("D", r.effect_value)]
        assert found.lower < r.mean_prob < found.upper and found.mean == pytest.approx(r.mean_prob, abs=0.01)
    apart = max(table[("D", v)].lower for v in (0.0, 1.0)) > min(table[("D", v)].upper for v in (0.0, 1.0))
    assert table[("D", 0.0)].apart == apart
    again = simulate_draws(df, fit, "u", [0, 1], n_draws=400, seed=1)
    assert interval_table(again).orderBy("outcome", "effect_value").collect() == interval_table(draws).orderBy("outcome", "effect_value").collect()
    text = again._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_errors_are_clear(spark):
    schema = "y string, x int"
    with pytest.raises(ValueError, match="no rows with outcome"):
        fit_ordinal(spark.createDataFrame([("A", 1), ("B", 0)], schema), "y", ["x"], ["A", "B", "C"])
    apart = [("A", 0)] * 20 + [("B", 1)] * 20
    with pytest.raises(ValueError):
        fit_ordinal(spark.createDataFrame(apart, schema), "y", ["x"], ["A", "B"])
    constant = spark.createDataFrame([("A", 1), ("B", 1), ("A", 1)], schema)
    with pytest.raises(ValueError):
        fit_ordinal(constant, "y", ["x"], ["A", "B"])


def test_draws_do_not_depend_on_how_rows_are_dealt(spark):
    from zoneloom.operators.ordinal import normal_draws

    one, many = (normal_draws(spark.newSession(), 4000, 3, seed=5) for _ in range(2))
    rows = {r.draw: tuple(r)[1:] for r in one.coalesce(1).collect()}
    assert rows == {r.draw: tuple(r)[1:] for r in many.repartition(7).collect()}
    z = np.array(list(rows.values()))
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and np.abs(np.corrcoef(z.T) - np.eye(3)).max() < 0.06
