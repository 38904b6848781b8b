"""Grouped ridge regression against normal equations in numpy, and the forecast against a line on the last day alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.fixed_values import FORECAST_DAYS, HISTORY_DAYS
from fleetpulse.operators import mutation as MU
from fleetpulse.operators.ridge import fit_ridge, with_residuals
from fleetpulse.registry import queries_models as Q

SCHEMA = "g string, h int, x array<double>, y array<double>, extra string"


def ridge(x, y, lam):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1), 0)
    b = np.linalg.solve(z.T @ z / len(x) + lam * np.eye(x.shape[1]), z.T @ (y - y.mean(axis=0)) / len(x))
    return y - y.mean(axis=0) - z @ b


def data():
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key, n in (("a", 500), ("b", 60), (None, 40)):
        x = rng.normal(size=(n, 6)) * [1, 100, 0.01, 5, 1, 1] + 7
        x[:, 4] = 3.0  # no influence
        y = x[:, :3] @ rng.normal(size=(3, 2)) + rng.normal(size=(n, 2))
        want[key] = ridge(x, y, 1e-3)
        rows += [(key, 1, p.tolist(), q.tolist(), str(k)) for k, (p, q) in enumerate(zip(x, y))]
    odd = [("a", 1, None, [1.0, 2.0], "null"), ("a", 1, [1.0], [1.0, 2.0], "short"), ("b", 1, [None] + [1.0] * 5, [1.0, 2.0], "hole"), ("c", 1, [1.0] * 6, None, "unfit"), ("d", 2, [1.0] * 6, [1.0, 2.0], "other")]
    return rows, odd, want


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_ridge_agrees_with_normal_equations(spark, limit):
    rows, odd, want = data()
    frame = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    fits = fit_ridge(frame.filter("h = 1"), ["g", "h"], "x", "y", 6, 2)
    assert sorted((r.g or "", r.n) for r in fits.collect()) == [("", 40), ("a", 500), ("b", 60)]
    got = with_residuals(frame, fits, ["g", "h"], "x", "y", "left", broadcast_bytes=limit).collect()
    assert {r.extra for r in got if r.left is None} == {"null", "short", "hole", "unfit", "other"}
    for r in got:
        if r.left is not None:
            assert np.allclose(r.left, want[r.g][int(r.extra)], atol=1e-9)
    residuals = {r.g: r.residuals for r in fits.collect()}
    assert all(np.allclose(residuals[k], (v ** 2).mean(axis=0), rtol=1e-8) for k, v in want.items())
    assert fit_ridge(frame.limit(0), ["g", "h"], "x", "y", 6, 2).count() == 0
    assert with_residuals(frame.limit(0), fits, ["g", "h"], "x", "y", "left").count() == 0


def test_forecast_beats_a_line_on_the_last_day(spark):
    """Series with a weekly rhythm, which the last day alone can't tell. (The given tables are noise: nothing beats their mean.)"""
    rng = np.random.default_rng(2)
    day = np.arange(30)
    history, future = [], []
    for _ in range(800):
        days = 5 * np.sin(2 * np.pi * (day + rng.integers(7)) / 7) + rng.normal(size=30)
        history.append(days[:HISTORY_DAYS].tolist())
        future.append(days[HISTORY_DAYS:].tolist())
    rows = spark.createDataFrame([("m", k < 600, h, f) for k, (h, f) in enumerate(zip(history, future))], "model string, train boolean, history array<double>, future array<double>")
    fits = MU.fit_forecast(rows.filter("train"), ["r"], ["model"])
    factor = fits.first().scale[0]
    left = np.array([r.mutation for r in MU.mutation_vectors(rows.filter("not train"), fits, ["model"]).collect()]) / factor
    x, y = np.array(history), np.array(future)
    lines = [np.polyfit(x[:600, -1], y[:600, s], 1) for s in range(FORECAST_DAYS)]
    line = np.mean([np.square(y[600:, s] - np.polyval(p, x[600:, -1])).mean() for s, p in enumerate(lines)])
    assert np.square(left).mean() < 0.5 * line


def test_mutation_query_covers_all_windows(spark):
    assert Q.mutated(spark, "/root/testdata/sf0.001").filter("mutation is null").count() == 0
