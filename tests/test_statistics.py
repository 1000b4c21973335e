"""Resampling weights and the logistic regression against what they stand for."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import resample, stats, train


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 1_000, 70_000])
def test_weights_are_poisson_numbers(n):
    """Mean and variance of a cell of n rows are n, for many cells in one replicate and for one cell in many."""
    cells = resample.code(np.arange(20_000, dtype=np.float64) * 37, 1)
    many = resample.weights(cells, np.full(len(cells), n), 5, 13)
    one = np.array([resample.weights(cells[:1], np.array([n]), r, 13)[0] for r in range(3_000)])
    for x in (many, one):
        assert abs(x.mean() - n) < 5 * math.sqrt(n / len(x)) and abs(x.var() / n - 1) < 0.15
    again = resample.weights(cells[::-1], np.full(len(cells), n), 5, 13)[::-1]
    assert (many == again).all() and (many != resample.weights(cells, np.full(len(cells), n), 6, 13)).any()


def test_cells_and_replicates_are_drawn_apart():
    cells = resample.code(np.array([0.0, 1.0, -1.0, 0.5, 1e12, -1e300, 2.0**-40]), 0)
    assert len(set(cells.tolist())) == 6  # scores that differ by less than 2**-30 share a draw
    u = np.array([resample.uniform(cells[:2], 0, r, 13) for r in range(4_000)]) / resample.PRIME
    assert abs(np.corrcoef(u.T)[0, 1]) < 0.06 and abs(np.corrcoef(u[1:, 0], u[:-1, 0])[0, 1]) < 0.06
    assert np.abs(np.histogram(u[:, 0], 10)[0] - 400).max() < 110


def test_the_interval_is_that_of_resampled_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), float(np.round(rng.normal() + 0.7 * (i % 2), 1)), int(i % 2)) for i in range(300)]
    got = stats.bootstrap_auc_ci(spark.createDataFrame(rows, "id int, s double, y int"), "s", "y", reps=600).first()
    s, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    drawn = []
    for _ in range(600):
        at = rng.integers(0, len(rows), len(rows))
        a, h = s[at][y[at] == 1], np.sort(s[at][y[at] == 0])
        drawn.append((np.searchsorted(h, a, "left") + np.searchsorted(h, a, "right")).mean() / (2 * len(h)))
    lo, hi = np.quantile(drawn, [0.025, 0.975])
    assert abs(got.lo - lo) < 0.015 and abs(got.hi - hi) < 0.015 and got.reps_used == 600
    nothing = stats.bootstrap_auc_ci(spark.createDataFrame([], "s double, y int"), "s", "y", reps=10).first()
    assert (nothing.lo, nothing.hi, nothing.reps_used) == (None, None, 0)


def test_newton_agrees_with_the_ml_library(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 3, 0]
    y = (x @ [1.5, -0.3, 4] + rng.logistic(size=400) > -1).astype(int)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    rows[3] = (None, *rows[3][1:])
    df = spark.createDataFrame(rows, "a double, b double, c double, label double")
    model = train.train(df, "label", ["a", "b", "c"])
    z = np.array([[(v if v is not None else model["impute"][k]) for k, v in zip("abc", r)] for r in rows])
    z = np.clip((z - model["mean"]) / model["std"], -6, 6)
    ready = spark.createDataFrame([(z_.tolist(), r[3]) for z_, r in zip(z, rows)], "z array<double>, label double").select("label", array_to_vector(F.col("z")).alias("features"))
    fitted = LogisticRegression(regParam=1 / 400, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(ready)
    assert model["coef"] == pytest.approx(fitted.coefficients.toArray().tolist(), abs=1e-5) and model["intercept"] == pytest.approx(fitted.intercept, abs=1e-5)
    # separable rows: the penalty keeps the coefficients finite
    apart = spark.createDataFrame([(float(i), float(i > 50)) for i in range(100)], "a double, label double")
    m = train.train(apart, "label", ["a"], steps=30)
    w = np.array([m["intercept"], *m["coef"]])
    zz = np.column_stack([np.ones(100), np.clip((np.arange(100) - m["mean"][0]) / m["std"][0], -6, 6)])
    p = 1 / (1 + np.exp(-zz @ w))
    assert np.abs(zz.T @ (p - (np.arange(100) > 50)) + w * [0, 1]).max() < 1e-8
    with pytest.raises(ValueError):
        train.train(apart.where("label = 1"), "label", ["a"])
    with pytest.raises(ValueError):
        train.train(apart.limit(0), "label", ["a"])


def test_edges_of_ranges_are_settled_before_two_branches_read_them(spark):
    """Approximate quantiles may come out differently each time they are computed."""
    h = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("score"), F.lit(1).cast("long").alias("c"))
    out = stats.running(h, {"upto": "c"}, ["g"])
    assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("upto <> floor(score / 2)").count() == 0 and out.count() == 4000
