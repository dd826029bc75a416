"""G12 against the direct sum over all values."""

from __future__ import annotations

import math

import numpy as np
import pytest

from moodframe.operators.evaluate import _hermite, density_curve


def test_hermite_polynomials():
    assert _hermite(5) == [[1], [0, 1], [-1, 0, 1], [0, -3, 0, 1], [3, 0, -6, 0, 1]]


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(size=3000), np.random.default_rng(2).exponential(size=500) * 1e6,
    [1.0, 2.0], [0.0] * 500 + [1.0], [1e9, 1e9 + 1, 1e9 + 5], np.repeat([3.0, 4.0, 1000.0], 40)])
def test_equals_the_direct_sum(spark, values):
    v = np.asarray(values, dtype=float)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(4)
    got = sorted((r.point, r.x, r.density) for r in density_curve(df, "v", 64).collect())
    h = v.std(ddof=1) * len(v) ** -0.2
    assert [g[0] for g in got] == list(range(64))
    step = (v.max() - v.min()) / 63
    for p, x, density in got:
        assert x == pytest.approx(v.min() + p * step)
        want = np.exp(-0.5 * ((p * step - (v - v.min())) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
        assert abs(density - want) < 1e-12 / h


def test_no_value_is_shuffled(spark):
    plan = density_curve(spark.range(1000).selectExpr("id * 1.5 as v"), "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_without_spread(spark):
    assert density_curve(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect() == []
