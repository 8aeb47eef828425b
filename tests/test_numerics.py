import math

import numpy as np
import pytest

from kalibra.functions import stats
from kalibra.functions.chat import boundary
from kalibra.operators.isotonic import pool


def test_student_and_normal():
    assert math.isclose(stats.t_ppf(0.975, 4), 2.7764451052, rel_tol=1e-8) and math.isclose(stats.t_ppf(0.975, 1), 12.7062047364, rel_tol=1e-7)
    assert math.isclose(stats.t_cdf(0, 3), 0.5) and math.isclose(stats.normal_ppf(0.975), 1.959963985, rel_tol=1e-8)
    assert math.isclose(stats.t_cdf(-2, 7) + stats.t_cdf(2, 7), 1)


def test_simplex_weights():
    assert np.allclose(stats.simplex_weights(np.diag([1.0, 4.0])), [0.8, 0.2])
    assert np.allclose(stats.simplex_weights(np.array([[1.0, 2.0], [2.0, 5.0]])), [1, 0])
    assert np.allclose(stats.simplex_weights(np.zeros((2, 2))).sum(), 1)


@pytest.mark.parametrize("seed", range(5))
def test_pooling_is_the_min_max_formula_and_may_start_anywhere(seed):
    rng = np.random.default_rng(seed)
    y, w = rng.normal(size=40), rng.uniform(0.1, 2, 40)
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]

    def fitted(starts, y, w):
        sums, weights = np.add.reduceat(y * w, starts), np.add.reduceat(w, starts)
        return sums / weights, weights, np.diff(np.append(starts, len(y)))

    one, _, size = fitted(pool(y, w), y, w)
    assert np.allclose(np.repeat(one, size), want)
    parts = [fitted(pool(y[s], w[s]), y[s], w[s]) for s in (slice(0, 13), slice(13, 27), slice(27, 40))]
    v, ww, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    starts = pool(v, ww)
    two, _, blocks = fitted(starts, v, ww)
    assert np.allclose(np.repeat(two, np.add.reduceat(n, starts)), want)


def test_boundaries():
    assert boundary(["ab", "c", "d"], "abc") == (2, "exact_match") and boundary(["ab", "cd"], "abc") == (None, "boundary_spans_token")
    assert boundary(["x"], "abc") == (None, "echo_mismatch") and boundary(["é", "x"], "é") == (1, "exact_match")


def test_splines_sum_to_one_and_follow_a_curve(spark):
    from pyspark.sql import functions as F

    from kalibra.operators import splines

    x = np.linspace(0, 1, 101)
    b = splines.basis(x, 0, 1, 6)
    assert b.shape == (101, 7) and (b >= -1e-12).all() and (b.sum(axis=1) <= 1 + 1e-12).all() and np.allclose(b[:60].sum(axis=1), 1)
    rows = spark.range(500).select((F.col("id") / 499).alias("x")).withColumn("y", F.sin(3 * F.col("x")))
    got = splines.predict(rows, splines.fit(rows, "x", "y"), "x", "f").toPandas()
    assert np.abs(got["f"].astype(float) - got["y"]).max() < 0.01
