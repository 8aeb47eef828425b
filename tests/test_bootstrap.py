"""Bootstraps of statistics against known errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kalibra.operators import bootstrap as b
from kalibra.operators import inference


def _rows(spark, **keys):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, (xs, ys) in keys.items() for i, (x, y) in enumerate(zip(xs, ys))], "policy string, row_id long, x double, y double")


def test_errors_of_ratio_mean_correlation_and_quantile(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    y = rng.exponential(1, n) + 1
    x = 2 * y + rng.normal(0, 1, n)
    rows = _rows(spark, big=(x, y)).repartition(6)
    one = lambda s: b.bootstrap(rows, s).first()
    r, m, c, q = one(b.ratio("x", "y")), one(b.mean("x")), one(b.correlation("x", "y")), one(b.quantile("x", 0.5, np.linspace(-5, 30, 701)))
    assert r.n == n and 0.98 * b.CELLS < r.cells <= b.CELLS
    assert np.isclose(r.estimate, x.sum() / y.sum()) and np.isclose(r.se, np.std(x - r.estimate * y) / y.mean() / n**0.5, rtol=0.1)
    assert np.isclose(m.estimate, x.mean()) and np.isclose(m.se, x.std() / n**0.5, rtol=0.1) and m.lo < m.estimate < m.hi
    assert np.isclose(c.estimate, np.corrcoef(x, y)[0, 1])
    assert abs(q.estimate - np.median(x)) < 0.01 and 0.005 < q.se < 0.05


def test_clusters_make_errors_larger(spark):
    rng = np.random.default_rng(2)
    shared = np.repeat(rng.normal(0, 1, 200), 50)
    rows = _rows(spark, a=(shared + rng.normal(0, 0.1, 10_000), np.ones(10_000))).withColumn("prompt", F.floor(F.col("row_id") / 50))
    by_row, by_prompt = b.bootstrap(rows, b.mean("x")).first(), b.bootstrap(rows, b.mean("x"), unit="prompt").first()
    assert by_prompt.se > 4 * by_row.se and np.isclose(by_prompt.se, 1 / 200**0.5, rtol=0.25)


@pytest.mark.parametrize("kind", ["stationary", "moving"])
@pytest.mark.parametrize("n", [3000, 12_000])
def test_dependent_rows(spark, kind, n):
    rng = np.random.default_rng(3)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = 0.8 * x[i - 1] + rng.normal()
    rows = _rows(spark, a=(x, np.ones(n))).repartition(5)
    got = b.bootstrap(rows, b.mean("x"), kind=kind, block=60).first()
    assert np.isclose(got.se, 1 / (1 - 0.8) / n**0.5, rtol=0.3) and got.cells == (3000 if n == 3000 else 4000)
    assert got == b.bootstrap(rows.repartition(2), b.mean("x"), kind=kind, block=60).first()


def test_intervals_cover(spark):
    rng = np.random.default_rng(4)
    rows = _rows(spark, **{f"k{i}": (rng.exponential(1, 300), np.ones(300)) for i in range(80)})
    got = b.bootstrap(rows, b.mean("x"), replicates=300).agg(F.avg((F.lit(1.0).between(F.col("lo"), F.col("hi"))).cast("double"))).first()[0]
    assert got > 0.85


def test_nulls_single_rows_and_no_rows(spark):
    rows = spark.createDataFrame([("one", 1, 2.0, 0.0), ("none", 1, None, None), ("none", 2, None, None)], "policy string, row_id long, x double, y double")
    got = {r.policy: r for r in b.bootstrap(rows, b.mean("x")).collect()}
    assert got["one"].estimate == 2.0 and got["one"].se == 0.0 and got["none"].estimate is None and got["none"].se is None
    assert {r.policy: r.estimate for r in b.bootstrap(rows, b.ratio("x", "y")).collect()} == {"one": None, "none": None}
    assert b.bootstrap(rows.limit(0), b.mean("x")).count() == 0
    with pytest.raises(ValueError, match="kind"):
        b.bootstrap(rows, b.mean("x"), kind="other")


def _plain_means(v, length, stationary, replicates, seed, policy):
    """Each replicate's mean from its rows themselves."""
    for rep in range(replicates):
        rng = np.random.default_rng([seed, rep, *policy.encode()])
        starts, sizes = inference._blocks(rng, len(v), length, stationary)
        assert sizes.sum() == len(v) and sizes.min() > 0
        yield np.concatenate([v[(s + np.arange(k)) % len(v)] for s, k in zip(starts, sizes, strict=True)]).mean()


def _broadcast_rows(plan):
    """Rows of each broadcast of a plan that has run."""
    name = plan.nodeName()
    below = [plan.executedPlan()] if name.startswith("Adaptive") else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
    return ([plan.metrics().apply("numOutputRows").value()] if name.startswith("BroadcastExchange") else []) + [n for x in below for n in _broadcast_rows(x)]


def _sent_sparingly(spark, stationary):
    v = np.random.default_rng(5).normal(1, 1, 4000)
    own = spark.createDataFrame([(p, i, float(x)) for p in ("p", "q") for i, x in enumerate(v)], "policy string, row_id int, c double").repartition(3)
    out = inference.block_bootstrap(own, stationary=stationary, replicates=500)
    got = out.collect()
    assert max(_broadcast_rows(out._jdf.queryExecution().executedPlan()), default=0) <= 2  # a row a policy, no draws
    assert {r.policy for r in got} == {"p", "q"}
    for r in got:
        means = np.fromiter(_plain_means(v, r.block, stationary, 500, 17, r.policy), float)
        assert np.allclose([r.estimate, r.se, r.lo, r.hi], [v.mean(), means.std(ddof=1), *np.quantile(means, [0.025, 0.975])])


def test_stationary_blocks_are_summed_by_slices_without_broadcast_draws(spark, monkeypatch):
    monkeypatch.setattr(inference, "SLICE", 300, raising=False)
    _sent_sparingly(spark, True)


def test_moving_blocks_are_summed_by_slices_without_broadcast_draws(spark, monkeypatch):
    monkeypatch.setattr(inference, "SLICE", 300, raising=False)
    _sent_sparingly(spark, False)
