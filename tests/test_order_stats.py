"""Selection without a sort, held against numpy."""

import math

import numpy as np
from pyspark.sql import functions as F

from kalibra.operators import diagnostics
from kalibra.operators.order_stats import kth_largest, quantiles, top_sums


def _table(spark, **values):
    return spark.createDataFrame([(p, float(v)) for p, vs in values.items() for v in vs], "policy string, w double")


def _asked(spark, *pairs):
    return spark.createDataFrame(list(pairs), "policy string, k long")


def test_every_rank_of_values_of_all_sizes(spark):
    x = [0.0, -0.0, 5e-324, 1e-323, -5e-324, 1e-300, 1.0, 1.0, np.nextafter(1.0, 2), 1e308, -1e308, 3.0, -3.0, math.inf, -math.inf, 1.0, 7e-9]
    want = sorted(x, reverse=True)
    got = {r.k: r for r in kth_largest(_table(spark, a=x), _asked(spark, *[("a", k) for k in range(0, len(x) + 3)])).collect()}
    assert sorted(got) == list(range(1, len(x) + 1))  # ranks below 1 or beyond the number of values have no row
    for k, r in got.items():
        assert r.edge == want[k - 1] and r.over == sum(v > r.edge for v in x)
        assert r.sum_over == sum(v for v in x if v > r.edge) or math.isnan(r.sum_over)
        assert (r.ln_over is None) == any(v <= 0 for v in x if v > r.edge)


def test_ties_and_nulls(spark):
    rows = _table(spark, same=[2.5] * 500, few=[1.0, 2.0]).unionByName(spark.createDataFrame([("few", None), ("few", float("nan")), ("none", None)], "policy string, w double"))
    got = {(r.policy, r.k): (r.edge, r.sum) for r in top_sums(rows, _asked(spark, ("same", 1), ("same", 499), ("few", 2), ("few", 3), ("none", 1), ("gone", 1))).collect()}
    assert got == {("same", 1): (2.5, 2.5), ("same", 499): (2.5, 499 * 2.5), ("few", 2): (1.0, 3.0)}
    assert {(r.policy, r.p): r.q for r in quantiles(rows, (0.0, 0.5, 1.0)).collect()} == {("same", 0.0): 2.5, ("same", 0.5): 2.5, ("same", 1.0): 2.5, ("few", 0.0): 1.0, ("few", 0.5): 1.5, ("few", 1.0): 2.0}
    assert kth_largest(rows.limit(0), _asked(spark, ("same", 1))).count() == 0


def test_one_policy_of_a_million_beside_a_small_one(spark):
    ids = spark.range(1_000_000)
    big = ids.select(F.lit("big").alias("policy"), F.exp(F.sin(F.col("id") * 12.9898) * 20 + F.col("id") % 7).alias("w"))
    rows = big.unionByName(_table(spark, small=range(1, 101)))
    x = np.sort(np.array([r.w for r in big.select("w").collect()]))[::-1]
    got = {(r.policy, r.k): r for r in top_sums(rows, _asked(spark, ("big", 1), ("big", 10_000), ("big", 777_777), ("small", 5))).collect()}
    for k in (1, 10_000, 777_777):
        assert got["big", k].edge == x[k - 1] and math.isclose(got["big", k].sum, math.fsum(x[:k]), rel_tol=1e-9) and math.isclose(got["big", k].ln_sum, math.fsum(np.log(x[:k])), rel_tol=1e-9)
    assert got["small", 5].sum == 490.0
    for r in quantiles(big, (0.05, 0.5, 0.99)).collect():
        assert math.isclose(r.q, np.quantile(x, r.p), rel_tol=1e-12)


def test_no_policy_is_sorted(spark):
    """Windows see bins only: none of the plans of tails ranks rows."""
    rows = _table(spark, a=range(1, 300), b=[1.0] * 50)
    for made in (diagnostics.mass_concentration(rows), diagnostics.hill_tail_index(rows), diagnostics.tail_ratio(rows), diagnostics.overlap_card(rows)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "percentile" not in plan
    assert {r.policy: r.alpha for r in diagnostics.hill_tail_index(rows).collect()}["b"] == math.inf


def test_extremes_cut_groups_before_the_shuffle(spark):
    rows = _table(spark, a=[3, 1, 2, 2, 5, 9]).withColumn("row_id", F.monotonically_increasing_id())
    made = diagnostics.extremes(rows, 2)
    assert "WindowGroupLimit" in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.side, r.rn, r.w) for r in made.collect()) == [("bottom", 1, 1.0), ("bottom", 2, 2.0), ("top", 1, 9.0), ("top", 2, 5.0)]
