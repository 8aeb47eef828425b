"""Residualised influence, the fast projection, normality and exact Kendall p-values against rules restated in plain numpy."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from kalibra.functions.stats import kendall_exact, normal_cdf, normal_ppf
from kalibra.operators import diagnostics, projection, residuals, shape, splines
from kalibra.operators.isotonic import pool


def test_kendalls_p_over_all_orders():
    for n in range(2, 8):
        out_of_order = [sum(a > b for a, b in itertools.combinations(order, 2)) for order in itertools.permutations(range(n))]
        middle = n * (n - 1) / 4
        for d in range(n * (n - 1) // 2 + 1):
            assert math.isclose(kendall_exact(n, d), np.mean([abs(x - middle) >= abs(d - middle) for x in out_of_order]))
    assert kendall_exact(34, 2) is None and kendall_exact(33, 264) == 1 and 0 < kendall_exact(33, 100) < 1
    assert math.isclose(kendall_exact(40, 0), 2 / math.factorial(40)) and math.isclose(kendall_exact(40, 1), 80 / math.factorial(40)) and kendall_exact(500, 0) == 0


def test_drift_of_untied_rows_is_counted_out(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(x), float(y)) for k in range(4) for x, y in zip(rng.permutation(6), rng.permutation(6), strict=True)]
    got = {r["k"]: r for r in diagnostics.kendall_drift(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y", counted=True).collect()}
    for k in range(4):
        own = [(x, y) for q, x, y in rows if q == k]
        d = sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for a, b in itertools.combinations(own, 2))
        assert math.isclose(got[k]["tau"], 1 - 4 * d / 30) and math.isclose(got[k]["p_value"], kendall_exact(6, d))
    moved = diagnostics.label_drift(spark.createDataFrame([(0, float(i), float(i)) for i in range(5)] + [(1, float(i), float(-i)) for i in range(5)] + [(2, 1.0, 1.0)], "k int, x double, y double"), "k", "x", "y")
    assert [(r["tau_change"], r["drift"], r["severity"]) for r in moved.orderBy("batch").collect()] == [(-2.0, True, "high"), (None, None, None)]


#: Braking distances and speeds of cars (Ezekiel 1930); weights of eleven men (Shapiro and Wilk 1965).
SPEED = [4, 4, 7, 7, 8, 9, 10, 10, 10, 11, 11, 12, 12, 12, 12, 13, 13, 13, 13, 14, 14, 14, 14, 15, 15, 15, 16, 16, 17, 17, 17, 18, 18, 18, 18, 19, 19, 19, 20, 20, 20, 20, 20, 22, 23, 24, 24, 24, 24, 25]
DISTANCE = [2, 10, 4, 22, 16, 10, 18, 26, 34, 17, 28, 14, 20, 24, 28, 26, 34, 34, 46, 26, 36, 60, 80, 20, 26, 54, 32, 40, 32, 40, 50, 42, 56, 76, 84, 36, 46, 68, 32, 48, 52, 56, 64, 66, 54, 70, 92, 93, 120, 85]
MEN = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


@pytest.mark.parametrize(("x", "w", "p"), [(SPEED, 0.97765, 0.4576), (DISTANCE, 0.95144, 0.0391), (MEN, 0.78881, 0.006704), (range(1, 11), 0.97016, 0.8924)])
def test_shapiro_and_wilk_as_published(x, w, p):
    got = shape.shapiro_wilk(np.array(x, float))
    assert abs(got[0] - w) < 6e-6 and abs(got[1] - p) < 6e-5


def test_normality_and_quantiles(spark):
    rng = np.random.default_rng(6)
    made = {"few": [1.0, 2.0], "flat": [3.0] * 40, "small": list(rng.normal(2, 3, 300)), "tied": list(np.round(rng.normal(0, 1, 900), 1)), "skewed": list(rng.exponential(1, 700))}
    df = spark.createDataFrame([(p, i, float(v)) for p, x in made.items() for i, v in enumerate(x)] + [("small", 999, None)], "policy string, row_id int, phi double")
    got = {r["policy"]: r for r in shape.normality(df, 500).collect()}
    assert got["few"]["test"] is None and got["flat"]["p_value"] is None and got["flat"]["n"] == 40
    assert np.allclose((got["small"]["statistic"], got["small"]["p_value"]), shape.shapiro_wilk(np.array(made["small"])))
    for p in ("tied", "skewed"):
        x, n = np.sort(made[p]), len(made[p])
        z = (x - x.mean()) / x.std(ddof=1)
        a2 = -n - np.mean([(2 * i + 1) * (math.log(normal_cdf(z[i])) + math.log(normal_cdf(-z[n - 1 - i]))) for i in range(n)])
        assert got[p]["test"] == "anderson-darling" and math.isclose(got[p]["statistic"], a2, rel_tol=1e-9)
    assert got["skewed"]["p_value"] == 0.01 and not got["skewed"]["normal"] and got["tied"]["normal"]
    points = {(r["policy"], round(r["p"], 2)): r for r in shape.qq_points(df, 9).collect()}
    for p in ("small", "tied"):
        x = np.array(made[p])
        for q in range(1, 10):
            assert math.isclose(points[p, q / 10]["sample"], np.quantile((x - x.mean()) / x.std(), q / 10), rel_tol=1e-9, abs_tol=1e-12) and math.isclose(points[p, q / 10]["normal"], normal_ppf(q / 10))
    with pytest.raises(ValueError):
        shape.shapiro_wilk(np.ones(2))


def _fast(w):
    """The falling fit of the excess added up, taken apart, raised to its running maximum, of mean one."""
    w = np.sort(w) / np.mean(w)
    z = np.cumsum(w - 1)
    starts = pool(-z, np.ones(len(z)))
    y = np.repeat(np.add.reduceat(z, starts) / np.diff(np.append(starts, len(z))), np.diff(np.append(starts, len(z))))
    v = np.maximum.accumulate(np.clip(np.diff(np.append(0.0, y)) + 1, 0, None))
    return v * len(v) / v.sum()


@pytest.mark.parametrize("seed", range(4))
def test_fast_projection(spark, seed):
    rng = np.random.default_rng(seed)
    made = {"heavy": np.exp(rng.normal(0, 1.5, 200)), "tied": rng.integers(0, 4, 150).astype(float), "flat": np.full(30, 2.5), "one": np.array([3.0]), "spike": np.append(np.full(50, 0.1), 9.0), "few": rng.integers(1, 3, 7).astype(float)}
    rows = [(p, i, float(v)) for p, w in made.items() for i, v in enumerate(w)] + [("none", i, 0.0) for i in range(4)]
    out = projection.fast(spark.createDataFrame(rows, "policy string, row_id int, w double").repartition(3)).toPandas()
    for p, w in made.items():
        own = out[out.policy == p].sort_values(["w", "row_id"])
        assert np.allclose(own.w_fast, _fast(w), atol=1e-9), p
        assert math.isclose(own.w_fast.mean(), 1)
    assert (out[out.policy == "none"].w_fast == 1).all()


def test_spearman(spark):
    rng = np.random.default_rng(8)
    made = {"a": (rng.integers(0, 5, 60), rng.integers(0, 7, 60)), "b": (rng.normal(size=40), rng.normal(size=40)), "flat": (np.ones(9), np.arange(9))}
    rows = [(k, float(x), float(y)) for k, (a, b) in made.items() for x, y in zip(a, b, strict=True)] + [("a", None, 1.0)]
    got = {r["k"]: r["rho"] for r in residuals.spearman(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    for k in ("a", "b"):
        assert math.isclose(got[k], np.corrcoef(pd.Series(made[k][0]).rank(), pd.Series(made[k][1]).rank())[0, 1], rel_tol=1e-9)
    assert got["flat"] is None


def _spline(x, y, at):
    """Penalised splines on rows, the penalty by leave-one-out errors."""
    low, high, n = x.min(), x.max(), min(8, max(4, len(x) // 20))
    design = lambda v: np.column_stack([np.ones(len(v)), splines.basis(v, low, high, n)])
    b, best = design(x), None
    for a in np.logspace(-3, 3, 13):
        inverse = np.linalg.pinv(b.T @ b + a * np.diag([0.0, *np.ones(b.shape[1] - 1)]))
        w = inverse @ b.T @ y
        loo = (((y - b @ w) / (1 - np.diag(b @ inverse @ b.T))) ** 2).sum()
        best = min(best or (np.inf, None), (loo, tuple(w)))
    return design(at) @ np.array(best[1])


@pytest.mark.parametrize(("form", "cross_fit"), [("spline", True), ("spline", False), ("isotonic", True)])
def test_residualised_influence(spark, form, cross_fit):
    rng = np.random.default_rng(5)
    n = 240
    pdf = pd.DataFrame({"policy": np.where(np.arange(n) < 200, np.where(np.arange(n) % 2, "up", "down"), "few"), "row_id": range(n), "fold": np.arange(n) % 5, "s": np.round(rng.uniform(0, 1, n), 2)})
    pdf["phi"] = np.where(pdf.policy == "up", 1, -1) * np.sin(3 * pdf.s) + rng.normal(0, 0.2, n)
    pdf.loc[4, "s"] = np.nan
    own = spark.createDataFrame([(r.policy, r.row_id, r.fold, 1.0, r.phi) for r in pdf.itertuples()], "policy string, row_id int, fold int, c double, phi double")
    rows = spark.createDataFrame([(r.policy, r.row_id, None if math.isnan(r.s) else r.s) for r in pdf.itertuples()], "policy string, row_id int, judge_score double")
    left, summary = residuals.residualised(own, rows, form, cross_fit)
    got, facts = {r["row_id"]: r["phi"] for r in left.collect()}, {r["policy"]: r for r in summary.collect()}
    for policy, g in pdf.groupby("policy"):
        h = np.zeros(len(g))
        if policy != "few":
            known = g[g.s.notna()]
            for fold in range(5):
                train, mine = (known[known.fold != fold], (g.fold == fold).to_numpy()) if cross_fit else (known, np.ones(len(g), bool))
                x = g.s.fillna(0.5).to_numpy()[mine]
                if form == "spline":
                    h[mine] = _spline(train.s.to_numpy(), train.phi.to_numpy(), x)
                else:
                    sign = np.sign(np.corrcoef(known.s.rank(), known.phi.rank())[0, 1])
                    mean = train.groupby("s").phi.agg(["mean", "count"])
                    starts = pool(sign * mean["mean"].to_numpy(), mean["count"].to_numpy(float))
                    value = np.add.reduceat((mean["mean"] * mean["count"]).to_numpy(), starts) / np.add.reduceat(mean["count"].to_numpy(), starts)
                    h[mine] = np.interp(x, mean.index, np.repeat(value, np.diff(np.append(starts, len(mean)))))
            h[g.s.isna().to_numpy()] = known.phi.mean()
        want = g.phi.to_numpy() - (h - h.mean())
        assert np.allclose([got[i] for i in g.row_id], want, atol=1e-8), policy
        v0, v1, f = g.phi.var(), want.var(ddof=1), facts[policy]
        assert f["applied"] == (policy != "few") and math.isclose(f["se_reduction"], max(0, 1 - math.sqrt(v1 / v0)), abs_tol=1e-9) and math.isclose(f["ess_gain"], v0 / v1, rel_tol=1e-9)
        assert policy == "few" or f["se_reduction"] > (0.3 if form == "spline" else 0)  # the curve isn't monotone
    with pytest.raises(ValueError, match="unknown form"):
        residuals.residualised(own, rows, "other")
