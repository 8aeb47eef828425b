"""Rules of operators restated in plain Python, on small made rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kalibra.functions.chat import boundary
from kalibra.functions.stats import simplex_weights
from kalibra.operators import analysis, assembly, diagnostics, estimators, inference, outcomes, reporting, weights
from kalibra.operators.tables import running
from kalibra.plans import bridge, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return queries.outcomes(spark, SF)


def test_recommendations_follow_the_tree(spark):
    rng = np.random.default_rng(1)
    made = {"even": np.ones(400), "mild": np.exp(rng.normal(0, 0.8, 400)), "wide": np.exp(rng.normal(0, 1.6, 400)), "pareto": rng.pareto(1.1, 400) + 0.01, "spike": np.append(np.full(399, 1e-9), 1.0)}
    data = [(p, i, float(w / v.mean())) for p, v in made.items() for i, w in enumerate(v)]
    got = {r["policy"]: r for r in diagnostics.overlap_card(spark.createDataFrame(data, "policy string, row_id int, w double")).collect()}
    for p, v in made.items():
        w = v / v.mean()
        affinity, e, k = min(1, np.sqrt(np.maximum(w, 1e-10)).mean()), w.sum() ** 2 / (w**2).sum() / len(w), 20
        top = np.sort(w)[::-1]
        excess = np.log(top[:k]).sum() - k * np.log(top[k])
        alpha = k / excess if excess > 0 else math.inf
        quality = "catastrophic" if affinity < 0.2 else "poor" if affinity < 0.35 else "marginal" if affinity < 0.5 else "good"
        want = "refuse" if quality == "catastrophic" else "dr" if alpha < 1.5 else ("refuse" if quality == "poor" else "dr") if e < 0.1 else "calibrated-ips" if e < 0.3 else "ips"
        assert (got[p]["quality"], got[p]["recommendation"]) == (quality, want)


def test_boundary_card_has_a_band_and_the_gap_of_estimates(spark):
    labelled = spark.createDataFrame([(0.2, 0.1), (0.8, 0.9)], "judge_score double, reward double")
    scores = spark.createDataFrame([("a", 0.5, 0.13)] * 3 + [("a", 0.5, 0.5)] * 7 + [("b", 0.1, 0.1)] + [("b", 0.5, 0.5)] * 9 + [("c", 0.5, 0.5)], "policy string, judge_score double, reward double")
    gap = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 0.2)], "policy string, gap double")
    got = {r["policy"]: r for r in diagnostics.boundary_card(scores, labelled, gap).collect()}
    assert math.isclose(got["a"]["saturated"], 0.3) and got["a"]["verdict"] == "CAUTION" and got["a"]["width"] is None
    assert math.isclose(got["b"]["outside"], 0.1) and got["b"]["verdict"] == "REFUSE-LEVEL" and math.isclose(got["b"]["width"], 0.01)
    assert got["c"]["verdict"] == "CAUTION"


def test_tails_without_a_tail(spark):
    data = [("zero", i, 0.0 if i < 30 else 1.0) for i in range(200)] + [("flat", i, 1.0) for i in range(200)] + [("step", i, 3.0 - i / 100 if i < 15 else 1.0) for i in range(200)]
    own = spark.createDataFrame(data, "policy string, row_id int, w double")
    assert {r["policy"]: r["ratio"] for r in diagnostics.tail_ratio(own).collect()} | {"step": 0} == {"zero": math.inf, "flat": 1.0, "step": 0}
    got = {r["policy"]: r for r in diagnostics.hill_stability(own).collect()}
    assert got["flat"]["median"] is None and got["step"]["spread"] is not None and np.isfinite(got["step"]["most"])


def test_reasons_of_boundaries():
    assert boundary(["ab", "c"], "ab \n") == (None, "whitespace_normalization") and boundary(["a\nb", "c"], "a\r\nb") == (None, "crlf_normalization")
    assert boundary(["\ud800", "x"], "\ud800") == (1, "exact_match") and boundary(["ab"], "abc") == (None, "echo_mismatch")


def test_weights_of_far_log_ratios(spark):
    lr = [-900.5, -900.2, 3.25, 700.1, None, 699.0]
    got = [r["w"] for r in weights.hajek(spark.createDataFrame([("p", i, v) for i, v in enumerate(lr)], "policy string, row_id int, log_ratio double")).orderBy("row_id").collect()]
    e = np.array([0 if v is None else math.exp(v - 700.1) for v in lr])
    assert np.allclose(got, e / e.mean())


def test_stacking_is_the_best_mixture(spark, rows):
    parts = {n: analysis.ROBUST[n](rows) for n in ("dr-cpo", "mrdr", "tmle")}
    got = {(r["policy"], r["row_id"]): r["c"] for r in estimators.stacked(parts).collect()}
    held = {n: p.toPandas().set_index(["policy", "row_id"]).sort_index() for n, p in parts.items()}
    for p in ("policy_a", "policy_b"):
        phi = np.stack([held[n].loc[p]["phi"] for n in sorted(parts)])
        alpha = simplex_weights(np.cov(phi) + 1e-4 * np.eye(3)) if np.linalg.cond(np.cov(phi) + 1e-4 * np.eye(3)) < 1e8 else np.full(3, 1 / 3)
        c = sum(a * held[n].loc[p]["c"] for a, n in zip(alpha, sorted(parts), strict=True))
        assert np.allclose([got[p, i] for i in c.index], c)


def test_block_bootstraps_are_near_the_error_of_the_mean(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(2, 1, 900)
    own = spark.createDataFrame([("p", i, float(x)) for i, x in enumerate(v)], "policy string, row_id int, c double").repartition(3)
    for stationary in (False, True):
        r = inference.block_bootstrap(own, stationary=stationary, replicates=400).first()
        assert math.isclose(r["estimate"], v.mean()) and 0.7 < r["se"] / (v.std() / 30) < 1.3 and r["lo"] < v.mean() < r["hi"] and r["block"] >= 9
    one = inference.block_bootstrap(own, block=900, replicates=5).first()
    assert one["se"] < 1e-12 and math.isclose(one["lo"], v.mean())  # a block of all rows is the sample itself


def test_exact_signed_ranks():
    for n in (6, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in (0, 3, n * (n + 1) // 4):
            low = min(w, n * (n + 1) / 2 - w)
            assert math.isclose(reporting.signed_rank_p(n, w), min(1.0, 2 * sum(s <= low for s in sums) / 2**n))


def test_ridge_is_the_normal_equations(spark):
    rng = np.random.default_rng(4)
    data = [(i, i % 5, " ".join(["w"] * int(rng.integers(1, 6))), " ".join(["v"] * int(rng.integers(0, 9))), float(rng.random()), float(rng.random())) for i in range(120)]
    own = spark.createDataFrame(data, "row_id int, fold int, prompt string, response string, s double, y double")
    x = outcomes.features(F.col("prompt"), F.col("response"), F.col("s"))
    got = outcomes.ridge(own, "y", x)
    a = np.array([[len(d[2].split()), len(d[3].split()), d[4], 1.0] for d in data])
    y, fold = np.array([d[5] for d in data]), np.array([d[1] for d in data])
    for f in range(5):
        m = fold != f
        assert np.allclose(got[f], np.linalg.solve(a[m].T @ a[m] + np.eye(4), a[m].T @ y[m]))
    out = {r["row_id"]: r["g"] for r in outcomes.ridge_predict(own, got, x).collect()}
    assert all(math.isclose(out[i], min(1, max(0, a[i] @ got[fold[i]]))) for i in range(120))


def test_assembly_needs_a_base_and_a_target(spark):
    passes = spark.createDataFrame([("base", 1, -1.0), ("base", 1, -3.0), ("a", 1, -2.0), ("a", 1, 0.5), ("b", 1, None), ("base", 2, -1.0), ("b", 2, None), ("a", 3, -1.0)], "policy string, prompt_id int, logprob double")
    got = assembly.assemble(passes, "base").collect()
    assert [(r["prompt_id"], r["base_lp"], r["target_lps"]) for r in got] == [(1, -2.0, {"a": -2.0})]


def test_analysis_refuses_what_it_cannot_do(spark):
    logged = bridge.logged(spark, SF)
    with pytest.raises(ValueError, match="unknown"):
        analysis.analyze_tables(logged, estimator="other")
    with pytest.raises(ValueError, match="fresh"):
        analysis.analyze_tables(logged, estimator="tmle")
    got = {r["policy"]: r for r in analysis.analyze_tables(logged.withColumn("reward", F.lit(0.5)), estimator="raw-ips").collect()}
    assert all(math.isclose(r["estimate"], 0.5) and r["oracle_var"] == 0 for r in got.values())


def test_tables_mark_the_best(spark):
    own = spark.createDataFrame([("a", 0.25), ("b", 0.5), ("c", 0.75)], "name string, mae double")
    text = reporting.markdown(own, ["name", "mae"], {"mae": "min"}, 2)
    assert "| a | **0.25** |" in text and "| b | <u>0.50</u> |" in text and "| c | 0.75 |" in text


def test_kendall_drift_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [("long", float(x), float(y)) for x, y in zip(rng.normal(size=400).round(2), rng.integers(0, 90, 400), strict=True)]
    rows += [("near", float(i // 2), float(i // 2 + (i % 7 == 0))) for i in range(60)]
    rows += [("flat", 1.0, float(i)) for i in range(5)] + [("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 1.0)]
    extra = [(None, 1.0, 1.0), ("near", None, 1.0), ("near", 1.0, None)]
    found = {r["k"]: r for r in diagnostics.kendall_drift(spark.createDataFrame(rows + extra, "k string, x double, y double"), "k", "x", "y").collect()}
    assert set(found) == {"long", "near", "flat", "one", "two"}
    for key, r in found.items():
        x, y = (np.array([v[i] for v in rows if v[0] == key]) for i in (1, 2))
        dx, dy = (np.sign(v[:, None] - v[None, :]) for v in (x, y))
        s, sx, sy, n = (dx * dy).sum() / 2, np.abs(dx).sum(), np.abs(dy).sum(), len(x)
        assert r["n"] == n
        if not sx or not sy:
            assert r["tau"] is None and r["p_value"] is None and not r["drift"] and r["level"] == "unknown"
            continue
        tau = 2 * s / math.sqrt(sx * sy)
        tx, ty = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
        of = lambda f: (f(tx).sum(), f(ty).sum())
        pairs, triples, spans = of(lambda t: t * (t - 1)), of(lambda t: t * (t - 1) * (t - 2)), of(lambda t: t * (t - 1) * (2 * t + 5))
        m = n * (n - 1)
        var = (m * (2 * n + 5) - sum(spans)) / 18 + pairs[0] * pairs[1] / (2 * m) + (triples[0] * triples[1] / (9 * m * (n - 2)) if n > 2 else 0)
        p = math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2))
        assert r["tau"] == pytest.approx(tau) and r["p_value"] == pytest.approx(p, abs=1e-12)
        assert r["drift"] == (p < 0.05 and tau < 0.8)
    assert found["near"]["level"] in ("excellent", "good")


def test_running_sums_go_on_over_ranges(spark):
    rows = [(k, i, i % 5) for k, n in (("a", 300), (None, 200), ("b", 1)) for i in range(n)] + [(f"s{i}", 0, i) for i in range(50)]
    found = running(spark.createDataFrame(rows, "k string, at long, v long").repartition(7), ["k"], "at", {"upto": "v"}).collect()
    assert {(r["k"], r["at"]): r["upto"] for r in found} == {(k, i): sum(w for l, j, w in rows if l == k and j <= i) for k, i, _ in rows}
