"""Calibration modes, projections, honest residuals and result scans against rules restated in plain numpy."""

import json

import numpy as np
import pandas as pd
import pytest

from kalibra.operators import calibration, diagnostics, estimators, reporting, splines, tables
from kalibra.operators.isotonic import pool
from kalibra.sources import results


def _isotonic(x, y):
    """The rising fit of y on x as (levels, values)."""
    u, at, c = np.unique(x, return_inverse=True, return_counts=True)
    mean = np.bincount(at, y) / c
    starts = pool(mean, c.astype(float))
    value = np.add.reduceat(mean * c, starts) / np.add.reduceat(c, starts)
    return u, np.repeat(value, np.diff(np.append(starts, len(u))))


def _smoother(x, y, most=8):
    """Penalised splines on rows; the penalty of least leave-one-out error, each left out in turn by the closed form for rows."""
    low, high, n = x.min(), x.max(), min(most, max(4, len(x) // 4))
    b = np.column_stack([np.ones(len(x)), splines.basis(x, low, high, n)])
    best = None
    for a in np.logspace(-3, 3, 13):
        d = a * np.diag([0.0, *np.ones(b.shape[1] - 1)])
        inverse = np.linalg.pinv(b.T @ b + d)
        w = inverse @ b.T @ y
        h = np.diag(b @ inverse @ b.T)
        loo = (((y - b @ w) / np.maximum(1 - h, 1e-12)) ** 2).sum()
        if best is None or loo < best[0]:
            best = (loo, w)
    return lambda z: np.round(np.column_stack([np.ones(len(z)), splines.basis(z, low, high, n)]) @ best[1], 12)


def _two_stage(x, y, z):
    g = _smoother(x, y)
    known = np.sort(g(x))
    rank = lambda v: (np.searchsorted(known, v, side="right") - 0.5) / len(known)
    u, value = _isotonic(rank(g(x)), y)
    return np.clip(np.interp(rank(g(z)), u, value), 0, 1)


def _made(shape, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 1, n), 2)
    y = np.clip(shape(x) + rng.normal(0, 0.1, n), 0, 1)
    return pd.DataFrame({"row_id": range(n), "fold": rng.integers(0, 5, n).astype("int32"), "judge_score": x, "oracle_label": np.where(rng.uniform(size=n) < 0.6, y, np.nan)})


def _rows(spark, pdf):
    held = pdf.astype(object).where(pdf.notna(), None)
    return spark.createDataFrame(held.values.tolist(), "row_id int, fold int, judge_score double, oracle_label double")


@pytest.mark.parametrize(("shape", "mode"), [(lambda x: 4 * (x - 0.5) ** 2, "two_stage"), (lambda x: np.where(x < 0.5, 0.2, 0.8), "monotone")])
def test_modes_and_rewards(spark, shape, mode):
    pdf = _made(shape)
    rows = _rows(spark, pdf)
    won, two = calibration.fit(rows, "auto"), calibration.fit(rows, "two_stage")
    got = calibration.apply(rows, two).toPandas().sort_values("row_id")
    lab = pdf[pdf.oracle_label.notna()]
    x, y, f = lab.judge_score.to_numpy(), lab.oracle_label.to_numpy(), lab.fold.to_numpy()
    assert np.allclose(got["reward"].astype(float), _two_stage(x, y, pdf.judge_score.to_numpy()), atol=1e-9)
    p1, p2 = np.zeros(len(x)), np.zeros(len(x))
    for k in range(5):
        own = got.fold == k
        assert np.allclose(got[own]["reward_oof"].astype(float), _two_stage(x[f != k], y[f != k], got[own].judge_score.to_numpy()), atol=1e-9)
        p2[f == k] = _two_stage(x[f != k], y[f != k], x[f == k])
        p1[f == k] = np.clip(np.interp(x[f == k], *_isotonic(x[f != k], y[f != k])), 0, 1)
    rmse = lambda p: np.sqrt(((y - p) ** 2).mean())
    assert np.isclose(won.choice["rmse_monotone"], rmse(p1)) and np.isclose(won.choice["rmse_two_stage"], rmse(p2))
    assert np.isclose(won.choice["se"], np.std((y - p1) ** 2, ddof=1) / np.sqrt(len(y)) / (2 * rmse(p1))) and 0 <= won.choice["better_thirds"] <= 3
    assert won.mode == ("two_stage" if rmse(p2) < rmse(p1) - won.choice["se"] or won.choice["better_thirds"] >= 2 else "monotone")
    assert mode != "two_stage" or won.mode == mode
    g = calibration.ranks(rows, rows, two).toPandas()
    at = calibration.index(rows.where("oracle_label is not null"), two).toPandas()["index"].astype(float).sort_values().to_numpy()
    assert np.allclose(g["rank"].astype(float), (np.searchsorted(at, g["index"].astype(float), side="right") - 0.5) / len(at))


def test_few_labels_rank_the_scores(spark):
    rows = spark.createDataFrame([(i, i % 5, i / 10, float(i % 3) / 2) for i in range(10)] + [(99, 0, None, None)], "row_id int, fold int, judge_score double, oracle_label double")
    got = calibration.apply(rows, calibration.fit(rows, "two_stage")).toPandas().set_index("row_id")
    u, v = _isotonic(np.arange(10) / 10, np.arange(10) % 3 / 2)
    assert np.allclose(got.loc[range(10), "reward"].astype(float), v) and pd.isna(got.loc[99, "reward"])
    with pytest.raises(ValueError):
        calibration.fit(rows, "other")


def test_running_sums_of_any_split(spark):
    rows = spark.range(1000).selectExpr("id % 3 as k", "id * 7919 % 1000 as x", "id % 11 as v").repartition(5)
    got = tables.running(rows, ["k"], "x", {"s": "v"}).toPandas().sort_values(["k", "x"])
    assert (got.groupby("k")["v"].cumsum() == got["s"]).all() and len(got) == 1000


def test_weights_to_a_mean(spark):
    rng = np.random.default_rng(5)
    s, w = np.round(rng.uniform(size=300), 1), rng.lognormal(0, 1, 300)
    data = [("a", i, float(s[i]), float(w[i])) for i in range(300)] + [("zero", i, 0.1 * i, 0.0) for i in range(5)] + [("flat", i, 0.1 * i, 3.0) for i in range(5)] + [("minus", 0, 0.1, -1.0), ("minus", 1, 0.2, 2.0)]
    rows = spark.createDataFrame(data, "policy string, row_id int, s double, w double")
    out, blend = estimators.to_mean(rows, "s", 2.0, 0.3)
    got = {p: g.sort_values("row_id")["w_to"].to_numpy(float) for p, g in out.toPandas().groupby("policy")}
    raw = w / w.mean()
    u, v = _isotonic(s, raw)
    cal = v[np.searchsorted(u, s)]
    info = {r["policy"]: r for r in blend.collect()}["a"]
    grid = np.linspace(0, 1, 20001)
    var = [np.var((1 - a) * raw + a * cal) for a in grid]
    fine = [a for a, x in zip(grid, var, strict=True) if x <= 0.3 * raw.var()]
    want = 1.0 if cal.var() <= 0.3 * raw.var() * 1.001 else max(fine) if fine else grid[int(np.argmin(var))]
    assert abs(info["alpha"] - want) < 1e-3 and np.allclose(got["a"], 2 * ((1 - info["alpha"]) * raw + info["alpha"] * cal))
    assert np.allclose(got["zero"], 2) and np.allclose(got["flat"], 2) and np.allclose(got["minus"].mean(), 2) and (got["minus"] >= 0).all()


def test_blend_where_no_share_can_be_had(spark):
    rng = np.random.default_rng(2)
    raw = rng.lognormal(0, 1, 200)
    raw, cal = raw / raw.mean(), np.sort(raw) / raw.mean()
    rows = spark.createDataFrame([("a", float(r), float(c)) for r, c in zip(raw, cal, strict=True)] + [("same", float(r), float(r)) for r in raw], "policy string, w double, w_cal double")
    got = {r["policy"]: r for r in estimators.safe_blend(rows, 0.01).collect()}
    least = min(np.linspace(0, 1, 10001), key=lambda a: np.var((1 - a) * raw + a * cal))
    assert abs(got["a"]["alpha"] - least) < 1e-3 and not got["a"]["feasible"] and got["same"]["alpha"] == 0


def test_experiments_from_lines(spark, tmp_path):
    spec = {"seed_base": 3, "sample_size": 250, "oracle_coverage": 0.25, "estimator": "dr-cpo", "extra": {"use_weight_calibration": True}}
    lines = [
        {"run_id": "r1", "success": True, "spec": spec, "estimates": {"a": 0.5, "b": float("nan")}, "oracle_truths": {"a": 0.5}, "standard_errors": {"a": 0.1}, "confidence_intervals": {"a": [0.7, 0.3], "b": [None, None]}, "ess_relative": {"a": 0.05}, "diagnostics": {"a": {"orthogonality_ci": [0.1, 0.2], "cap_activity_rate": 0.6}}},
        {"run_id": "r2", "success": False, "estimates": {"a": 1.0}}, {"success": True, "spec": {"estimator": "mrdr"}, "estimates": {"a": 0.25}, "n_oracle": 100, "oracle_truths": {"a": 0.5}},
    ]
    (tmp_path / "runs.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    got = {(r["run_id"], r["policy"]): r for r in results.read_experiments(spark, str(tmp_path / "runs.jsonl")).collect()}
    assert len(got) == 3
    a, b = got["r1", "a"], got["r1", "b"]
    assert (a["lo"], a["hi"], a["estimator"], a["se_robust"], a["n_oracle"]) == (0.3, 0.7, "calibrated-dr-cpo", 0.1, 4989) and abs(a["oracle_var"] - 0.25 / 4989) < 1e-12
    assert not a["gate_overlap"] and a["gate_judge"] and not a["gate_dr"] and not a["gate_cap"] and not a["refused"] and b["refused"] and b["gate_dr"]
    other = next(r for k, r in got.items() if k[0].startswith("run_"))
    assert other["oracle_var"] == 0.0025 and not other["toggle"] and other["rho"] == 1.0


def test_analyses_from_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    record = {"timestamp": "t", "method": "m", "per_policy_results": {"a": {"estimate": 0.5, "n_samples": 7}}, "metadata": {"calibration_info": {"f_min": 0.1}, "calibration_floor": {"a": {"floor_mass_fresh": 0.25}}, "oua": {"var_oracle_per_policy": {"a": 0.01}}}, "diagnostics": {"hellinger_affinity": 0.75, "ess_per_policy": {"a": 0.5}}}
    (tmp_path / "deep" / "one.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "other.txt").write_text("{}")
    rows = results.read_analyses(spark, str(tmp_path))
    r = rows.collect()
    assert len(r) == 1 and (r[0]["policy"], r[0]["estimate"], r[0]["n_samples"], r[0]["f_min"], r[0]["floor_mass_fresh"], r[0]["var_oracle"], r[0]["hellinger_affinity"], r[0]["ess_fraction"]) == ("a", 0.5, 7, 0.1, 0.25, 0.01, 0.75, 0.5)
    results.write_aggregate(rows, str(tmp_path / "csv"))
    back = results.read_csv(spark, str(tmp_path / "csv"), ("estimate", "ci_lower", "no_such")).first()
    assert back["estimate"] == 0.5 and np.isnan(back["ci_lower"]) and np.isnan(back["no_such"]) and back["n_samples"] == "7"


def test_fresh_draws_are_found_in_order(spark, tmp_path):
    (tmp_path / "fresh_draws").mkdir()
    (tmp_path / "p_fresh.jsonl").write_text('{"prompt_id": "x"}\n')
    (tmp_path / "fresh_draws" / "p.jsonl").write_text('{"prompt_id": "x", "metadata": {"judge_score": 0.5}}\n')
    assert [(r["policy"], r["judge_score"], r["draw_idx"]) for r in results.find_fresh(spark, str(tmp_path), "p").collect()] == [("p", 0.5, 0)]
    with pytest.raises(FileNotFoundError):
        results.find_fresh(spark, str(tmp_path), "q")


def test_progress_and_text(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("bb", None)], "k string, v double")
    for _ in range(2):
        results.append_progress(rows, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 4
    assert reporting.text_table(rows.orderBy("k"), ["k", "v"], 2) == "k      v\n--------\na   1.00\nbb"


def test_records_name_what_contradicts(spark):
    card = spark.createDataFrame([("a", 10, 0.5, 3.0, "good"), ("b", 10, 1.5, 3.0, "good"), ("c", 10, 0.5, 1.5, "warning")], "policy string, n long, ess_fraction double, alpha double, status string")
    est = spark.createDataFrame([("a", 0.5, 0.1), ("b", 1.5, -0.1), ("d", 0.5, 0.1)], "policy string, estimate double, se double")
    got = {r["policy"]: r for r in diagnostics.records(card, est).collect()}
    assert got["a"]["status"] == "good" and len(got["b"]["issues"]) == 3 and got["c"]["issues"] == ["no estimate"] and got["d"]["issues"] == ["no weights"]
