"""Outcome models, saved calibrators, jackknives and modes of the analysis against rules restated in plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kalibra.operators import analysis, calibration, estimators, isotonic, jackknife, outcomes, store
from kalibra.operators.tables import scratch, written
from kalibra.plans import bridge, model_queries, queries

SF = "/root/testdata/sf0.001"


def _logged(n=300, labels=0.4, seed=4, shape=lambda s: 0.2 + 0.6 * s):
    rng = np.random.default_rng(seed)
    score = np.round(rng.uniform(0, 1, n), 2)
    label = np.clip(shape(score) + rng.normal(0, 0.1, n), 0, 1)
    return pd.DataFrame({"policy": np.where(np.arange(n) % 2, "a", "b"), "row_id": range(n), "prompt_id": [f"p{i}" for i in range(n)], "fold": rng.integers(0, 5, n), "judge_score": score, "oracle_label": np.where(rng.uniform(size=n) < labels, label, np.nan), "reward": np.clip(score**2 + rng.normal(0, 0.05, n), 0, 1), "length": rng.integers(1, 9, n).astype(float)})


def _frame(spark, pdf, schema="policy string, row_id int, prompt_id string, fold int, judge_score double, oracle_label double, reward double, length double"):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), schema)


def test_a_callers_model_is_cross_fitted(spark):
    pdf = _logged()
    pdf.loc[3, "length"] = np.nan
    model = outcomes.SumsModel([F.col("length")], lambda x, y: np.array([len(y), y.sum()]), lambda s: s[1:] / s[0], lambda m, x: np.full(len(x), m[0]), None, None)
    rows = _frame(spark, pdf)
    got = {r["row_id"]: r["g"] for r in outcomes.fit(rows, model).predict(rows).collect()}
    known = pdf[pdf["length"].notna()]
    for r in pdf.itertuples():
        if r.row_id == 3:
            assert got[3] is None
        else:
            assert np.isclose(got[r.row_id], known[(known.policy == r.policy) & (known.fold != r.fold)].reward.mean())


@pytest.mark.parametrize("model", ["isotonic", "linear"])
def test_outcome_models_know_their_folds(spark, model):
    model = outcomes.Isotonic() if model == "isotonic" else outcomes.linear([F.lit(1.0), F.col("judge_score")], 0.0)
    pdf = _logged()
    pdf["fold"] = pdf["fold"] * 7 + 3  # numbers need not be 0, 1, ...
    rows = _frame(spark, pdf)
    fitted = outcomes.fit(rows, model)
    got = {r["row_id"]: r["g"] for r in fitted.predict(rows).collect()}
    for (policy, fold), own in pdf.groupby(["policy", "fold"]):
        rest = pdf[(pdf.policy == policy) & (pdf.fold != fold)]
        if isinstance(model, outcomes.Isotonic):
            mean = rest.groupby("judge_score").reward.agg(["mean", "count"])
            starts = isotonic.pool(mean["mean"].to_numpy(), mean["count"].to_numpy(float))
            value = np.add.reduceat((mean["mean"] * mean["count"]).to_numpy(), starts) / np.add.reduceat(mean["count"].to_numpy(), starts)
            want = np.interp(own.judge_score, mean.index, np.repeat(value, np.diff(np.append(starts, len(mean)))))
        else:
            slope, level = np.polyfit(rest.judge_score, rest.reward, 1)
            want = np.clip(level + slope * own.judge_score, 0, 1)
        assert np.allclose([got[i] for i in own.row_id], want)
    for other in (rows.withColumn("fold", F.lit(4)), rows.withColumn("policy", F.lit("c")), rows.withColumn("fold", F.lit(None).cast("int"))):
        with pytest.raises(PySparkException, match="no outcome model"):
            fitted.predict(other).collect()
    with pytest.raises(ValueError, match="no training data"):
        outcomes.fit(rows.withColumn("fold", F.lit(1)), model)
    with pytest.raises(ValueError, match="without a policy or a fold"):
        outcomes.fit(rows.withColumn("fold", F.when(F.col("row_id") > 5, F.col("fold"))), model)


def test_isotonic_outcome_on_a_calibrations_index(spark):
    pdf = _logged(shape=lambda s: 4 * (s - 0.5) ** 2)
    pdf["reward"] = 4 * (pdf["judge_score"] - 0.5) ** 2
    rows = _frame(spark, pdf)
    index = calibration.fit(rows, "two_stage")
    plain, bent = (outcomes.fit(rows, m).predict(rows).select(F.avg(F.pow(F.col("g") - F.col("reward"), 2))).first()[0] for m in (outcomes.Isotonic(), outcomes.Isotonic(index)))
    assert bent < plain / 5


@pytest.mark.parametrize("mode", ["monotone", "two_stage"])
def test_a_saved_calibrator_gives_the_same_rewards(spark, monkeypatch, mode):
    pdf = _logged(shape=lambda s: 4 * (s - 0.5) ** 2)
    pdf.loc[7, "judge_score"] = np.nan
    rows, path = _frame(spark, pdf).drop("reward"), scratch(spark, "calibrator")
    fitted = calibration.fit(rows, mode)
    store.save(spark, fitted, path)
    want = {r["row_id"]: (r["reward"], r["reward_oof"]) for r in calibration.apply(rows, fitted).collect()}
    other = spark.newSession()
    rows = other.createDataFrame(rows.collect(), rows.schema)
    for most in (store.MOST_BLOCKS, 3):
        monkeypatch.setattr(store, "MOST_BLOCKS", most)
        out = store.apply(store.apply(rows, path), path, "fold", name="reward_oof")
        assert out.columns == [*rows.columns, "reward", "reward_oof"]
        got = {r["row_id"]: (r["reward"], r["reward_oof"]) for r in out.collect()}
        assert got[7] == (None, None) and len(got) == len(want)
        assert all(np.allclose(got[i], want[i], atol=1e-12) for i in got if i != 7)
    with pytest.raises(ValueError, match="over 3 blocks"):
        store.load(other, path)
    with pytest.raises(PySparkException, match="no fold 9"):
        store.apply(rows.withColumn("fold", F.lit(9)), path, "fold").collect()
    with pytest.raises(PySparkException):
        store.save(spark, fitted, path)


def test_a_saved_calibrator_loads_as_it_was(spark):
    rows, path = _frame(spark, _logged(shape=lambda s: 4 * (s - 0.5) ** 2)), scratch(spark, "calibrator")
    fitted = calibration.fit(rows, "auto")
    store.save(spark, fitted, path)
    got = store.load(spark, path)
    assert (got.mode, got.choice, set(got.models), set(got.smoothers)) == (fitted.mode, fitted.choice, set(fitted.models), set(fitted.smoothers))
    assert all(np.array_equal(got.models[k][i], fitted.models[k][i]) for k in got.models for i in (0, 1))
    other = scratch(spark, "calibrator")
    spark.createDataFrame([(99, "monotone", [0], {"a": 1.0})], store.ABOUT).write.parquet(f"{other}/about")
    with pytest.raises(ValueError, match="not a calibration model"):
        store.load(spark, other)


@pytest.mark.parametrize("parts", [1, 7])
def test_predictions_by_levels_are_those_at_the_driver(spark, parts):
    rng = np.random.default_rng(parts)
    train = spark.createDataFrame([(str(k), float(x), float(y)) for k in range(3) for x, y in zip(rng.uniform(0, 1, 80), rng.uniform(0, 1, 80))] + [("one", 0.5, 0.7)], "k string, x double, y double")
    blocks = isotonic.fit(train, ["k"], "x", "y")
    ask = spark.createDataFrame([(k, float(x)) for k in ("0", "1", "2", "one", "none") for x in (-1.0, 0.5, 2.0, *rng.uniform(0, 1, 40))] + [("0", None), (None, 0.5)], "k string, x double").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = isotonic.predict_levels(ask, blocks, ["k"], "x", "f", 0.1, 0.9).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {(r["k"], r["x"]): r["f"] for r in isotonic.predict(ask, isotonic.knots(blocks, ["k"]), ["k"], "x", "f", 0.1, 0.9).collect()}
    assert len(got) == ask.count() and {(r["k"], r["x"]) for r in got} == set(want)
    for r in got:
        v = want[r["k"], r["x"]]
        assert (r["f"] is None) == (v is None) and (v is None or np.isclose(r["f"], v))


def test_folds_with_little_to_learn_from_take_the_mean(spark):
    pdf = _logged(120)
    pdf.loc[5, "judge_score"] = np.nan
    rows = _frame(spark, pdf)
    got = {r["row_id"]: r["v"] for r in estimators.cross_fitted(rows, F.col("reward"), "v", 0.0, None).collect()}
    known = pdf[pdf.judge_score.notna()]
    for r in pdf.itertuples():
        own = known[known.policy == r.policy]
        assert np.isclose(got[r.row_id], own.reward.mean() if r.row_id == 5 else own[own.fold != r.fold].reward.mean())
    few = rows.withColumn("judge_score", F.round("judge_score", 0))
    assert len({round(r["v"], 9) for r in estimators.cross_fitted(few, F.col("reward"), "v", 0.0, None, least_rows=10, least_scores=3).collect()}) <= 11


def test_jackknife_is_the_estimate_with_each_fold_model(spark):
    m = queries.models(spark, SF)
    rows, fresh = queries.outcomes(spark, SF, m), bridge.fresh(spark, SF)
    found = {(r["estimator"], r["policy"], r["k"]): r["psi"] for r in jackknife.paths(rows, fresh, m, ["orthogonalized-ips", "dr-cpo", "tr-cpo-e"]).collect()}
    full = estimators.label_chance(estimators.mean_weight(rows)).toPandas()
    drawn, k = fresh.toPandas(), 2
    at = lambda s: np.clip(np.interp(s, *m[1][(k,)]), 0, 1)
    for policy, own in full.groupby("policy"):
        r, q = at(own.judge_score), drawn[drawn.policy == policy].assign(v=lambda d: at(d.judge_score)).groupby("prompt_id").v.mean()
        label = np.where(own.oracle_label.notna(), own.m / own.pi * (own.oracle_label.fillna(0) - r), 0)
        assert np.isclose(found["orthogonalized-ips", policy, k], (own.w_cal * own.reward + (own.w - own.m) * (own.reward - r) + r * (own.w - own.w_cal)).mean())
        assert np.isclose(found["dr-cpo", policy, k], q[own.prompt_id.unique()].mean() + (own.w_cal * (r - own.g)).mean())
        assert np.isclose(found["tr-cpo-e", policy, k], q[own.prompt_id].mean() + (own.w * (r - own.g) + label).mean())
    with pytest.raises(ValueError, match="no jackknife"):
        jackknife.paths(rows, fresh, m, ["other"])


def test_draws_move_no_weights_but_count_in_the_covariance(spark):
    rows = written(queries.outcomes(spark, SF), "t")
    parts = {"a": estimators.dr_cpo(rows), "b": estimators.dr_cpo(rows, "w")}
    drawn = spark.createDataFrame([("policy_a", 0.01), ("policy_b", 0.0)], "policy string, mc_var double")
    _, plain = estimators.stacking(parts)
    _, with_draws = estimators.stacking(parts, draw_var=drawn)
    for p in plain:
        assert np.isclose(sum(plain[p].values()), 1) and all(np.isclose(plain[p][k], with_draws[p][k], atol=1e-6) for k in plain[p])


def test_the_analysis_picks_the_mode_and_takes_labels_where_all_have_them(spark):
    pdf = _logged(400, shape=lambda s: 4 * (s - 0.5) ** 2)
    logged = _frame(spark, pdf).drop("reward", "fold", "policy")
    rows, models = analysis.prepared_rewards(logged)
    assert models.mode == "two_stage"
    want = {r["row_id"]: r["reward"] for r in calibration.apply(logged.withColumn("fold", estimators.fold_of(F.col("prompt_id"))), models).collect()}
    assert all(np.isclose(r["reward"], want[r["row_id"]]) for r in rows.collect())
    assert analysis.prepared_rewards(logged, "monotone")[1].mode == "monotone"
    every = logged.withColumn("oracle_label", F.col("judge_score") * 0.5)
    rows, models = analysis.prepared_rewards(every)
    assert models is not None and rows.where("abs(reward - oracle_label) > 1e-12").count() == 0
    assert rows.where("abs(reward_oof - oracle_label) > 1e-12").count() > 0


def test_given_rewards_and_refusals(spark):
    pdf = _logged(300)
    rng = np.random.default_rng(9)
    pdf["base_lp"] = -10.0
    logged = _frame(spark, pdf.drop(columns=["base_lp"])).withColumn("base_lp", F.lit(-10.0))
    near = {int(i): float(-10 + rng.normal(0, 0.2)) for i in pdf.row_id}
    lps = spark.createDataFrame(list(near.items()), "row_id int, near double")
    logged = logged.join(lps, "row_id").withColumn("target_lps", F.create_map(F.lit("near"), F.col("near"), F.lit("far"), F.when(F.col("row_id") == 3, -1.0).otherwise(-200.0))).drop("policy", "fold", "near")
    fresh = logged.select("prompt_id", F.explode(F.array(F.lit("near"), F.lit("far"))).alias("policy"), F.lit(0).alias("draw_idx"), "judge_score")
    out = {r["policy"]: r for r in analysis.analyze_tables(logged, fresh, "dr-cpo", refuse=True).collect()}
    assert out["far"]["refused"] and out["far"]["estimate"] is None and out["far"]["lo"] is None
    assert not out["near"]["refused"] and abs(out["near"]["estimate"] - pdf.reward.mean()) < 0.05 and out["near"]["oracle_var"] == 0
    less = analysis.analyze_tables(logged, fresh, "dr-cpo", ["near"], residualise="spline").first()
    assert np.isclose(less["estimate"], out["near"]["estimate"]) and less["se_naive"] < out["near"]["se_naive"]
    linear = analysis.analyze_tables(logged, fresh, "dr-cpo", ["near"], outcome=outcomes.linear([F.col("judge_score"), F.lit(1.0)])).first()
    assert abs(linear["estimate"] - pdf.reward.mean()) < 0.05


def test_the_registry_is_all_compared():
    assert set(model_queries.OWN) | {"stacked-dr"} == set(analysis.REGISTRY)
