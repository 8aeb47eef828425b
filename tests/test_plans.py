"""Queries against their SQL twins on the smallest tables, and operators on made rows."""

import glob
import json
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kalibra.functions.chat import suffix_logprobs
from kalibra.operators import estimators, isotonic, weights
from kalibra.plans import bridge, further_queries, inference_queries, log_queries, more_queries, queries, report_queries  # noqa: F401
from kalibra.sources import jsonl

SF = "/root/testdata/sf0.001"
SOME = ["f7_fresh_coverage", "f14_first_user_turn", "is1_isotonic_falling", "c2_cross_fitted_rewards", "e2_calibrated_ips", "e6_tmle", "e8_tr_cpo", "d4_hill_tail_index", "d9_overlap_card", "d18_dr_with_intervals", "d24_paired_policies", "d30_boundary_card", "a6_ranking", "a17_wilcoxon", "t1_chat_completions", "j5_assembled_dataset", "w8_variance_safe_blend", "w9_weights_to_a_mean", "e2b_honest_ips", "e8a_orthogonalised_tr", "d27_stability", "v2_mass_points", "a23_accuracy_by_regime", "sc11_experiment_results", "sc12_analysis_results", "sc9_pass_table", "sc10_still_due", "f5_log_validation", "f13_moderation_flags"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _rows(df: pd.DataFrame) -> list:
    flat = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) else str(v)
    return sorted((tuple(flat(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", SOME)
def test_twins_agree(spark, duck, name):
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(queries.ORACLE_SQL[name]).df())


def test_every_twin_belongs_to_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_raw_weights_stay_finite(spark):
    rows = spark.createDataFrame([(1, 800.0), (2, None), (3, -5000.0)], "row_id int, log_ratio double")
    got = [r["w"] for r in rows.select("row_id", weights.raw(F.col("log_ratio")).alias("w")).orderBy("row_id").collect()]
    assert np.isfinite(got).all() and got[0] > 1e308 and got[1] == 0 and got[2] == 0


def test_prediction_is_flat_outside_and_null_for_nulls(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 0.0), ("a", 4.0, 3.0), ("b", 0.0, 5.0)], "k string, x double, y double")
    m = isotonic.knots(isotonic.fit(rows, ["k"], "x", "y"), ["k"])
    ask = spark.createDataFrame([("a", 0.0), ("a", 3.0), ("a", 9.0), ("a", None), ("b", 7.0), ("c", 1.0)], "k string, x double")
    got = [r["f"] for r in isotonic.predict(ask, m, ["k"], "x", "f").collect()]
    assert got == [0.5, 1.75, 3.0, None, 5.0, None]


def test_stabilised_weights_are_positive_of_mean_one_and_less_spread(spark):
    got = estimators.stabilised(queries.scored(spark, SF)).select("policy", "w", "w_cal").toPandas()
    for _, g in got.groupby("policy"):
        assert abs(g["w_cal"].mean() - 1) < 1e-9 and g["w_cal"].min() > 0 and g["w_cal"].var() <= g["w"].var() * 1.001


def test_fluctuation_solves_its_score(spark):
    out = estimators.cluster_robust(estimators.tmle(queries.outcomes(spark, SF))).toPandas()
    assert out["estimate"].between(0, 1).all() and (out["se_cluster"] > 0).all()


def test_json_lines(spark, tmp_path):
    lines = [
        {"prompt_id": "", "prompt": "q", "response": "r", "reward": {"mean": 0.5}, "base_policy_logprob": -1.0, "target_policy_logprobs": {"b": -2.0, "a": None}, "metadata": {"judge_score": 7}},
        {"prompt_id": "x", "prompt": "q", "response": "r", "reward": 1.5, "base_policy_logprob": -1.0, "target_policy_logprobs": {"a": -1}},
        {"prompt_id": "y", "prompt": "q", "response": "r", "base_policy_logprob": 0.5, "target_policy_logprobs": {}},
        {"prompt_id": "z", "prompt": "q", "response": "r", "judge_score": {"value": 0.25}, "base_policy_logprob": None, "target_policy_logprobs": {"c": 0.0}},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    rows, rejected = jsonl.read_logged(spark, str(tmp_path / "log.jsonl"))
    got = {r["prompt_id"]: r for r in rows.collect()}
    assert len(got) == 2 and got["z"]["judge_score"] == 0.25 and rejected.count() == 2
    first = next(r for k, r in got.items() if k.startswith("prompt_"))
    assert first["reward"] == 0.5 and first["judge_score"] == 7.0 and jsonl.policies_of(rows) == ["a", "b", "c"]
    draws = [{"prompt_id": "x", "target_policy": "a", "judge_score": 0.5}, {"prompt_id": "x", "policy": "a", "metadata": {"judge_score": 0.25}, "draw_idx": 1}, {"prompt_id": "x", "policy": "a"}]
    (tmp_path / "fresh.jsonl").write_text("\n".join(map(json.dumps, draws)) + "\n{broken\n")
    assert sorted((r["draw_idx"], r["judge_score"]) for r in jsonl.read_fresh(spark, str(tmp_path / "fresh.jsonl")).collect()) == [(0, 0.5), (1, 0.25)]
    jsonl.write_results(spark.createDataFrame([("a", float("nan")), ("b", 0.5)], "policy string, estimate double"), str(tmp_path / "out"))
    assert {r["policy"]: r["estimate"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"a": None, "b": 0.5}


def test_suffix_logprobs(spark):
    rows = spark.createDataFrame([(1, "ab", ["ab", "c", "d"], [-1.0, -2.0, -3.0]), (2, "ab", ["abc"], [-1.0]), (3, "a", ["a", "b"], [-1.0, 2.0])], "key long, prompt string, tokens array<string>, logprobs array<double>")
    assert {r["key"]: (r["logprob"], r["status"]) for r in suffix_logprobs(rows).collect()} == {1: (-5.0, "exact_match"), 2: (None, "boundary_spans_token"), 3: (None, "positive")}
