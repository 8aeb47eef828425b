"""Partial labels, folds by blake2b, opening prompts, calibration parts, bounds, LaTeX and result documents on small made rows."""

import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from kalibra.operators import diagnostics, labels, reporting, tables
from kalibra.plans import rule_queries
from kalibra.plans.queries import ORACLE_SQL, QUERIES
from kalibra.sources import jsonl, results
from tests.test_plans import SF, _rows, duck  # noqa: F401

TWINS = ["h7_masked_labels", "f14_first_prompts", "d28_brier_parts", "d15_drawn_share", "a15_fenced_bounds", "a15_metrics_on_bounds", "sk1_result_document"]


@pytest.mark.parametrize("name", TWINS)
def test_twins_agree(spark, duck, name):  # noqa: F811
    assert rule_queries and _rows(QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize(("m", "share", "kept"), [(20, 0.25, 5), (20, 0.0, 2), (1, 0.5, 1), (0, 0.5, 0), (20, 1.0, 20)])
def test_masking_keeps_a_share_of_labels_and_all_rows(spark, m, share, kept):
    rows = spark.createDataFrame([(i, float(i) if i < m else None, "x") for i in range(30)], "row_id int, oracle_label double, other string")
    got = labels.masked(rows, share, seed=3)
    held = got.collect()
    assert len(held) == 30 and sum(r["oracle_label"] is not None for r in held) == kept
    assert all(r["oracle_label"] in (None, r["all_labels"]) for r in held)
    assert sorted(map(tuple, labels.restored(got).select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_masking_nests_and_rejects_shares_beyond_one(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(40)], "row_id int, oracle_label double")
    few, more = ({r["row_id"] for r in labels.masked(rows, s).where("oracle_label is not null").collect()} for s in (0.2, 0.6))
    assert few < more and len(more) == 24
    with pytest.raises(ValueError, match="share"):
        labels.masked(rows, 1.5)


def test_blake2b_folds_against_hashlib(spark):
    ids = [f"p{i}" for i in range(50)] + ["é 漢"]
    got = {r["id"]: r["f"] for r in spark.createDataFrame([(i,) for i in ids], "id string").select("id", labels.blake2b_fold(F.col("id"), 4, 9).alias("f")).collect()}
    assert got == {i: int.from_bytes(hashlib.blake2b(f"{i}-9-4".encode(), digest_size=8).digest(), "big") % 4 for i in ids}
    with pytest.raises(ValueError, match="two folds"):
        labels.blake2b_fold(F.col("id"), 1)
    for bad in ("", None):
        with pytest.raises(PythonException, match="no fold"):
            spark.createDataFrame([(bad,)], "id string").select(labels.blake2b_fold(F.col("id"))).collect()


def test_opening_prompts_by_language_and_number(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s", "en"), (1, 1, "user", "  ", "en"), (1, 2, "user", " hi ", "en"), (2, 0, "user", "hi", "en"), (3, 0, "user", "salut", "fr"), (4, 0, "user", "ho", "en"), (5, 0, "user", None, "en")],
        "conv_id int, turn int, role string, text string, lang string",
    )
    ask = lambda **k: sorted(map(tuple, labels.first_prompts(turns, **k).collect()))
    assert ask() == [(1, "hi"), (3, "salut"), (4, "ho")] and ask(languages=("en",)) == [(1, "hi"), (4, "ho")] and ask(n=2) == [(1, "hi"), (3, "salut")]


def test_brier_parts_add_up_where_a_bin_has_one_score(spark):
    rng = np.random.default_rng(4)
    p, y = rng.choice([0.05, 0.35, 0.65, 0.95], 300), rng.integers(0, 2, 300)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y, strict=True)] + [(None, 1.0), (0.5, None)], "p double, y double")
    r = diagnostics.brier_parts(rows, "p", "y").first()
    assert math.isclose(r["brier"], ((p - y) ** 2).mean()) and math.isclose(r["brier"], r["reliability"] - r["resolution"] + r["uncertainty"], abs_tol=1e-12)
    assert math.isclose(r["ece"], sum(abs(v - y[p == v].mean()) * (p == v).mean() for v in np.unique(p))) and r["mce"] >= 0.85  # the empty bin at 0.85
    none = diagnostics.brier_parts(rows.where("p is null"), "p", "y").first()
    assert none["ece"] is None and none["brier"] is None and none["calibrated"] is None


def test_score_test_and_coverage(spark):
    rows = spark.createDataFrame([("a", f"p{i}", float(i)) for i in range(10)] + [("b", "p0", 2.0)] * 3, "policy string, prompt_id string, phi double")
    got = {r["policy"]: r for r in diagnostics.score_test(rows).collect()}
    z = 4.5 / (np.arange(10).std() / math.sqrt(10))
    assert math.isclose(got["a"]["score_z"], z) and math.isclose(got["a"]["score_p"], math.erfc(z / math.sqrt(2))) and (got["b"]["score_z"], got["b"]["score_p"]) == (0, 1)
    fresh = spark.createDataFrame([("a", f"p{i}") for i in range(8)] * 2 + [("c", "p0")], "policy string, prompt_id string")
    assert {tuple(r) for r in diagnostics.drawn_share(rows, fresh).collect()} == {("a", 0.8, True), ("b", 0.0, False)}


def test_bounds_by_each_way(spark):
    v = [1.0, 2.0, 3.0, 4.0, 100.0]
    rows = spark.createDataFrame([(x, x, None, float("nan") if x > 50 else 7.0) for x in v], "x double, pass_rate double, gone double, flat double")
    ask = lambda how: {r["metric"]: (r["lo"], r["hi"]) for r in reporting.metric_bounds(rows, ["x", "pass_rate", "gone", "flat"], how).collect()}
    assert ask("iqr") == {"x": (1.0, 7.0), "pass_rate": (0.0, 100.0), "gone": (0.0, 1.0), "flat": (7.0, 7.0)}
    assert ask("percentile")["x"] == pytest.approx(tuple(np.percentile(v, [5, 95]))) and ask("range")["x"] == (1.0, 100.0)
    with pytest.raises(ValueError, match="bounds"):
        ask("guess")
    few = reporting.metric_bounds(rows.limit(3), ["x"]).first()
    assert (few["lo"], few["hi"]) == (1.0, 3.0)
    on = reporting.on_bounds(rows, reporting.metric_bounds(rows, ["x", "flat"]), ["x", "flat"]).orderBy("pass_rate").collect()
    assert [r["x"] for r in on] == pytest.approx([0, 1 / 6, 2 / 6, 0.5, 1]) and on[0]["flat"] == 0.5


def test_sensitivity_between_levels(spark):
    runs = [("e", 1, 0.1, s, rho, "p", 0.5 + d, 0.5, 0.01 * rho, 0.0, 1.0, 0.0) for s, d in ((1, 0.1), (2, 0.2)) for rho in (1.0, 2.0, 9.0)] + [("f", 1, 0.1, 1, 1.0, "p", 0.5, 0.5, 0.1, 0.0, 1.0, 0.0)]
    frame = spark.createDataFrame(runs, "estimator string, n int, coverage double, seed int, rho double, policy string, est double, truth double, se double, lo double, hi double, oracle_var double")
    got = {r["estimator"]: r for r in reporting.level_sensitivity(frame, "rho", (1.0, 2.0)).collect()}
    assert got["e"]["rmse_d"] == 0 and math.isclose(got["e"]["se_geomean"], 0.01) and got["f"]["rmse_d"] is None


def test_latex_marks_escapes_and_parts(spark):
    rows = spark.createDataFrame([("a_1", "x&y", 0.5), ("a_1", "50%", 0.25), ("b", "z", 0.25), ("b", "w", None)], "group string, name string, mae double").coalesce(1)
    text = reporting.latex(rows, ["group", "name", "mae"], {"mae": "min"}, "Errors_", "tab:e", {"mae": "MAE"}, "group", 2)
    lines = text.split("\n")
    assert r"\begin{tabular}{llr}" in lines and r"group & name & MAE \\" in lines and r"\caption{Errors\_}" in lines
    body = lines[lines.index(r"\midrule") + 1 : lines.index(r"\bottomrule")]
    assert body == [r"a\_1 & x\&y & \underline{0.50} \\", r"a\_1 & 50\% & \textbf{0.25} \\", r"\midrule", r"b & z & \textbf{0.25} \\", r"b & w &  \\"]
    assert reporting.latex_text("\\~^{}") == r"\textbackslash{}\textasciitilde{}\textasciicircum{}\{\}"
    with pytest.raises(ValueError, match="no report"):
        reporting.latex(rows, ["name"], {}, limit=3)


def test_documents_round_trip(spark, tmp_path):
    found = spark.createDataFrame([("b", 0.5, 0.1, 10), ("a", 0.25, float("nan"), 7), ("c", None, None, None)], "policy string, estimate double, se double, n long")
    results.write_document(found, f"{tmp_path}/one", "dr", {"seed": "7"})
    parts = list((tmp_path / "one").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert doc["target_policies"] == ["a", "b", "c"] and doc["per_policy_results"]["a"]["standard_error"] is None and doc["metadata"] == {"seed": "7"}
    got = {r["policy"]: r for r in results.read_documents(spark, f"{tmp_path}/one").collect()}
    assert got["b"]["n_samples"] == 10 and math.isclose(got["b"]["ci_upper"], 0.5 + 1.959963984540054 * 0.1) and got["c"]["estimate"] is None
    results.write_document(found.limit(0), f"{tmp_path}/none", "dr")
    assert results.read_documents(spark, f"{tmp_path}/none").count() == 0


def test_report_on_draws_and_extra_ones(spark):
    draws = [("a", "p1")] * 2 + [("a", "p2")] * 3 + [("a", "p3")] * 2 + [("b", "p1")] + [("b", "p9")] * 2
    fresh = spark.createDataFrame(draws, "policy string, prompt_id string")
    assert {tuple(r) for r in jsonl.draw_report(fresh).collect()} == {("a", 3, 7, 2, 3, 2, 1), ("b", 2, 3, 1, 2, 1, 1)}
    assert {r["policy"]: r["n_unequal"] for r in jsonl.draw_report(fresh, 3).collect()} == {"a": 2, "b": 2}
    logged = spark.createDataFrame([("p1",), ("p2",), ("p2",), ("p3",)], "prompt_id string")
    assert [tuple(r) for r in diagnostics.extra_draws(logged, fresh).collect()] == [("b", 1, 2)]


def test_summary_by_policy_of_an_empty_log(spark):
    logged = spark.createDataFrame([(-1.0, {"a": -1.0, "b": None}), (None, {"a": -1.0, "b": -1.0}), (-1.0, {"a": -2.0, "b": -1.0})], "base_lp double, target_lps map<string,double>")
    got = {r["policy"]: (r["n"], r["n_valid"], r["n_used"]) for r in diagnostics.policy_summary(logged, ["a", "b"]).collect()}
    assert got == {"a": (3, 2, 1), "b": (3, 1, 1)}
    assert [r["filter_rate"] for r in diagnostics.policy_summary(logged.limit(0), ["a"]).collect()] == [None]


def test_scratch_tables_go_with_their_owner(spark):
    rows = spark.range(5)
    with tables.owned(spark):
        outer = tables.written(rows, "outer").inputFiles()[0]
        with pytest.raises(KeyError), tables.owned(spark):
            inner = tables.written(rows, "inner").inputFiles()[0]
            raise KeyError
        here = [os.path.exists(p.removeprefix("file://")) for p in (outer, inner)]
    assert here == [True, False] and not os.path.exists(outer.removeprefix("file://"))
    assert tables.written(rows, "kept").count() == 5
