"""Rules of logs, filters of prompts, weights along an index, the command line."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kalibra.__main__ import main
from kalibra.operators import smoothing, validation


def _line(i, **other):
    return {"prompt_id": f"p{i}", "prompt": "q", "response": "r", "base_policy_logprob": -1.0, "target_policy_logprobs": {"a": -1.0, "b": -2.0}, "judge_score": (i % 10) / 10, **other}


def _found(spark, tmp_path, lines, **fields):
    path = tmp_path / "log.jsonl"
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))
    return {r.rule: (r.level, r.n, r.of) for r in validation.validate(validation.raw_log(spark, str(path), "judge_score", "oracle_label", "reward"), **fields).collect()}


@pytest.mark.parametrize("labels, want", [(0, {"no labels": ("error", 80, 80)}), (9, {"too few labels": ("error", 9, 80)}), (10, {"few labels": ("warning", 10, 80)}), (50, {})])
def test_numbers_of_labels(spark, tmp_path, labels, want):
    assert _found(spark, tmp_path, [_line(i, **({"oracle_label": 0.5} if i < labels else {})) for i in range(80)]) == want


def test_rewards_need_no_labels_and_scores_may_be_objects_in_metadata(spark, tmp_path):
    assert _found(spark, tmp_path, [_line(i, reward=0.5) for i in range(3)]) == {}
    inside = [{k: v for k, v in _line(i).items() if k != "judge_score"} | {"metadata": {"judge_score": {"mean": 0.5}, "oracle_label": i % 2}} for i in range(60)]
    assert _found(spark, tmp_path, inside) == {}
    assert _found(spark, tmp_path, inside, judge_field=None) == {"neither rewards nor judge scores": ("error", 60, 60)}


def test_each_fault_is_counted_over_all_rows(spark, tmp_path):
    fine = [_line(i, oracle_label=0.5) for i in range(60)]
    odd = [
        "{cut", "[1]", "", _line(1, oracle_label="good"), _line(2, judge_score=[1]), _line(3, target_policy_logprobs={}), _line(4, target_policy_logprobs={"a": -1.0}),
        _line(5, target_policy_logprobs=[-1.0]), _line(6, base_policy_logprob=None), {k: v for k, v in _line(7).items() if k != "target_policy_logprobs"}, _line(8, target_policy_logprobs={"b": -1.0, "a": None}),
    ]
    of = 70
    assert _found(spark, tmp_path, fine + odd) == {
        "broken line": ("error", 2, of), "label is no number": ("error", 1, of), "judge score is no number": ("error", 1, of), "no policies": ("error", 1, of), "other policies": ("error", 1, of),
        "policies are no object": ("error", 1, of), "no base_policy_logprob": ("error", 1, of), "no target_policy_logprobs": ("error", 1, of),
    }
    assert _found(spark, tmp_path, []) == {"empty log": ("error", 0, 0)}


def test_blocked_phrases(spark):
    rows = spark.createDataFrame([(1, "An IDIOT, he said"), (2, "idiotic"), (3, None), (4, ""), (5, "stop right now"), (6, "stop, right -- here"), (None, "idiot"), (1, "An IDIOT, he said")], "doc_id int, text string")
    listed = lambda *p: spark.createDataFrame([(x,) for x in p], "phrase string")
    ids = lambda df: sorted((r.doc_id or 0) for r in df.collect())
    assert ids(validation.without_blocked(rows, "text", listed("Idiot", "!!", None))) == [2, 3, 4, 5, 6]
    assert ids(validation.without_blocked(rows, "text", listed("stop right", "idiot"), gram=2)) == [0, 1, 1, 2, 3, 4]
    assert validation.without_blocked(rows, "text", listed()).count() == 8 and validation.without_blocked(rows.limit(0), "text", listed("idiot")).count() == 0


def test_moderation_scores(spark):
    rows = spark.createDataFrame([({"x": 0.31},), ({"x": 0.3, "y": None},), ({},), (None,)], "s map<string,double>")
    assert [r.f for r in rows.select(validation.flagged(F.col("s")).alias("f")).collect()] == [True, False, False, False]


@pytest.mark.parametrize("half, block", [(0, 8), (3, 8), (8, 8), (5, 1000)])
def test_windows_span_blocks(spark, half, block):
    rng = np.random.default_rng(3)
    data = [(p, i, float(rng.integers(0, 4)), float(rng.exponential())) for p, n in (("a", 53), ("b", 1), ("c", 16)) for i in range(n)]
    rows = spark.createDataFrame(data, "policy string, row_id long, index double, raw double")
    got = {(r.policy, r.row_id): r.m for r in smoothing.moving_means(rows, "policy", "index", "row_id", {"m": "raw"}, half, block).collect()}
    assert len(got) == len(data)
    for p in "abc":
        own = sorted((x, i, w) for q, i, x, w in data if q == p)
        for at, (_, i, _) in enumerate(own):
            assert math.isclose(got[p, i], np.mean([w for _, _, w in own[max(0, at - half) : at + half + 1]]))
    with pytest.raises(ValueError, match="half"):
        smoothing.moving_means(rows, "policy", "index", "row_id", {"m": "raw"}, block + 1, block)


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(5)
    lines = [_line(i, judge_score=float(s), base_policy_logprob=-5.0, target_policy_logprobs={"a": -5.0 + float(d)}, oracle_label=float(np.clip(s + rng.normal(0, 0.05), 0, 1)) if i % 2 else None) for i, (s, d) in enumerate(zip(rng.random(200), rng.normal(0, 0.2, 200)))]
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join(map(json.dumps, lines)) + "\n")
    assert main(["validate", str(log)], spark) == 0 and capsys.readouterr().out.strip() == "valid"
    assert main(["analyze", str(log), "--estimator", "calibrated-ips", "--output", str(tmp_path / "out")], spark) == 0
    assert capsys.readouterr().out.startswith("a: 0.")
    assert [r.policy for r in spark.read.json(str(tmp_path / "out")).collect()] == ["a"]
    log.write_text("{cut\n")
    assert main(["validate", str(log)], spark) == 1 and "broken line" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["analyze", str(log), "--estimator", "unknown"], spark)
