"""Logs that grow: last records, broken lines, names of files, and streams that are cut off."""

import json

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalibra.sources import growing

SCHEMA = "prompt_id string, logprob double"


def _put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def _rec(key, value):
    return {"prompt_id": key, "logprob": value}


def test_lines_that_are_no_records_are_set_aside(spark, tmp_path):
    _put(tmp_path / "x.jsonl", _rec("a", -1), "", "   ", '{"prompt_id": "b"', "[1, 2]", '{"prompt_id": "c", "logprob": "much"}', '{"prompt_id": "d", "extra": 5}')
    records, broken = growing.read_log(spark, str(tmp_path), SCHEMA)
    assert sorted((r.prompt_id, r.logprob) for r in records.collect()) == [("a", -1.0), ("d", None)]
    assert sorted(r.line for r in broken.collect()) == ['[1, 2]', '{"prompt_id": "b"', '{"prompt_id": "c", "logprob": "much"}']


def test_last_record_wins_across_files_and_blocks_of_a_file(spark, tmp_path):
    many = [_rec(f"k{i % 7}", -float(i)) for i in range(5000)]
    _put(tmp_path / "1.jsonl", *many)
    _put(tmp_path / "2.jsonl", _rec("k0", 5.0), _rec(None, 1.0))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records, _ = growing.read_log(spark, str(tmp_path), SCHEMA)
        assert records.rdd.getNumPartitions() > 4
        got = {r.prompt_id: r.logprob for r in growing.last_wins(records, ["prompt_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {**{f"k{i % 7}": -float(i) for i in range(5000)}, "k0": 5.0}


def test_passes_come_from_names(spark, tmp_path):
    _put(tmp_path / "base_logprobs.jsonl", _rec("a", -1), _rec("b", -2), _rec("a", -3))
    _put(tmp_path / "base_logprobs_pass2.jsonl", _rec("b", -4), _rec("new", -9))
    _put(tmp_path / "base_logprobs_pass10.jsonl", _rec("a", None))
    _put(tmp_path / "other_logprobs.jsonl", _rec("a", -7))
    _put(tmp_path / "notes.jsonl", _rec("a", -100))
    table = growing.pass_table(growing.with_pass(growing.read_log(spark, str(tmp_path), SCHEMA)[0]))
    got = {(r["policy"], r["prompt_id"], r["pass"]): r["logprob"] for r in table.collect()}
    assert got == {("base", "a", 1): -3.0, ("base", "a", 2): None, ("base", "a", 10): None, ("base", "b", 1): -2.0, ("base", "b", 2): -4.0, ("base", "b", 10): None, ("other", "a", 1): -7.0}


def test_work_that_is_due(spark, tmp_path):
    _put(tmp_path / "x.jsonl", _rec("a", 1), _rec("b", 1), _rec("b", None), _rec("c", None))
    records, _ = growing.read_log(spark, str(tmp_path), SCHEMA)
    work = spark.createDataFrame([(k,) for k in "abcd"], "prompt_id string")
    keys = lambda df: sorted(r.prompt_id for r in df.collect())
    assert keys(growing.still_due(work, records, finished=F.col("logprob").isNotNull())) == ["b", "c", "d"] and keys(growing.still_due(work, records)) == ["d"]
    assert keys(growing.still_due(work, records.limit(0))) == ["a", "b", "c", "d"]


def test_stream_cut_off_between_its_two_tables_leaves_nothing_twice(spark, tmp_path, monkeypatch):
    places = [str(tmp_path / n) for n in ("table", "quarantine", "checkpoint")]
    for i in range(3):
        _put(tmp_path / "log" / f"{i}.jsonl", _rec(f"k{i}", i), _rec("all", i), "{cut")
    go = lambda: growing.follow(spark, str(tmp_path / "log"), SCHEMA, *places, files_a_batch=1)
    honest, failures = growing.parse, []

    def failing(lines: DataFrame, schema: str, batch: int = 0):
        records, broken = honest(lines, schema, batch)
        if batch == 1 and not failures:
            failures.append(batch)
            records.write.mode("overwrite").parquet(f"{places[0]}/batch=1")
            raise RuntimeError("killed")
        return records, broken

    monkeypatch.setattr(growing, "parse", failing)
    with pytest.raises(Exception, match="killed"):
        go()
    assert growing.taken(spark, places[0]).count() == 4  # of the batch cut off the first table is there
    go()
    go()  # nothing new: nothing changes
    assert failures == [1]
    records, broken = growing.taken(spark, places[0]), growing.taken(spark, places[1])
    assert records.count() == 6 and broken.count() == 3
    order = {r.log_batch: r.log_file[-7:] for r in records.collect()}
    assert {r.prompt_id: r.logprob for r in growing.last_wins(records, ["prompt_id"]).collect()} == {"k0": 0.0, "k1": 1.0, "k2": 2.0, "all": float(order[2][0])}


def test_lines_are_parsed_once_for_passes_and_last_records_win_over_blocks(spark, tmp_path):
    _put(tmp_path / "base_logprobs.jsonl", *[_rec(f"k{i % 7}", -float(i)) for i in range(5000)], _rec(None, 1.0), "{cut")
    _put(tmp_path / "base_logprobs_pass2.jsonl", *[_rec(f"k{i % 7}", None if i == 2999 else float(i)) for i in range(3000)])
    _put(tmp_path / "base_logprobs_pass3.jsonl", _rec(None, 1.0))
    _put(tmp_path / "base_logprobs_pass4.jsonl", "{cut")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records, broken = growing.read_log(spark, str(tmp_path), SCHEMA)
        for df in (records, broken):
            assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
        table = growing.pass_table(growing.with_pass(records))
        assert "from_json" not in table._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["prompt_id"], r["pass"]): r["logprob"] for r in table.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {(f"k{i % 7}", 1): -float(i) for i in range(5000)}
    second = {(f"k{i % 7}", 2): None if i == 2999 else float(i) for i in range(3000)}
    assert got == {**first, **second, **{(f"k{i}", 3): None for i in range(7)}}


@pytest.mark.parametrize("path, want", [
    ("file:/x/a_logprobs.jsonl", ("a", "")), ("a_logprobs_pass12.jsonl/part-0", ("a", "12")), ("/d_logprobs/b_logprobs_logprobs.jsonl", ("b_logprobs", "")), ("/a_logprobs.jsonl/b_logprobs_pass2.jsonl", ("a", "")),
    ("/a_logprobs.jsonl/x/y", ("", "")), ("/_logprobs.jsonl", ("", "")), ("/a_logprobs_passx.jsonl", ("", "")), ("/" + "n" * 20000 + "/a_logprobs.jsonl", ("a", "")),
])
def test_names_of_passes(spark, path, want):
    line = spark.createDataFrame([(path,)], "log_file string")
    at = line.select(*[F.regexp_extract("log_file", growing.PASS_NAME, i) for i in (1, 2)]).first()
    assert tuple(at) == want
    passes = [want[0], int(want[1] or 1)]
    assert [[r["policy"], r["pass"]] for r in growing.with_pass(line).collect()] == ([passes] if want[0] else [])
