"""Queries over logs: those that grow (lines are made from the events table, with repeats and broken ones, written and read again),
rules of validation, filters of prompts, weights along scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, smoothing, validation
from ..operators.tables import scratch, written
from ..sources import growing
from . import bridge
from .bridge import SQL
from .oracle_sql import WEIGHTS
from .queries import calibrated, query, rounded, weighted


def _json(**fields) -> F.Column:
    return F.to_json(F.struct(*[(v if isinstance(v, F.Column) else F.col(v)).alias(k) for k, v in fields.items()]))


def _pass_files(spark: SparkSession, sf_dir: str) -> str:
    """Two policies, two passes: the first has each record twice (the earlier one is 1 too low), the second lacks every third row."""
    folder = scratch(spark, "passes")
    rows = bridge.logged(spark, sf_dir).withColumn("lp", F.col("base_lp"))
    for policy, shift in (("policy_a", 0.5), ("policy_b", 1.5)):
        value = F.round(F.col("lp") - shift, 6)
        old, new = _json(prompt_id="prompt_id", logprob=value - 1), _json(prompt_id="prompt_id", logprob=value)
        broken = F.when(F.col("row_id") % 50 == 0, F.lit('{"prompt_id": "cut'))
        rows.select(F.explode(F.array_compact(F.array(old, broken, new))).alias("value")).write.text(f"{folder}/{policy}_logprobs.jsonl")
        rows.where("row_id % 3 <> 0").select(_json(prompt_id="prompt_id", logprob=value - 0.25).alias("value")).write.text(f"{folder}/{policy}_logprobs_pass2.jsonl")
    return folder


@query(SQL + ", p as (select 'policy_a' as policy, 0.5 as shift union all select 'policy_b', 1.5), n as (select 1 as pass, 0.0 as more union all select 2, 0.25) select policy, prompt_id, cast(pass as integer) as pass, case when pass = 1 or row_id % 3 <> 0 then round(base_lp - shift - more, 6) end as logprob from logged cross join p cross join n")
def sc9_pass_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies and passes from file names, last records, passes that lack a row."""
    records, _ = growing.read_log(spark, f"{_pass_files(spark, sf_dir)}/*.jsonl", "prompt_id string, logprob double")
    return rounded(growing.pass_table(growing.with_pass(records)))


@query(SQL + ", p as (select 'policy_a' as policy union all select 'policy_b') select policy, (select 2 * count(*) + count(*) filter (where row_id % 3 <> 0) from logged) as n_lines, (select count(*) from logged where row_id % 50 = 0) as n_broken from p")
def sc9_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole and broken lines of each policy's files."""
    records, broken = growing.read_log(spark, f"{_pass_files(spark, sf_dir)}/*.jsonl", "prompt_id string, logprob double")
    both = growing.with_pass(records.select("log_file", F.lit(0).alias("bad")).union(broken.select("log_file", F.lit(1).alias("bad"))))
    return both.groupBy("policy").agg(F.count_if(F.col("bad") == 0).alias("n_lines"), F.count_if(F.col("bad") == 1).alias("n_broken"))


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records after two arrivals and the work: at first even rows, each fourth without a score; later every sixth, and those divisible by five again."""
    rows, folder = bridge.logged(spark, sf_dir), scratch(spark, "arrivals")
    first = _json(prompt_id="prompt_id", score=F.when(F.col("row_id") % 4 != 0, F.col("judge_score")))
    second = _json(prompt_id="prompt_id", score=F.round(F.col("judge_score") + 1, 6))
    for part, lines in (("a", rows.where("row_id % 2 = 0").select(first.alias("value"))), ("b", rows.where("row_id % 6 = 0 or row_id % 5 = 0").select(second.alias("value")))):
        lines.write.text(f"{folder}/log/{part}")
        growing.follow(spark, f"{folder}/log/*", "prompt_id string, score double", f"{folder}/table", f"{folder}/quarantine", f"{folder}/checkpoint")
    return growing.taken(spark, f"{folder}/table"), rows


LATEST = SQL + ", latest as (select row_id, prompt_id, case when row_id % 6 = 0 or row_id % 5 = 0 then round(judge_score + 1, 6) when row_id % 4 <> 0 then judge_score end as score from logged where row_id % 2 = 0 or row_id % 6 = 0 or row_id % 5 = 0)"


@query(LATEST + " select prompt_id, score from latest")
def sc10_latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each key after a stream took two arrivals."""
    return rounded(growing.last_wins(_arrivals(spark, sf_dir)[0], ["prompt_id"]).select("prompt_id", "score"))


@query(LATEST + " select l.row_id, l.prompt_id from logged l left join latest f on l.prompt_id = f.prompt_id and f.score is not null where f.prompt_id is null")
def sc10_still_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a record, or whose last record has no score."""
    records, work = _arrivals(spark, sf_dir)
    return growing.still_due(work, records, finished=F.col("score").isNotNull()).select("row_id", "prompt_id")


@query(SQL + """, r as (select row_id, row_id % 200 = 7 as cut, row_id % 40 <> 0 as asked, base_lp, row_id % 90 = 0 as none, row_id % 30 = 0 and row_id % 90 <> 0 as fewer, row_id % 11 = 0 as odd from logged),
n as (select *, (select count(*) from r) as all_ from r where not cut)
select 'broken line' as rule, 'error' as level, count(*) as n, (select count(*) from r) as of from r where cut having count(*) > 0
union all select 'no prompt', 'error', count(*), max(all_) from n where not asked having count(*) > 0
union all select 'no base_policy_logprob', 'error', count(*), max(all_) from n where base_lp is null having count(*) > 0
union all select 'no policies', 'error', count(*), max(all_) from n where none having count(*) > 0
union all select 'other policies', 'error', count(*), max(all_) from n where fewer having count(*) > 0
union all select 'judge score is no number', 'error', count(*), max(all_) from n where odd having count(*) > 0""")
def f5_log_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules broken by a log of all events with planted faults."""
    r, lp = F.col("row_id"), F.create_map(F.lit("policy_b"), F.lit(-1.0))
    policies = F.when(r % 90 == 0, F.create_map().cast("map<string,double>")).when(r % 30 == 0, lp).otherwise(F.map_concat(F.create_map(F.lit("policy_a"), F.lit(-2.0)), lp))
    score = F.when(r % 11 == 0, F.lit('"high"')).when(r % 3 == 0, F.concat(F.lit('{"mean": '), F.col("judge_score").cast("string"), F.lit("}"))).otherwise(F.col("judge_score").cast("string"))
    body = _json(prompt_id="prompt_id", prompt=F.when(r % 40 != 0, F.lit("q")), response=F.lit("r"), base_policy_logprob="base_lp", target_policy_logprobs=policies, oracle_label="oracle_label")
    line = F.concat(F.expr("substr(b, 1, length(b) - 1)"), F.lit(', "judge_score": '), score, F.lit("}"))
    path = scratch(spark, "log")
    bridge.logged(spark, sf_dir).withColumn("b", body).select(F.when(r % 200 == 7, F.lit('{"prompt_id"')).otherwise(line).alias("value")).write.text(path)
    return validation.validate(validation.raw_log(spark, path, "judge_score", "oracle_label", "reward"))


@query("select doc_id from documents where not list_has_any(string_split_regex(lower(coalesce(text, '')), '[\\s!-/:-@\\[-`{-~]+'), ['worthless', 'pathetic', 'idiot', 'stupid'])")
def f13_unblocked_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without any word of a caller's list, at word bounds."""
    listed = spark.createDataFrame([(w,) for w in ("Worthless", "pathetic", "idiot", "stupid")], "phrase string")
    return validation.without_blocked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text", listed).select("doc_id")


@query(SQL + ", m as (select prompt_id, judge_score as s, case when row_id % 7 <> 0 then judge_score * judge_score end as q, row_id % 5 = 0 as none from logged) select prompt_id, not none and (coalesce(s > 0.3, false) or coalesce(q > 0.3, false)) as flagged from m")
def f13_moderation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any moderation score is over 0.3; a score may be null, or the whole map."""
    s, r = F.col("judge_score"), F.col("row_id")
    scores = F.when(r % 5 != 0, F.create_map(F.lit("x"), s, F.lit("y"), F.when(r % 7 != 0, s * s)))
    return bridge.logged(spark, sf_dir).select("prompt_id", validation.flagged(scores).alias("flagged"))


@query(WEIGHTS + " select policy, row_id, round(judge_score, 6) as index, round(w, 6) as raw, round(w_cal, 6) as cal, round(avg(w) over o, 6) as raw_smooth, round(avg(w_cal) over o, 6) as cal_smooth from wcal where w > 0 and w_cal > 0 and judge_score is not null window o as (partition by policy order by judge_score, row_id rows between 50 preceding and 50 following)")
def v4_weights_along_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights before and after calibration along judge scores, with moving means of 101 rows; blocks of 3,000 rows here, so that windows span them."""
    return rounded(smoothing.weights_along(calibrated(spark, sf_dir), block=3000))


@query(WEIGHTS + ", a as (select policy, count(*) as n, sum(w) * sum(w) / sum(w * w) as r, sum(w_cal) * sum(w_cal) / sum(w_cal * w_cal) as c, var_pop(w_cal) / var_pop(w) as v, max(w) as mr, max(w_cal) as mc, count(*) filter (where w > 10) as t, count(*) filter (where w > 100) as h from wcal group by 1) select policy, n, round(r, 5) as ess_raw, round(c, 5) as ess_cal, round(c / r, 5) as uplift, round(v, 5) as var_ratio, round(mr, 5) as max_raw, round(mc, 5) as max_cal, t as over_10, h as over_100 from a")
def v2_weight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective rows and variance before and after calibration, largest weights, counts over 10 and 100."""
    return rounded(smoothing.weight_summary(calibrated(spark, sf_dir)), 5)


DELTA = " select policy, count(*) as n, round(a / b, 6) as estimate, round(sqrt(sum(pow(x - a / b * y, 2))) / (b * count(*)), 6) as linear_se, true as agrees from (select policy, x, y, avg(x) over (partition by policy) as a, avg(y) over (partition by policy) as b from v) group by policy, a, b"


@query(SQL + ", v as (select policy, w * judge_score as x, w as y from w)" + DELTA)
def d19_ratio_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The self-normalised mean of scores with its error by linearisation, and whether the bootstrap of the ratio comes within a tenth of it."""
    rows = written(weighted(spark, sf_dir).select("policy", "row_id", "w", (F.col("w") * F.col("judge_score")).alias("ws")), "ratio")
    drawn = bootstrap.bootstrap(rows, bootstrap.ratio("ws", "w"))
    own = rows.join(F.broadcast(drawn.select("policy", "estimate", "se")), "policy")
    off = F.col("ws") - F.col("estimate") * F.col("w")
    linear = own.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.first("estimate").alias("estimate"), F.first("se").alias("se"), (F.sqrt(F.sum(off * off)) / F.sum("w")).alias("linear_se"))
    return rounded(linear.select("policy", "n", "estimate", "linear_se", (F.abs(F.col("se") / F.col("linear_se") - 1) < 0.1).alias("agrees")))
