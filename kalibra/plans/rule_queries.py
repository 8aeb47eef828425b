"""Queries of partial labels, folds, calibration parts, score tests, bounds and sensitivity of reports, result documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics, estimators, labels, reporting
from ..operators.tables import scratch, written
from ..sources import jsonl, results
from . import bridge
from .bridge import SQL
from .oracle_sql import CALIBRATED, OUTCOMES, two_sided
from .queries import models, outcomes, query, rounded, scored, weighted
from .report_queries import MISS, RUNS_SQL, first

PLACE = "('0x' || substr(md5('11-' || cast(row_id as varchar)), 1, 12))::bigint"


@query(SQL + f", m as (select row_id, count(*) over () as m, row_number() over (order by {PLACE}, row_id) as rn from logged where oracle_label is not null) select l.row_id, l.oracle_label as all_labels, case when rn <= least(m, greatest(2, floor(m * 0.3))) then l.oracle_label end as oracle_label from logged l left join m using (row_id)")
def h7_masked_labels(spark, sf_dir):
    """All rows, with three tenths of the labels; the column of all labels brings the others back."""
    return labels.masked(bridge.logged(spark, sf_dir), 0.3, seed=11).select("row_id", "all_labels", "oracle_label")


@query(SQL + " select row_id, oracle_label from logged")
def h7_restored_labels(spark, sf_dir):
    return labels.restored(labels.masked(bridge.logged(spark, sf_dir), 0.3, seed=11)).select("row_id", "oracle_label")


@query()
def h1_blake2b_fold(spark, sf_dir):
    """DuckDB has no blake2b: the test holds folds against hashlib."""
    return bridge.logged(spark, sf_dir).select("row_id", "prompt_id", labels.blake2b_fold(F.col("prompt_id")).alias("fold"))


@query("select min(conv_id) as conv_id, text from (select conv_id, trim(text) as text, row_number() over (partition by conv_id order by turn) as rn from conversations where role = 'user' and trim(text) <> '') where rn = 1 group by text order by 1 limit 50")
def f14_first_prompts(spark, sf_dir):
    """The first fifty distinct opening prompts: the number asked for is the operator's own."""
    return labels.first_prompts(spark.read.parquet(f"{sf_dir}/conversations.parquet"), n=50)


@query(SQL + ", b as (select least(floor(judge_score * 10), 9) as bin, judge_score as p, oracle_label as y from logged where oracle_label is not null and judge_score is not null), o as (select avg((p - y) * (p - y)) as brier, avg(y) as base, count(*) as n from b), a as (select r.i as bin, coalesce(c, 0) as c, coalesce(conf, (r.i + 0.5) / 10) as conf, coalesce(acc, 0.0) as acc from (select unnest(range(10)) as i) r left join (select bin, count(*) as c, avg(p) as conf, avg(y) as acc from b group by 1) g on g.bin = r.i) select round(sum(c * abs(conf - acc)) / any_value(n), 6) as ece, round(max(abs(conf - acc)), 6) as mce, round(any_value(brier), 6) as brier, round(sum(c * (conf - acc) * (conf - acc)) / any_value(n), 6) as reliability, round(sum(c * (acc - base) * (acc - base)) / any_value(n), 6) as resolution, round(any_value(base * (1 - base)), 6) as uncertainty, sum(c * abs(conf - acc)) / any_value(n) < 0.1 as calibrated from a cross join o")
def d28_brier_parts(spark, sf_dir):
    return rounded(diagnostics.brier_parts(bridge.logged(spark, sf_dir), "judge_score", "oracle_label"))


@query(OUTCOMES + f", z as (select policy, avg(w_cal * (reward - g)) as m, stddev_pop(w_cal * (reward - g)) / sqrt(count(*)) as se from dr group by 1) select policy, round(m, 6) as score_mean, round(se, 6) as score_se, round(m / se, 4) as score_z, round({two_sided('(m / se)')}, 6) as score_p from z")
def d13_orthogonality_test(spark, sf_dir):
    """Whether weighted residuals of the outcome model have mean zero, with its p."""
    rows = outcomes(spark, sf_dir).select("policy", (F.col("w_cal") * (F.col("reward") - F.col("g"))).alias("phi"))
    return rounded(diagnostics.score_test(rows)).withColumn("score_z", F.round("score_z", 4))


@query(SQL + ", drawn as (select distinct policy, prompt_id from fresh where row_id % 7 <> 0 and (policy = 'policy_a' or row_id % 3 <> 0)) select w.policy, round(avg(case when s.prompt_id is null then 0.0 else 1.0 end), 6) as coverage, avg(case when s.prompt_id is null then 0.0 else 1.0 end) >= 0.8 as coverage_ok from w left join drawn s on s.policy = w.policy and s.prompt_id = w.prompt_id group by w.policy")
def d15_drawn_share(spark, sf_dir):
    """Of draws without every seventh prompt (and for one policy every third), how many logged rows have any."""
    some = bridge.fresh(spark, sf_dir).where("row_id % 7 <> 0 and (policy = 'policy_a' or row_id % 3 <> 0)")
    return rounded(diagnostics.drawn_share(weighted(spark, sf_dir), some))


CAPPED = "r as (select *, case when toggle then 2.0 else 1.0 end as rho from runs1)"


def _capped(spark, sf_dir):
    return first(spark, sf_dir).withColumn("rho", F.when(F.col("toggle"), 2.0).otherwise(1.0))


@query(RUNS_SQL + f", {CAPPED}, m as (select estimator, n, coverage, seed, rho, sqrt(avg(greatest(0, (est - truth) * (est - truth) - oracle_var))) as rmse_d, exp(avg(ln(se))) as se_geomean, exp(avg(case when {MISS} > 0 then ln({MISS} + 1e-12) end)) as interval_score from r group by all) select a.estimator, round(max(abs(b.rmse_d - a.rmse_d)), 6) as rmse_d, round(max(abs(b.se_geomean - a.se_geomean)), 6) as se_geomean, round(max(abs(b.interval_score - a.interval_score)), 6) as interval_score from m a left join m b on a.estimator = b.estimator and a.n = b.n and a.coverage = b.coverage and a.seed = b.seed and b.rho = 2.0 and a.rho = 1.0 group by a.estimator")
def a14_cap_sensitivity(spark, sf_dir):
    return rounded(reporting.level_sensitivity(_capped(spark, sf_dir), "rho", (1.0, 2.0), ("rmse_d", "se_geomean", "interval_score")))


METRIC = "long as (select unnest(['se', 'est', 'gate_rate']) as metric, unnest([se, est, case when gate then 100.0 else 0.0 end]) as v from runs1)"


def _metrics(spark, sf_dir):
    return first(spark, sf_dir).withColumn("gate_rate", F.when(F.coalesce("gate", F.lit(False)), 100.0).otherwise(0.0))


@query(RUNS_SQL + f", {METRIC}, q as (select metric, min(v) as a, max(v) as b, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from long group by 1) select metric, round(case when metric = 'gate_rate' then 0 else greatest(a, q1 - 0.5 * (q3 - q1)) end, 6) as lo, round(case when metric = 'gate_rate' then 100 else least(b, q3 + 0.5 * (q3 - q1)) end, 6) as hi from q")
def a15_fenced_bounds(spark, sf_dir):
    return rounded(reporting.metric_bounds(_metrics(spark, sf_dir), ["se", "est", "gate_rate"], reach=0.5))


@query(RUNS_SQL + f", {METRIC}, q as (select case when metric = 'gate_rate' then 0 else quantile_cont(v, 0.05) end as lo, case when metric = 'gate_rate' then 100 else quantile_cont(v, 0.95) end as hi, metric from long group by metric), p as (select run_id, policy, " + ", ".join(f"(least(greatest({v}, (select lo from q where metric = '{v}')), (select hi from q where metric = '{v}')) - (select lo from q where metric = '{v}')) / (select hi - lo from q where metric = '{v}') as {v}" for v in ("se", "est")) + " from runs1) select run_id, policy, round(se, 6) as se, round(est, 6) as est from p")
def a15_metrics_on_bounds(spark, sf_dir):
    """Metrics cut to their 5th and 95th percentiles and put on [0, 1]."""
    rows = _metrics(spark, sf_dir)
    bounds = reporting.metric_bounds(rows, ["se", "est", "gate_rate"], "percentile")
    return rounded(reporting.on_bounds(rows, bounds, ["se", "est"]).select("run_id", "policy", "se", "est"))


@query(CALIBRATED + """, psi as (select policy, sum(w * reward) / sum(w) as psi from scored group by 1), phis as (select policy, w * reward as c, w * (reward_oof - psi) - psi * (w - 1) as p from scored join psi using (policy)),
e as (select policy, avg(c) as estimate, stddev_samp(p) / sqrt(count(*)) as se, count(*) as n from phis group by 1)
select 'raw-ips' as method, policy, round(estimate, 6) as estimate, round(se, 6) as standard_error, round(estimate - 1.959963984540054 * se, 6) as ci_lower, round(estimate + 1.959963984540054 * se, 6) as ci_upper, n as n_samples, 'events' as source from e""")
def sk1_result_document(spark, sf_dir):
    """Estimates written as one JSON document and read back."""
    path = scratch(spark, "document")
    found = estimators.cluster_robust(estimators.raw_ips(scored(spark, sf_dir, models(spark, sf_dir)))).select("policy", "estimate", F.col("se_naive").alias("se"), "n")
    results.write_document(found, path, "raw-ips", {"source": "events"})
    return rounded(results.read_documents(spark, path)).withColumn("source", F.col("metadata")["source"]).drop("metadata")


@query(CALIBRATED + " select policy, count(*) as n, round(avg(w * reward), 6) as estimate, round(stddev_pop(w * reward) / sqrt(count(*)), 6) as linear_se, true as agrees, true as inside from scored group by policy")
def a16_bootstrap_error(spark, sf_dir):
    """Means of contributions with their plain error, whether the bootstrap's comes within a tenth of it, and its interval holds the mean."""
    rows = written(estimators.raw_ips(scored(spark, sf_dir, models(spark, sf_dir))).select("policy", "row_id", "c"), "contributions")
    plain = rows.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("estimate"), (F.stddev_pop("c") / F.sqrt(F.count(F.lit(1)))).alias("linear_se"))
    both = plain.join(F.broadcast(estimators.bootstrap_means(rows)), "policy")
    return rounded(both.select("policy", "n", "estimate", "linear_se", (F.abs(F.col("se") / F.col("linear_se") - 1) < 0.1).alias("agrees"), F.col("estimate").between(F.col("lo"), F.col("hi")).alias("inside")))


@query(SQL + ", j as (select *, coalesce(case when row_id % 43 = 0 then -base_lp else base_lp end, 0) > 0 or row_id % 41 = 0 as rejected, case when row_id % 41 <> 0 then 'question ' || row_id end as prompt from logged) select case when row_id % 37 <> 0 then prompt_id when prompt is not null then 'prompt_' || substr(sha256(prompt), 1, 12) end as prompt_id, round(case when row_id % 43 = 0 then -base_lp else base_lp end, 6) as base_lp, round(lp_a, 6) as lp_a, round(lp_b, 6) as lp_b, round(judge_score, 6) as judge_score, round(oracle_label, 6) as oracle_label, rejected from j")
def sc1_json_log(spark, sf_dir):
    """The log as JSON lines, read again: some rows lack a prompt or have a positive log-probability and are rejected, some lack an id; scores
    are objects, labels lie in metadata."""
    path, rows = scratch(spark, "log"), bridge.logged(spark, sf_dir)
    fields = {
        "prompt_id": F.when(F.col("row_id") % 37 != 0, F.col("prompt_id")).otherwise(""), "prompt": F.when(F.col("row_id") % 41 != 0, F.concat(F.lit("question "), F.col("row_id").cast("string"))), "response": F.lit("answer"),
        "base_policy_logprob": F.when(F.col("row_id") % 43 == 0, -F.col("base_lp")).otherwise(F.col("base_lp")), "target_policy_logprobs": F.col("target_lps"),
        "judge_score": F.struct(F.col("judge_score").alias("mean")), "metadata": F.struct("oracle_label"),
    }
    rows.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value")).write.text(path)
    fine, rejected = jsonl.read_logged(spark, path)
    both = fine.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True)))
    return rounded(both.select("prompt_id", "base_lp", F.col("target_lps")["policy_a"].alias("lp_a"), F.col("target_lps")["policy_b"].alias("lp_b"), "judge_score", "oracle_label", "rejected"))


@query(SQL + ", d as (select policy, prompt_id, count(*) as d from fresh group by 1, 2), c as (select policy, d, count(*) as c from d group by 1, 2), e as (select policy, d as expected from (select *, row_number() over (partition by policy order by c desc, d) as rn from c) where rn = 1) select c.policy, cast(sum(c) as bigint) as n_prompts, cast(sum(c * d) as bigint) as n_draws, min(d) as least, max(d) as most, any_value(expected) as expected, cast(sum(case when d <> expected then c else 0 end) as bigint) as n_unequal from c join e using (policy) group by c.policy")
def sc7_fresh_draws(spark, sf_dir):
    """Draws of all policies as JSON lines, read again, with a report on prompts that have an unusual number of them."""
    path = scratch(spark, "fresh")
    bridge.fresh(spark, sf_dir).select(F.to_json(F.struct("prompt_id", F.col("policy").alias("target_policy"), "draw_idx", "judge_score")).alias("value")).write.text(path)
    return jsonl.draw_report(jsonl.read_fresh(spark, path))


@query(SQL + ", d as (select policy, prompt_id, count(*) as d from fresh where prompt_id not in (select prompt_id from logged where row_id % 9 <> 0) group by 1, 2) select policy, count(*) as n_prompts, cast(sum(d) as bigint) as n_draws from d group by policy")
def j9_extra_draws(spark, sf_dir):
    """Draws of prompts that a log without every ninth row lacks."""
    return diagnostics.extra_draws(bridge.logged(spark, sf_dir).where("row_id % 9 <> 0"), bridge.fresh(spark, sf_dir))


@query(SQL + ", t as (select count(*) as n, count(*) filter (where base_lp is not null and lp_a is not null) as a, count(*) filter (where base_lp is not null and lp_b is not null) as b, count(*) filter (where base_lp is not null and lp_a is not null and lp_b is not null) as n_used from logged) select 'policy_a' as policy, n, a as n_valid, n_used, round(1 - n_used / n, 6) as filter_rate from t union all select 'policy_b', n, b, n_used, round(1 - n_used / n, 6) from t")
def f10_policy_summary(spark, sf_dir):
    return rounded(diagnostics.policy_summary(bridge.logged(spark, sf_dir), bridge.POLICIES))
