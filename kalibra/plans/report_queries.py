"""Reporting queries over experiment rows made from events and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnostics, reporting
from . import bridge
from .bridge import SQL
from .queries import query, rounded, weighted

#: A row a run and policy, as SQL that Spark and DuckDB read alike.
RUNS = """cast(floor(event_id / 4) as bigint) as run_id, concat('est', cast(cast(floor(event_id / 4) as bigint) % 5 as varchar(3))) as estimator, cast(floor(event_id / 20) as bigint) % 10 as seed,
 250 * (1 + cast(floor(event_id / 200) as bigint) % 3) as n, 0.05e0 * (1 + cast(floor(event_id / 600) as bigint) % 4) as coverage, cast(floor(event_id / 2400) as bigint) % 2 = 1 as toggle,
 concat('p', cast(event_id % 4 as varchar(3))) as policy, 0.5e0 + (event_id % 4) / 20e0 as truth, 0.5e0 + (event_id % 4) / 20e0 + ((event_id * 37) % 101 - 50) / 900e0 as est, 0.01e0 + ((event_id * 53) % 97) / 3000e0 as se,
 1e-4 as oracle_var, case when event_id % 7 = 0 then null else event_id % 3 = 0 end as gate"""
RUNS_SQL = f"with r0 as (select {RUNS} from events), runs as (select *, est - 1.96 * se as lo, est + 1.96 * se as hi from r0), runs1 as (select * from (select *, row_number() over (partition by estimator, seed, n, coverage, toggle, policy order by run_id) as rn from runs) where rn = 1)"
MISS = "(hi - lo + 40 * (greatest(lo - truth, 0) + greatest(truth - hi, 0)))"
METRICS = f"""round(sqrt(avg(greatest(0, (est - truth) * (est - truth) - oracle_var))), 6) as rmse_d, round(avg(abs(est - truth)), 6) as mae, round(exp(avg(case when {MISS} > 0 then ln({MISS} + 1e-12) end)), 6) as interval_score,
 round(avg(case when truth between lo and hi then 1.0 else 0.0 end), 6) as coverage_rate, round(abs(avg(case when truth between lo and hi then 1.0 else 0.0 end) - 0.95) * 100, 6) as calibration, round(exp(avg(ln(se))), 6) as se_geomean, round(avg(hi - lo), 6) as mean_width, round(median(hi - lo), 6) as median_width"""


def runs(spark, sf_dir) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[x.strip() for x in bridge._parts(RUNS)])
    return own.withColumn("lo", F.col("est") - 1.96 * F.col("se")).withColumn("hi", F.col("est") + 1.96 * F.col("se"))


def first(spark, sf_dir) -> DataFrame:
    return reporting.first_runs(runs(spark, sf_dir))


@query(RUNS_SQL + f" select estimator, n, round(coverage, 2) as coverage, {METRICS} from runs1 group by estimator, n, coverage")
def j2_metrics_by_regime(spark, sf_dir):
    return rounded(reporting.table(first(spark, sf_dir), "estimator", "n", "coverage")).withColumn("coverage", F.round("coverage", 2))


@query(RUNS_SQL + f" select estimator, {METRICS} from runs1 group by estimator")
def a12_metrics_by_estimator(spark, sf_dir):
    return rounded(reporting.table(first(spark, sf_dir), "estimator"))


@query(RUNS_SQL + f" select concat_ws('+', case when grouping(estimator) = 0 then 'estimator' end, case when grouping(n) = 0 then 'n' end, case when grouping(coverage) = 0 then 'coverage' end, case when grouping(seed) = 0 then 'seed' end) as grouping, estimator, n, round(coverage, 2) as coverage, seed, {METRICS.replace(", 6)", ", 9)")} from runs1 group by grouping sets ((estimator, n, coverage), (estimator), (estimator, seed))")
def a12_three_groupings(spark, sf_dir):
    """Means of a few decimals end in fives at the seventh place, so nine are given."""
    return rounded(reporting.tables(first(spark, sf_dir)), 9).withColumn("coverage", F.round("coverage", 2))


@query(RUNS_SQL + " select run_id, estimator, seed, n, policy from runs1")
def a18_deduplicated_runs(spark, sf_dir):
    return first(spark, sf_dir).select("run_id", "estimator", "seed", "n", "policy")


@query(RUNS_SQL + " select a.estimator, a.seed, a.n, a.policy, round(a.se - b.se, 9) as delta from runs1 a join runs1 b on a.estimator = b.estimator and a.seed = b.seed and a.n = b.n and a.coverage = b.coverage and a.policy = b.policy where a.toggle and not b.toggle")
def j1_paired_delta(spark, sf_dir):
    return rounded(reporting.paired_delta(first(spark, sf_dir)).select("estimator", "seed", "n", "policy", "delta"), 9)


@query(RUNS_SQL + ", pw as (select a.run_id, avg(case when sign(a.est - b.est) = sign(a.truth - b.truth) then 1.0 else 0.0 end) as pairwise from runs1 a join runs1 b on a.run_id = b.run_id and a.policy < b.policy group by 1), t as (select run_id, estimator, max(truth) - arg_max(truth, est) as regret from runs1 group by 1, 2) select run_id, estimator, round(pairwise, 6) as pairwise, round(regret, 6) as regret, case when regret <= 0 then 1.0 else 0.0 end as top1 from t join pw using (run_id)")
def a6_ranking(spark, sf_dir):
    return rounded(reporting.ranking(first(spark, sf_dir)).select("run_id", "estimator", "pairwise", "regret", "top1"))


@query(RUNS_SQL + " select estimator, n, policy, round(coverage, 2) as coverage, round(avg(est), 9) as mean, round(sqrt(avg(se * se) + coalesce(var_samp(est), 0)), 9) as error, count(distinct seed) as seeds from runs1 group by estimator, n, policy, coverage")
def a22_across_seeds(spark, sf_dir):
    return rounded(reporting.across_seeds(first(spark, sf_dir)), 9).withColumn("coverage", F.round("coverage", 2))


@query(RUNS_SQL + ", q as (select estimator, quantile_cont(se, 0.25) as q1, quantile_cont(se, 0.75) as q3 from runs1 group by 1) select estimator, round(q1 - 1.5 * (q3 - q1), 9) as lo, round(q3 + 1.5 * (q3 - q1), 9) as hi from q")
def a15_outlier_bounds(spark, sf_dir):
    return rounded(reporting.outlier_bounds(first(spark, sf_dir)), 9)


@query(RUNS_SQL + " select n, round(coverage, 2) as coverage, round(avg(se), 9) as mean_se, round((1.96 + 0.84) * sqrt(2) * avg(se), 9) as mde from runs1 group by n, coverage")
def a20_detectable_effect(spark, sf_dir):
    return rounded(reporting.detectable(first(spark, sf_dir)), 9).withColumn("coverage", F.round("coverage", 2))


@query(RUNS_SQL + ", m as (select n, coverage, estimator, median(se) as s from runs1 group by 1, 2, 3) select n, round(coverage, 2) as coverage, estimator, round(s, 9) as median_se, rank() over (partition by n, coverage order by s) + (count(*) over (partition by n, coverage, s) - 1) / 2.0 as rank from m")
def a21_scenario_ranks(spark, sf_dir):
    return rounded(reporting.scenario_ranks(first(spark, sf_dir)), 9).withColumn("coverage", F.round("coverage", 2))


@query(RUNS_SQL + ", w as (select estimator, seed, n, coverage, policy, max(case when toggle then est end) as a, max(case when not toggle then est end) as b from runs1 group by 1, 2, 3, 4, 5) select estimator, round(max(abs(a - b)), 9) as largest from w group by 1")
def a14_toggle_sensitivity(spark, sf_dir):
    return rounded(reporting.toggle_sensitivity(first(spark, sf_dir)), 9)


@query(RUNS_SQL + " select estimator, round(avg(case when coalesce(gate, false) then 1.0 else 0.0 end) * 100, 6) as rate from runs1 group by 1")
def a8_gate_rates(spark, sf_dir):
    return rounded(reporting.gate_rates(first(spark, sf_dir)))


@query(RUNS_SQL + ", t as (select estimator || '-' || policy as label, avg((event * 7919) % 1000) / 20000.0 as p from (select *, run_id as event from runs1) group by 1), r as (select *, row_number() over (order by p, label) as rank, count(*) over () as n from t) select label, round(p, 9) as p, rank, round(min(least(1.0, p * n / rank)) over (order by p, label rows between current row and unbounded following), 9) as adjusted from r")
def d21_false_discovery(spark, sf_dir):
    tests = first(spark, sf_dir).groupBy(F.concat_ws("-", "estimator", "policy").alias("label")).agg((F.avg((F.col("run_id") * 7919) % 1000) / 20000).alias("p"))
    return rounded(reporting.benjamini_hochberg(tests).select("label", "p", "rank", "adjusted"), 9)


@query(RUNS_SQL + ", d as (select a.estimator, round(a.se - b.se, 9) as delta from runs1 a join runs1 b on a.estimator = b.estimator and a.seed = b.seed and a.n = b.n and a.coverage = b.coverage and a.policy = b.policy where a.toggle and not b.toggle), r as (select estimator, delta, rank() over (partition by estimator order by abs(delta)) + (count(*) over (partition by estimator, abs(delta)) - 1) / 2.0 as r from d where delta <> 0) select estimator, count(*) as n, round(sum(case when delta > 0 then r else 0 end), 6) as w_plus from r group by 1")
def a17_wilcoxon(spark, sf_dir):
    d = reporting.paired_delta(first(spark, sf_dir)).withColumn("delta", F.round("delta", 9))
    return rounded(reporting.wilcoxon(d).select("estimator", "n", "w_plus"))


@query("with p as (select concat('p', cast(l_linenumber % 2 as varchar(2))) as policy, l_orderkey as prompt_id, l_discount * 10 as value from lineitem ), b as (select policy, prompt_id, avg(value) as m, var_pop(value) as v, count(value) as c from p group by 1, 2) select policy, round(var_pop(m), 9) as between, round(avg(v), 9) as within, round(var_pop(m) / (var_pop(m) + avg(v)), 9) as share from b where c = 3 group by 1")
def d35_variance_decomposition(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("p"), (F.col("l_linenumber") % 2).cast("string")).alias("policy"), F.col("l_orderkey").alias("prompt_id"), (F.col("l_discount") * 10).alias("value"))
    return rounded(reporting.variance_decomposition(p, 3), 9)


@query(SQL + " select count(*) as n from (select distinct prompt_id from logged where ('0x' || substr(md5('11-' || prompt_id), 1, 8))::bigint < 4294967296 // 3) a where prompt_id in (select prompt_id from fresh)")
def j6_sampled_prompts_semi_join(spark, sf_dir):
    """A seeded third of the prompts, as far as they have draws of any policy: a sample is what this operator is for."""
    sampled = bridge.logged(spark, sf_dir).select("prompt_id").distinct().where(F.conv(F.substring(F.md5(F.concat(F.lit("11-"), "prompt_id")), 1, 8), 16, 10).cast("long") < (1 << 32) // 3)
    return sampled.join(bridge.fresh(spark, sf_dir), "prompt_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("with t as (select conv_id, turn, role, trim(coalesce(text, '')) as text, max(turn) over (partition by conv_id) as last from conversations), l as (select conv_id from t where turn = last and role = 'assistant') select conv_id, md5(coalesce(string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || text || '<|eot_id|>', '' order by turn) filter (where turn < last), '') || '<|start_header_id|>assistant<|end_header_id|>' || chr(10)) as prefix, md5(string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || text || '<|eot_id|>', '' order by turn)) as full_ from t where conv_id in (select conv_id from l) group by conv_id")
def t1_chat_completions(spark, sf_dir):
    from ..functions.chat import completions

    return completions(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", F.md5("prefix").alias("prefix"), F.md5("full").alias("full_"))


@query(SQL + ", n as (select policy, row_id, w, row_number() over (partition by policy order by round(w, 9) desc, row_id) as rn, row_number() over (partition by policy order by round(w, 9), row_id) as rl from w), e as (select policy, row_id, w, 'top' as side, rn from n where rn <= 5 union all select policy, row_id, w, 'bottom', rl from n where rl <= 5) select policy, row_id, side, round(w, 6) as w, rn, count(*) over (partition by row_id, side) as policies from e")
def d32_extreme_weights(spark, sf_dir):
    """The five largest and smallest weights of each policy, and in how many policies' lists a row stands: a top-k report."""
    return rounded(diagnostics.extremes(weighted(spark, sf_dir).withColumn("w", F.round("w", 9)), 5))


@query(SQL + " select policy, count(*) filter (where w >= 100) as n_large, count(*) filter (where w < 1e-10) as n_tiny, count(*) as n from w group by policy")
def d32_extreme_counts(spark, sf_dir):
    return weighted(spark, sf_dir).groupBy("policy").agg(F.count_if(F.col("w") >= 100).alias("n_large"), F.count_if(F.col("w") < 1e-10).alias("n_tiny"), F.count(F.lit(1)).alias("n"))


RUNTIME = "(run_id * 17 % 91) / 10.0"


@query(RUNS_SQL + f", r as (select run_id, estimator, min({RUNTIME}) as v from runs group by 1, 2) select estimator, round(median(v), 6) as median, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std from r group by 1")
def a7_runtime(spark, sf_dir):
    return rounded(reporting.run_level(runs(spark, sf_dir).withColumn("runtime", (F.col("run_id") * 17 % 91) / 10), "estimator"))


def _spread(values: dict[str, float]) -> str:
    return ", ".join(f"round({f}({v}) * {x}, 6) as {v}_{n}" for v, x in values.items() for f, n in (("avg", "mean"), ("median", "median"), ("min", "min"), ("max", "max")))


@query(RUNS_SQL + ", o as (select estimator, n, (event_id * 29 % 100) / 100.0 as ess, 1.0 + (event_id * 7 % 50) / 10.0 as alpha from (select *, run_id as event_id from runs1)) select estimator, n, " + _spread({"ess": 100, "alpha": 1}) + " from o group by 1, 2")
def a10_overlap_by_regime(spark, sf_dir):
    own = first(spark, sf_dir).withColumn("ess", (F.col("run_id") * 29 % 100) / 100).withColumn("alpha", 1 + (F.col("run_id") * 7 % 50) / 10)
    return rounded(reporting.spread_of(own, {"ess": 100, "alpha": 1}, "estimator", "n"))


@query(RUNS_SQL + ", o as (select estimator, case when run_id % 3 = 0 then null else (run_id * 31 % 100) / 100.0 end as mc from runs1) select estimator, " + _spread({"mc": 100}) + " from o group by 1")
def a11_draw_share(spark, sf_dir):
    own = first(spark, sf_dir).withColumn("mc", F.when(F.col("run_id") % 3 != 0, (F.col("run_id") * 31 % 100) / 100))
    return rounded(reporting.spread_of(own, {"mc": 100}, "estimator"))


@query(RUNS_SQL + ", s as (select estimator, seed, avg(abs(est - truth)) as mae, avg(se) as se from runs1 group by 1, 2), l as (select estimator, 'mae' as metric, mae as v from s union all select estimator, 'se', se from s) select estimator, metric, round(avg(v), 9) as mean, round(stddev_samp(v) / sqrt(count(v)), 9) as se, count(v) as n from l group by 1, 2")
def a13_across_seeds(spark, sf_dir):
    by_seed = first(spark, sf_dir).groupBy("estimator", "seed").agg(F.avg(F.abs(F.col("est") - F.col("truth"))).alias("mae"), F.avg("se").alias("se"))
    return rounded(reporting.seed_summary(by_seed, ["mae", "se"], "estimator"), 9)


@query(RUNS_SQL + " select policy, round(avg(abs(est - truth)), 6) as mae, round(avg(abs(est - truth) / abs(truth)), 6) as relative, round(avg(case when truth between lo and hi then 1.0 else 0.0 end) * 100, 6) as coverage, count(*) as n from runs1 group by 1")
def d37_truth_comparison(spark, sf_dir):
    return rounded(reporting.truth_comparison(first(spark, sf_dir), "policy"))


@query(RUNS_SQL + ", d as (select est, case when run_id % 5 = 0 then null else se end as se, truth from runs1), f as (select unnest(['est', 'se', 'truth']) as f), c as (select corr(est, est) as est_est, corr(est, se) as est_se, corr(est, truth) as est_truth, corr(se, se) as se_se, corr(se, truth) as se_truth, corr(truth, truth) as truth_truth from d) select a.f as a, b.f as b, round(case least(a.f, b.f) || '_' || greatest(a.f, b.f) when 'est_est' then est_est when 'est_se' then est_se when 'est_truth' then est_truth when 'se_se' then se_se when 'se_truth' then se_truth else truth_truth end, 6) as r from f a cross join f b cross join c")
def d33_correlations(spark, sf_dir):
    own = first(spark, sf_dir).select("est", F.when(F.col("run_id") % 5 != 0, F.col("se")).alias("se"), "truth")
    return rounded(reporting.correlations(own, ["est", "se", "truth"]))


SHIP = "case when event_id % 11 = 0 then null else (event_id * 7 % 100) / 100.0 end as affinity, (event_id * 13 % 100) / 100.0 as ess_fraction, (event_id * 17 % 40) / 10.0 as alpha, (event_id * 19 % 50) / 100.0 as floor_logged, case when event_id % 3 = 0 then null else (event_id * 23 % 40) / 100.0 end as floor_fresh"


@query(f"with d as (select {SHIP} from events) select count(*) filter (where coalesce(affinity, 0) < 0.2 or coalesce(ess_fraction, 0) < 0.05) as low_overlap, count(*) filter (where alpha <> 0 and alpha < 1) as heavy_tail, count(*) filter (where coalesce(floor_logged, 0) >= 0.25 or coalesce(floor_fresh, 0) >= 0.25) as cal_floor from d")
def d33_ship_gates(spark, sf_dir):
    return reporting.ship_gates(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[x.strip() for x in bridge._parts(SHIP)]))


PASSES = "concat('p', cast(l_suppkey % 3 as varchar(2))) as policy, l_orderkey as prompt_id, case when l_linenumber = 3 then null when l_linenumber = 5 then 1.0e0 else -1.0e0 * l_quantity - l_linenumber end as logprob"


@query(f"with p as (select {PASSES} from lineitem) select policy, prompt_id, round(avg(logprob) filter (where logprob <= 0), 6) as mean, round(median(logprob) filter (where logprob <= 0), 6) as median, count(*) filter (where logprob <= 0) as n from p group by 1, 2")
def d36_pass_aggregation(spark, sf_dir):
    return rounded(reporting.pass_values(spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[x.strip() for x in bridge._parts(PASSES)])))


@query(f"with p as (select {PASSES} from lineitem), v as (select policy, prompt_id, avg(logprob) filter (where logprob <= 0) as v from p group by 1, 2), w as (select prompt_id, max(case when policy = 'p0' then v end) as base_lp, max(case when policy = 'p1' then v end) as lp1, max(case when policy = 'p2' then v end) as lp2 from v group by 1) select prompt_id, round(base_lp, 6) as base_lp, round(lp1, 6) as lp1, round(lp2, 6) as lp2, o_totalprice as judge_score from w left join orders on o_orderkey = prompt_id where base_lp is not null and (lp1 is not null or lp2 is not null)")
def j5_assembled_dataset(spark, sf_dir):
    """Passes of policies to a row a prompt, with the map of target policies; scores joined by key."""
    from ..operators.assembly import assemble

    passes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[x.strip() for x in bridge._parts(PASSES)])
    scores = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("prompt_id"), F.col("o_totalprice").alias("judge_score"))
    out = assemble(passes, "p0", scores)
    return out.select("prompt_id", F.round("base_lp", 6).alias("base_lp"), *[F.round(F.col("target_lps")[f"p{i}"], 6).alias(f"lp{i}") for i in (1, 2)], "judge_score")


@query(RUNS_SQL + ", m as (select n, round(coverage, 2) as coverage, avg(se) as s from runs1 group by n, round(coverage, 2)) select n, coverage, round(s, 9) as mean_se, round((1.96 + 0.84) * sqrt(2) * s, 9) as mde, round(n * (1 + 16 * coverage), 6) as cost from m order by (1.96 + 0.84) * sqrt(2) * s * sqrt(n * (1 + 16 * coverage)), n, coverage limit 5")
def a20_sweet_spots(spark, sf_dir):
    """The five regimes that give most for their cost: a top-k report."""
    out = reporting.sweet_spots(first(spark, sf_dir).withColumn("coverage", F.round("coverage", 2)))
    return out.select("n", "coverage", F.round("mean_se", 9).alias("mean_se"), F.round("mde", 9).alias("mde"), F.round("cost", 6).alias("cost"))


@query(RUNS_SQL + " select a.run_id, round(sum(sign(a.est - b.est) * sign(a.truth - b.truth)) / sqrt(sum(abs(sign(a.est - b.est))) * sum(abs(sign(a.truth - b.truth)))), 6) as tau from runs1 a join runs1 b on a.run_id = b.run_id and a.policy < b.policy group by 1")
def a6_kendall_of_runs(spark, sf_dir):
    return rounded(reporting.kendall_of_runs(first(spark, sf_dir)))


@query(RUNS_SQL + ", l as (select estimator, avg(se) as se from runs1 where seed < 5 group by 1), r as (select policy as estimator, avg(est) as est from runs1 group by 1 union all select estimator, avg(est) from runs1 where seed > 7 group by 1) select estimator, round(se, 9) as se, round(est, 9) as est from l full join r using (estimator)")
def j2_outer_join_of_metrics(spark, sf_dir):
    own = first(spark, sf_dir)
    right = own.groupBy(F.col("policy").alias("estimator")).agg(F.avg("est").alias("est")).union(own.where("seed > 7").groupBy("estimator").agg(F.avg("est").alias("est")))
    return rounded(reporting.joined_metrics(own.where("seed < 5").groupBy("estimator").agg(F.avg("se").alias("se")), right, ("estimator",)), 9)


@query()
def is7_ridge_outcome(spark, sf_dir):
    """Quality of documents from the words of their language's name and text and a score of their length; cross-fitted."""
    from ..operators import estimators, outcomes

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rows = docs.withColumn("fold", estimators.fold_of(F.col("doc_id").cast("string"))).withColumn("y", F.col("quality").cast("double"))
    x = outcomes.features(F.col("lang"), F.col("text"), F.col("n_chars") / (F.col("n_chars") + 2000.0))
    return rounded(outcomes.ridge_predict(rows, outcomes.ridge(rows, "y", x), x).select("doc_id", "g"))
