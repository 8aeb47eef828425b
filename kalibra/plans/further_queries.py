"""Calibration modes, projections, further estimators, result scans and report tables over the bridge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration, diagnostics, estimators, reporting
from ..operators.tables import scratch, written
from ..sources import results
from . import bridge
from .bridge import SQL
from .oracle_sql import IPS, OUTCOMES, WEIGHTS, errors, iso, pred, summary
from .queries import LABEL_CHANCE, MEAN_WEIGHT, RANKED, calibrated, outcomes, query, rounded, weighted
from .report_queries import RUNS_SQL, first


def folded(spark, sf_dir):
    return bridge.logged(spark, sf_dir).withColumn("fold", estimators.fold_of(F.col("prompt_id")))


@query()
def c4_two_stage_rewards(spark, sf_dir):
    """A judge that is not monotone may be used: labels rise with the ranks of a smooth fit."""
    rows = folded(spark, sf_dir)
    return rounded(calibration.apply(rows, calibration.fit(rows, "two_stage")).select("row_id", "reward", "reward_oof"), 5)


@query()
def c5_calibration_mode(spark, sf_dir):
    won = calibration.fit(folded(spark, sf_dir), "auto")
    return rounded(spark.createDataFrame([(won.mode, *(float(won.choice[c]) for c in ("rmse_monotone", "rmse_two_stage", "se")), int(won.choice["better_thirds"]))], "mode string, rmse_monotone double, rmse_two_stage double, se double, better_thirds int"))


@query()
def c6_calibration_index(spark, sf_dir):
    rows = folded(spark, sf_dir)
    return rounded(calibration.ranks(rows, rows, calibration.fit(rows, "two_stage")), 6)


@query(SQL + ", " + iso("wi", "select policy as k, judge_score as x, w as y, 1.0 as w from w") + ", j as (select w.policy, w.row_id, w.w, greatest(wi.y, 0) as c from w join wi on wi.k = w.policy and wi.x = w.judge_score), m as (select policy, var_pop(w) as vr, var_pop(c) as vc, covar_pop(w, c) as cv from j group by 1), a as (select *, 0.4 * vr as cap, vr + vc - 2 * cv as vd, cv - vr as b from m), l as (select *, greatest(0, least(1, -b / vd)) as low from a), f as (select *, case when vc <= cap * 1.001 then 1.0 when vd <= 1e-12 then 0.0 when vr + 2 * low * b + low * low * vd > cap * 1.001 then low else greatest(0, least(1, (-b + sqrt(greatest(b * b - vd * (vr - cap), 0))) / (vd + 1e-12))) end as alpha from l) select policy, row_id, round(2 * ((1 - alpha) * w + alpha * c) / avg((1 - alpha) * w + alpha * c) over (partition by policy), 6) as w_to from j join f using (policy)")
def w9_weights_to_a_mean(spark, sf_dir):
    return rounded(estimators.to_mean(weighted(spark, sf_dir), "judge_score", 2.0, 0.4)[0].select("policy", "row_id", "w_to"))


HONEST = f""", hl as (select policy, o, judge_score as x, count(*) * 1.0 as n, sum(w_cal * reward_oof) as a, sum(w_cal) as b from wcal group by 1, 2, 3), hp as (select policy || '-' || o as k, any_value(psi_train) as psi, any_value(w_train) as mw, count(*) as served from wcal group by 1),
hc as (select policy || '-' || f.k as k, x, n, a, b from hl cross join (select unnest([0, 1, 2, 3, 4]) as k) f where o <> f.k),
{iso('hi', "select k, x, (a - 2 * psi * b + psi * mw * n) / mw / n as y, n as w from hc join hp using (k)")},
hr as (select p.k, judge_score as x, (w_cal * (reward_oof - psi) - psi * (w_cal - mw)) / mw as phi, hi.y as h, served from wcal s cross join (select unnest([0, 1, 2, 3, 4]) as k) f join hp p on p.k = policy || '-' || f.k join hi on hi.k = p.k and hi.x = judge_score where o <> f.k),
hf as (select k, greatest(0, 1 - var_samp(phi - h) / var_samp(phi)) as r2, greatest(0, 1 - var_samp(phi - h) / var_samp(phi)) >= 0.02 and count(*) >= 30 and count(distinct x) >= 8 and any_value(served) >= 5 as applied from hr group by k),
{pred('hq', 'hi', "select policy || '-' || o as k, judge_score as x from wcal")},
hx as (select s.policy, s.row_id, s.o as fold, w_cal * reward as c, (w_cal * (reward_oof - psi_train) - psi_train * (w_cal - w_train)) / w_train - case when applied then coalesce(q.y, 0) else 0 end as p from wcal s join hf on hf.k = policy || '-' || o left join hq q on q.k = hf.k and q.x = judge_score),
hn as (select policy, row_id, fold, c, p - avg(p) over (partition by policy) as phi from hx)"""


@query(WEIGHTS + HONEST + ", " + errors("hn") + " select policy, n, round(estimate, 6) as estimate, round(se_naive, 6) as se_naive, round(se_cluster, 6) as se_cluster, groups from est")
def e2b_honest_ips(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.honest_ips(written(calibrated(spark, sf_dir), "calibrated"))[0]))


@query(WEIGHTS + HONEST + " select k as fit, round(r2, 6) as r2, applied from hf")
def e2b_explained_influence(spark, sf_dir):
    fits = estimators.honest_ips(written(calibrated(spark, sf_dir), "calibrated"))[1]
    return rounded(fits.select(F.concat_ws("-", "policy", "outer").alias("fit"), "r2", "applied"))


PI = "(select orth.*, greatest(0.001, least(0.999, pl.y)) as pi from orth join pl on pl.k = policy || '-' || fold and pl.x = judge_score)"
LABEL_PART = "case when oracle_label is null then 0 else m * (oracle_label - reward) / pi end"


@query(OUTCOMES + MEAN_WEIGHT + LABEL_CHANCE + ", " + summary(PI, f"q + w * (reward - g) + {LABEL_PART} + (w - m) * (reward - reward_oof)"))
def e8a_orthogonalised_tr(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.tr_cpo(outcomes(spark, sf_dir), orthogonalised=True)))


@query(OUTCOMES + " select policy, round(avg(w_cal * (reward - g)), 6) as anchor, round(avg((w - w_cal) * (reward - g)), 6) as retarget from dr group by 1")
def e8a_anchored_parts(spark, sf_dir):
    return rounded(estimators.tr_cpo(outcomes(spark, sf_dir), anchored=True).groupBy("policy").agg(F.avg("anchor").alias("anchor"), F.avg("retarget").alias("retarget")))


@query(RANKED + ", top as (select policy, k, sum(case when rn <= k then ln(w) end) - k * max(case when rn = k + 1 then ln(w) end) as excess from (select *, least(greatest(10, floor(n * 0.05)), floor(n * 0.1)) as k from ranked) where rn <= k + 1 group by 1, 2), t as (select policy, sum(w) as s, count(*) as c from w group by 1) select policy, count(*) as n, round(sum(w) * sum(w) / sum(w * w), 4) as ess_absolute, round(100 * sum(w) * sum(w) / sum(w * w) / count(*), 6) as ess_relative, round(any_value(k / excess), 6) as alpha, round(stddev_pop(w) / avg(w), 6) as cv, round(max(w / s), 9) as max_share, round(avg(case when w / s < 1 / (10 * c) then 1.0 else 0.0 end), 6) as near_zero from w join t using (policy) join top using (policy) group by policy")
def a26_run_diagnostics(spark, sf_dir):
    out = diagnostics.run_diagnostics(written(weighted(spark, sf_dir), "weights"))
    return out.select("policy", "n", *[F.round(c, {"ess_absolute": 4, "max_share": 9}.get(c, 6)).alias(c) for c in ("ess_absolute", "ess_relative", "alpha", "cv", "max_share", "near_zero")])


@query(SQL + f""", s as (select judge_score as v, row_number() over (order by row_id) - 1 as pos, greatest(50, count(*) over () // 10) as size, count(*) over () as n from logged where judge_score is not null), sb as (select pos // size as batch, pos % size as place, v from s where pos < n // size * size),
sp as (select p.batch, p.place, p.v as x, q.v as y from sb p join sb q on p.batch + 1 = q.batch and p.place = q.place), sc as (select batch, x, y, count(*) as c from sp group by all),
l as (select judge_score as x, oracle_label as y, row_number() over (order by row_id) - 1 as pos, greatest(10, count(*) over () // 10) as size, count(*) over () as n from logged where judge_score is not null and oracle_label is not null), lc as (select pos // size as batch, x, y, count(*) as c from l where pos < n // size * size group by all), oc as (select -1 as batch, x, y, count(*) as c from l group by all),
tau as (select kind, a.batch, sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(a.c * b.c * abs(sign(a.x - b.x))) * sum(a.c * b.c * abs(sign(a.y - b.y)))) as tau from (select 'drift' as kind, * from sc union all select 'batch', * from lc union all select 'overall', * from oc) a join (select 'drift' as kind, * from sc union all select 'batch', * from lc union all select 'overall', * from oc) b using (kind, batch) group by 1, 2),
num as (select kind, batch, sum(c) as n from (select 'drift' as kind, * from sc union all select 'batch', * from lc union all select 'overall', * from oc) group by 1, 2)
select kind, cast(batch as bigint) as batch, cast(n as bigint) as n, round(tau, 6) as tau from tau join num using (kind, batch) union all select 'spread', -1, count(tau), round(stddev_pop(tau), 6) from tau where kind = 'batch'""")
def d27_stability(spark, sf_dir):
    return rounded(diagnostics.stability(bridge.logged(spark, sf_dir)))


@query(IPS + ", " + errors("ips") + ", e as (select policy, sum(w) * sum(w) / sum(w * w) / count(*) as e from w group by 1) select policy, round(estimate, 6) as estimate, round(e, 6) as ess_fraction, 0 as n_issues from est join e using (policy)")
def d11_records(spark, sf_dir):
    rows = calibrated(spark, sf_dir)
    est = estimators.cluster_robust(estimators.calibrated_ips(rows)).withColumnRenamed("se_cluster", "se")
    out = diagnostics.records(diagnostics.weight_diagnostics(written(weighted(spark, sf_dir), "weights")), est)
    return rounded(out.select("policy", "estimate", "ess_fraction", F.size("issues").alias("n_issues")))


@query(OUTCOMES + " , d as (select policy, avg(q + w_cal * (reward - g)) as est, 1 - sum((reward - g) * (reward - g)) / greatest(var_pop(reward) * count(*), 1e-12) as r2, corr(q, w_cal * (reward - g)) as c from dr group by 1) select count(*) as policies, round(min(est), 6) as least, round(max(est), 6) as most, round(min(r2), 5) as worst_r2, round(avg(c), 6) as correlation from d")
def v5_dr_summary(spark, sf_dir):
    out = diagnostics.dr_summary(diagnostics.dr_diagnostics(outcomes(spark, sf_dir)))
    return out.select("policies", *[F.round(c, 5 if c == "worst_r2" else 6).alias(c) for c in ("least", "most", "worst_r2", "correlation")])


@query(RUNS_SQL + ", p as (select policy, avg(est) as estimate, avg(lo) as lo, avg(hi) as hi, avg(truth) as truth from runs1 group by 1), t as (select policy, case when policy <> 'p3' then truth end as truth from p) select policy, round(estimate, 6) as estimate, round(t.truth, 6) as truth, case when t.truth between lo and hi then 1 when t.truth is not null then 0 end as inside, round((select sqrt(avg(power(p.estimate - t.truth, 2))) from p join t using (policy)), 6) as rmse from p join t using (policy)")
def v6_forest(spark, sf_dir):
    p = first(spark, sf_dir).groupBy("policy").agg(F.avg("est").alias("estimate"), F.avg("lo").alias("lo"), F.avg("hi").alias("hi"), F.avg("truth").alias("truth"))
    return rounded(reporting.forest(p, p.where("policy <> 'p3'")).select("policy", "estimate", "truth", F.col("inside").cast("int").alias("inside"), "rmse"))


RANKS_SQL = ", pr as (select a.run_id, avg(case when sign(a.est - b.est) = sign(a.truth - b.truth) then 1.0 else 0.0 end) as pairwise, sum(sign(a.est - b.est) * sign(a.truth - b.truth)) / sqrt(nullif(sum(abs(sign(a.est - b.est))) * sum(abs(sign(a.truth - b.truth))), 0)) as tau from runs1 a join runs1 b on a.run_id = b.run_id and a.policy < b.policy group by 1), tp as (select run_id, {keys}, max(truth) - arg_max(truth, est) as regret from runs1 group by all), ra as (select {keys}, avg(pairwise) * 100 as pairwise, avg(case when regret <= 0 then 1.0 else 0.0 end) * 100 as top1, avg(tau) as tau, avg(regret) as regret from tp left join pr using (run_id) group by all)"
M1 = "round(sqrt(avg(greatest(0, (est - truth) * (est - truth) - oracle_var))), 6) as rmse_d, round(exp(avg(ln(se))), 6) as se_geomean, round(any_value(pairwise), 6) as pairwise, round(any_value(top1), 6) as top1, round(any_value(tau), 6) as tau, round(any_value(regret), 6) as regret"


@query(RUNS_SQL + RANKS_SQL.replace("{keys}", "estimator, n, coverage") + f" select estimator, n, round(coverage, 2) as coverage, {M1} from runs1 join ra using (estimator, n, coverage) group by estimator, n, coverage")
def a23_accuracy_by_regime(spark, sf_dir):
    out = reporting.accuracy_table(first(spark, sf_dir), "estimator", "n", "coverage")
    return rounded(out.select("estimator", "n", F.round("coverage", 2).alias("coverage"), "rmse_d", "se_geomean", "pairwise", "top1", "tau", "regret"))


QUADRANTS = {"small, few labels": ([250], [0.05, 0.1]), "small, many labels": ([250], [0.15, 0.2]), "large, few labels": ([500, 750], [0.05, 0.1]), "large, many labels": ([500, 750], [0.15, 0.2])}


@query(RUNS_SQL.replace("runs1 as (select *", "runs1 as (select *, case when n = 250 then 'small' else 'large' end || case when coverage < 0.12 then ', few labels' else ', many labels' end as quadrant") + RANKS_SQL.replace("{keys}", "quadrant, estimator") + f" select quadrant, estimator, {M1} from runs1 join ra using (quadrant, estimator) group by quadrant, estimator")
def a23_quadrants(spark, sf_dir):
    out = reporting.quadrant_table(first(spark, sf_dir), QUADRANTS)
    return rounded(out.select("quadrant", "estimator", "rmse_d", "se_geomean", "pairwise", "top1", "tau", "regret"))


@query(RUNS_SQL + " select estimator, n, round(coverage, 2) as coverage, seed, round(avg(case when truth between lo and hi then 1.0 else 0.0 end) * 100, 6) as covered, round(avg(hi - lo), 6) as width from runs1 group by estimator, n, coverage, seed")
def a23_coverage_and_width(spark, sf_dir):
    return rounded(reporting.coverage_and_width(first(spark, sf_dir))).withColumn("coverage", F.round("coverage", 2))


@query(RUNS_SQL + " select estimator, round(avg(case when coalesce(gate, false) then 1.0 else 0.0 end) * 100, 6) as gate_rate, round(avg(case when est < 0.5 then 1.0 else 0.0 end) * 100, 6) as refuse_rate from runs1 group by 1")
def a24_refusals(spark, sf_dir):
    return rounded(reporting.gates_table(first(spark, sf_dir).withColumn("refused", F.col("est") < 0.5), ["gate"], "refused", "estimator"))


@query(RUNS_SQL + " select estimator, n, round(coverage, 2) as coverage, round(median(1 - se) filter (where not toggle), 6) as without, round(median(1 - se) filter (where toggle), 6) as with_, round(median(1 - se) filter (where toggle) / median(1 - se) filter (where not toggle), 6) as ratio from runs1 group by estimator, n, coverage")
def a24_effective_shares(spark, sf_dir):
    return rounded(reporting.ess_comparison(first(spark, sf_dir).withColumn("ess", 1 - F.col("se")))).withColumn("coverage", F.round("coverage", 2))


@query(RUNS_SQL + " select 'run ' || run_id as run_id, policy, case when estimator = 'est0' then case when toggle then 'calibrated-dr-cpo' else 'dr-cpo' end else estimator end as estimator, seed, n, round(coverage, 2) as coverage, round(est, 9) as est, round(truth, 9) as truth, round(lo, 9) as lo, round(hi, 9) as hi, round(least(truth * (1 - truth), 0.25) / 4989, 12) as oracle_var, 1 - se >= 0.97 as gate_overlap from runs1 where run_id % 5 <> 4")
def sc11_experiment_results(spark, sf_dir):
    """Runs go out as JSON lines, one a run with maps by policy, every fifth without success, and come back a row a run and policy."""
    own = first(spark, sf_dir)
    by = lambda c: F.map_from_entries(F.collect_list(F.struct("policy", c)))
    own = own.withColumn("ci", F.array("hi", "lo")).withColumn("estimator", F.when(F.col("estimator") == "est0", "dr-cpo").otherwise(F.col("estimator"))).withColumn("ess", (1 - F.col("se") - 0.97) + 0.1 + 1e-12)
    lines = own.groupBy("run_id", "estimator", "seed", "n", "coverage", "toggle").agg(by("est").alias("estimates"), by("truth").alias("oracle_truths"), by("se").alias("standard_errors"), by("ci").alias("confidence_intervals"), by("ess").alias("ess_relative"))
    spec = F.struct(F.col("seed").alias("seed_base"), F.col("n").alias("sample_size"), F.col("coverage").alias("oracle_coverage"), "estimator", F.struct(F.col("toggle").alias("use_weight_calibration")).alias("extra"))
    path = scratch(spark, "experiments")
    results.write_jsonl(lines.select(F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("run_id"), (F.col("run_id") % 5 != 4).alias("success"), spec.alias("spec"), "estimates", "oracle_truths", "standard_errors", "confidence_intervals", "ess_relative"), path)
    back = results.read_experiments(spark, path)
    return back.select("run_id", "policy", "estimator", "seed", "n", F.round("coverage", 2).alias("coverage"), *[F.round(c, 9).alias(c) for c in ("est", "truth", "lo", "hi")], F.round("oracle_var", 12).alias("oracle_var"), "gate_overlap")


@query(RUNS_SQL + " select 'm' || run_id as method, policy, round(est, 9) as estimate, round(se, 9) as standard_error, 250 as n_samples, round(1 - se, 9) as ess_fraction, 0.5 as hellinger_affinity from runs1")
def sc12_analysis_results(spark, sf_dir):
    """A record a run goes out as JSON files and comes back a row a record and policy, by way of the aggregate CSV."""
    by = lambda c: F.map_from_entries(F.collect_list(F.struct("policy", c)))
    result = F.struct(F.col("est").alias("estimate"), F.col("se").alias("standard_error"), F.lit(250).alias("n_samples"))
    own = first(spark, sf_dir).withColumn("result", result).withColumn("ess", 1 - F.col("se"))
    records = own.groupBy("run_id").agg(F.concat(F.lit("m"), F.first("run_id").cast("string")).alias("method"), by("result").alias("per_policy_results"), F.struct(by("ess").alias("ess_per_policy"), F.lit(0.5).alias("hellinger_affinity")).alias("diagnostics"))
    path, csv = scratch(spark, "analyses"), scratch(spark, "aggregate")
    records.drop("run_id").repartition(F.col("method")).write.json(path)
    results.write_aggregate(results.read_analyses(spark, path, one_a_file=False), csv)
    back = results.read_csv(spark, csv, ("estimate", "standard_error", "n_samples", "ess_fraction", "hellinger_affinity"))
    return back.select("method", "policy", *[F.round(c, 9).alias(c) for c in ("estimate", "standard_error")], F.col("n_samples").cast("int").alias("n_samples"), F.round("ess_fraction", 9).alias("ess_fraction"), "hellinger_affinity")


@query(IPS + ", " + errors("ips") + ", b as (select avg(judge_score) as v, stddev_samp(judge_score) / sqrt(count(*)) as s from logged), e as (select policy, estimate, se_cluster as s from est) select 'base' as policy, round(v, 6) as estimate, round(s, 6) as standard_error, round(v - 1.959963984540054 * s, 6) as ci_lower, false as is_best from b union all select policy, round(estimate, 6), round(s, 6), round(estimate - 2 * s, 6), estimate = max(estimate) over () from e")
def sk6_export(spark, sf_dir):
    est = estimators.cluster_robust(estimators.calibrated_ips(calibrated(spark, sf_dir))).withColumn("se", F.col("se_cluster"))
    est = est.withColumn("lo", F.col("estimate") - 2 * F.col("se")).withColumn("hi", F.col("estimate") + 2 * F.col("se"))
    out = results.exported(est, bridge.logged(spark, sf_dir).select(F.col("judge_score").alias("reward")))
    return rounded(out.select("policy", "estimate", "standard_error", "ci_lower", "is_best"))
