"""Errors put together, intervals, comparisons, bootstraps and further diagnostics over the bridge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, diagnostics, estimators, inference
from . import bridge
from .bridge import SQL
from .oracle_sql import CALIBRATED, FOLD, IPS, OUTCOMES, WEIGHTS, errors, pred, two_sided
from .queries import HILL, calibrated, models, outcomes, query, rounded, scored, weighted

#: Quantiles of Student's t (4 degrees of freedom, 0.975) and of the normal distribution (0.975; 0.9875).
T4, Z, Z2 = 2.7764451051977987, 1.959963984540054, 2.241402727604947

#: The jackknife over fold models of the doubly robust value: CTE jack(policy, oracle_var).
JACK = f""", {pred('pjf', 'mk', 'select f.k, judge_score as x from fresh cross join (select unnest([0, 1, 2, 3, 4]) as k) f')}, {pred('pjl', 'mk', 'select f.k, judge_score as x from logged cross join (select unnest([0, 1, 2, 3, 4]) as k) f')},
jq as (select policy, prompt_id, p.k, avg(greatest(0.0, least(1.0, p.y))) as q from fresh join pjf p on p.x = judge_score where (policy, prompt_id) in (select policy, prompt_id from dr) group by 1, 2, 3),
jm as (select policy, k, avg(q) as dm from jq group by 1, 2), jr as (select policy, p.k, avg(w_cal * (greatest(0.0, least(1.0, p.y)) - g)) as rest from dr join pjl p on p.x = judge_score group by 1, 2),
jack as (select policy, 0.8 * greatest(sum((dm + rest) * (dm + rest)) - 5 * avg(dm + rest) * avg(dm + rest), 0.0) as oracle_var from jm join jr using (policy, k) group by 1)"""
DRAWS = ", mc as (select policy, (coalesce(sum(case when draws > 1 then draw_var / draws end), 0) + least(coalesce(var_samp(q), 0.25), 0.25) * count(*) filter (where draws <= 1)) / (count(*) * count(*)) as mc from dr group by policy)"
DR = ", dc as (select policy, row_id, fold, o, c, c - avg(c) over (partition by policy) as phi from (select *, q + w_cal * (reward - g) as c from dr)), " + errors("dc")


@query(OUTCOMES + JACK + DRAWS + DR + f" select policy, n, round(estimate, 6) as estimate, round(se_naive, 6) as se_naive, groups, round(se_cluster, 6) as se_cluster, round(oracle_var, 9) as oracle_var, round(mc, 9) as draw_var, round(sqrt(se_cluster * se_cluster + oracle_var + mc), 6) as se, round(estimate - {T4} * sqrt(se_cluster * se_cluster + oracle_var + mc), 6) as lo, round(estimate + {T4} * sqrt(se_cluster * se_cluster + oracle_var + mc), 6) as hi from est join jack using (policy) join mc using (policy)")
def d18_dr_with_intervals(spark, sf_dir):
    """analyze_tables() of the log and its draws."""
    out = analysis.analyze_tables(bridge.logged(spark, sf_dir), bridge.fresh(spark, sf_dir), "dr-cpo", mode="monotone")
    return out.select("policy", "n", "groups", *[F.round(c, 9 if c.endswith("var") else 6).alias(c) for c in ("estimate", "se_naive", "se_cluster", "oracle_var", "draw_var", "se", "lo", "hi")])


@query(IPS + f", {pred('pji', 'mk', 'select f.k, judge_score as x from logged cross join (select unnest([0, 1, 2, 3, 4]) as k) f')}, ji as (select policy, p.k, avg(w_cal * greatest(0.0, least(1.0, p.y))) as psi from wcal join pji p on p.x = judge_score group by 1, 2), jack as (select policy, 0.8 * greatest(sum(psi * psi) - 5 * avg(psi) * avg(psi), 0.0) as oracle_var from ji group by 1), " + errors("ips") + f" select policy, n, round(estimate, 6) as estimate, round(se_naive, 6) as se_naive, round(se_cluster, 6) as se_cluster, groups, round(oracle_var, 9) as oracle_var, 0.0::double as draw_var, round(sqrt(se_cluster * se_cluster + oracle_var), 6) as se, round(estimate - {T4} * sqrt(se_cluster * se_cluster + oracle_var), 6) as lo, round(estimate + {T4} * sqrt(se_cluster * se_cluster + oracle_var), 6) as hi from est join jack using (policy)")
def e11_calibrated_ips_with_intervals(spark, sf_dir):
    out = analysis.analyze_tables(bridge.logged(spark, sf_dir), None, "calibrated-ips", mode="monotone")
    return rounded(out.withColumn("oracle_var", F.round("oracle_var", 9)), 9).select("policy", "n", "groups", "draw_var", "oracle_var", *[F.round(c, 6).alias(c) for c in ("estimate", "se_naive", "se_cluster", "se", "lo", "hi")])


@query(OUTCOMES + DR + ", two as (" + " union all ".join(f"select '{n}' as kind, policy, count(*) as g, count(*) * 1.0 / (count(*) - 1) * (sum(t * t) - count(*) * avg(t) * avg(t)) / (sum(m) * sum(m)) as v from (select policy, sum(phi) as t, count(*) as m from dc group by policy, {k}) group by policy" for n, k in (("a", "fold"), ("b", "o"), ("ab", "fold, o"))) + ") select policy, round(sqrt(greatest(sum(case when kind = 'ab' then -v else v end), 0)), 6) as se, max(case when kind <> 'ab' then g end) - 1 as df from two group by policy")
def d17_two_way_clusters(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    return rounded(inference.two_way(estimators.dr_cpo(rows).join(rows.select("policy", "row_id", "outer"), ["policy", "row_id"]), "fold", "outer"))


@query(IPS + f", p as (select a.phi - b.phi as d from ips a join ips b using (row_id) where a.policy = 'policy_a' and b.policy = 'policy_b'), v as (select policy, avg(c) as v from ips group by 1), r as (select (select v from v where policy = 'policy_a') - (select v from v where policy = 'policy_b') as difference, stddev_samp(d) / sqrt(count(*)) as se from p) select 'policy_a' as first, 'policy_b' as second, round(difference, 6) as difference, round(se, 6) as se, round(difference / se, 3) as z, round({two_sided('difference / se')}, 6) as p, abs(difference / se) > {Z} as significant from r")
def d24_paired_policies(spark, sf_dir):
    out = inference.compare(estimators.calibrated_ips(calibrated(spark, sf_dir)))
    return out.select("first", "second", F.round("difference", 6).alias("difference"), F.round("se", 6).alias("se"), F.round("z", 3).alias("z"), F.round("p", 6).alias("p"), "significant")


@query(IPS + ", v as (select policy, avg(c) as v from ips group by 1) select policy, round(v, 6) as estimate from v order by v desc, policy limit 1")
def d24_best_policy(spark, sf_dir):
    return rounded(inference.best_policy(estimators.cluster_robust(estimators.calibrated_ips(calibrated(spark, sf_dir)))))


@query(IPS + ", " + errors("ips") + f" select policy, round(estimate, 6) as estimate, round(se_cluster, 6) as se, round({Z2}, 6) as critical, round(estimate - {Z2} * se_cluster, 6) as lo, round(estimate + {Z2} * se_cluster, 6) as hi, estimate - {Z2} * se_cluster > 0 or estimate + {Z2} * se_cluster < 0 as significant from est")
def d22_simultaneous_bands(spark, sf_dir):
    return rounded(inference.simultaneous(estimators.cluster_robust(estimators.calibrated_ips(calibrated(spark, sf_dir))), se="se_cluster"))


@query(IPS + ", " + errors("ips") + f", ps as (select *, {two_sided('estimate / se_naive')} as p from est), rk as (select *, row_number() over (order by p, policy) as rk, count(*) over () as m from ps) select policy, round(estimate, 6) as estimate, round(se_naive, 6) as se, round(estimate - {Z} * se_naive, 6) as lo, round(estimate + {Z} * se_naive, 6) as hi, round(p, 6) as p, round(least(1.0, min(p * m / rk) over (order by rk desc)), 6) as adjusted from rk")
def d23_classical_inference(spark, sf_dir):
    return rounded(inference.robust_inference(estimators.calibrated_ips(calibrated(spark, sf_dir)), "classical"))


@query()
def d19_stationary_bootstrap(spark, sf_dir):
    return rounded(inference.block_bootstrap(estimators.raw_ips(scored(spark, sf_dir)), stationary=True))


@query()
def d20_moving_block_bootstrap(spark, sf_dir):
    return rounded(inference.block_bootstrap(estimators.raw_ips(scored(spark, sf_dir))))


@query(OUTCOMES + """, p as (select policy, q as dm, w_cal * (reward - g) as ips, reward - g as res, reward, q + w_cal * (reward - g) as c, draws from dr), f as (select *, c - avg(c) over (partition by policy) as phi from p),
t as (select policy, sum(a) filter (where rn <= greatest(1, floor(n * 0.01))) / sum(a) as top from (select policy, abs(phi) as a, row_number() over (partition by policy order by abs(phi) desc) as rn, count(*) over (partition by policy) as n from f) group by 1)
select policy, count(*) as n, round(avg(dm), 6) as dm_mean, round(avg(ips), 6) as ips_mean, round(avg(c), 6) as estimate, round(stddev_pop(dm), 6) as dm_std, round(stddev_pop(ips), 6) as ips_std, round(avg(res), 6) as residual_mean, round(stddev_pop(res), 6) as residual_std, round(sqrt(avg(res * res)), 6) as residual_rmse,
 round(1 - sum(res * res) / greatest(var_pop(reward) * count(*), 1e-12), 5) as r2, round(stddev_pop(phi), 6) as if_std, round(quantile_cont(abs(phi), 0.99) / quantile_cont(abs(phi), 0.05), 3) as if_tail, round(any_value(top), 6) as if_top, round(corr(dm, ips), 6) as correlation from f join t using (policy) group by policy""")
def d15_dr_diagnostics(spark, sf_dir):
    out = diagnostics.dr_diagnostics(outcomes(spark, sf_dir))
    return out.select("policy", "n", *[F.round(c, {"r2": 5, "if_tail": 3}.get(c, 6)).alias(c) for c in out.columns if c not in ("policy", "n")])


@query(OUTCOMES + DR + ", s as (select policy, phi, stddev_pop(phi) over (partition by policy) as sd from dc), m as (select policy, avg(power(phi / sd, 3)) as skewness, avg(power(phi / sd, 4)) - 3 as kurtosis, count(*) filter (where abs(phi / sd) > 3) as n_outliers, count(*) as n from s group by 1) select policy, round(skewness, 5) as skewness, round(kurtosis, 5) as kurtosis, n_outliers, round(n_outliers / n, 6) as outlier_fraction from m")
def d29_influence_moments(spark, sf_dir):
    return rounded(diagnostics.influence_shape(estimators.dr_cpo(outcomes(spark, sf_dir))), 6).select("policy", F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"), "n_outliers", "outlier_fraction")


@query(CALIBRATED + ", f0 as (select f.policy, greatest(0.0, least(1.0, p.y)) as r from fresh f join (select x, y from pf0) p on p.x = f.judge_score), lo as (select min(reward) as f_min from cal) select policy, round(a.logged, 6) as logged, round(b.fresh, 6) as fresh from (select policy, avg(case when abs(reward - f_min) <= 1e-6 then 1.0 else 0.0 end) as logged from scored cross join lo group by 1) a join (select policy, avg(case when abs(r - f_min) <= 1e-6 then 1.0 else 0.0 end) as fresh from f0 cross join lo group by 1) b using (policy)".replace("f0 as", pred("pf0", "m0", "select 0 as k, judge_score as x from fresh") + ", f0 as", 1))
def e13_floor_mass(spark, sf_dir):
    m = models(spark, sf_dir)
    rows = estimators.with_rewards(bridge.logged(spark, sf_dir).withColumn("fold", estimators.fold_of(F.col("prompt_id"))), m)
    drawn = estimators.with_rewards(bridge.fresh(spark, sf_dir).withColumn("fold", estimators.fold_of(F.col("prompt_id"))), m)
    return rounded(diagnostics.floor_mass(scored(spark, sf_dir, m), drawn, rows))


@query(CALIBRATED + f", q as (select quantile_cont(judge_score, 0.1) as a, quantile_cont(judge_score, 0.2) as b from logged) select count(*) as n, count(oracle_label) as n_labels, round(sqrt(avg((reward - oracle_label) * (reward - oracle_label))), 6) as rmse, round(sqrt(avg((reward_oof - oracle_label) * (reward_oof - oracle_label))), 6) as rmse_oof, round(min(reward), 6) as f_min, round(max(reward), 6) as f_max, count(distinct round(reward, 6)) as levels, round(avg(case when judge_score <= a then case when oracle_label is null then 0.0 else 1.0 end end), 6) as covered_10, round(avg(case when judge_score <= b then case when oracle_label is null then 0.0 else 1.0 end end), 6) as covered_20 from cal cross join q")
def c8_calibrated_dataset(spark, sf_dir):
    return rounded(analysis.calibration_summary(analysis.prepared_rewards(bridge.logged(spark, sf_dir), "monotone")[0]))


@query(SQL + f", l as (select row_id, oracle_label is not null as labelled, (row_number() over (partition by oracle_label is not null order by md5(prompt_id || '-42'), row_id) - 1) % 5 as even, {FOLD} as hashed from logged) select row_id, cast(case when labelled then even else hashed end as bigint) as fold from l")
def h3_balanced_folds(spark, sf_dir):
    return estimators.balanced_folds(bridge.logged(spark, sf_dir)).select("row_id", F.col("fold").cast("long").alias("fold"))


U = lambda tag: f"((('0x' || substr(md5(prompt_id || '-' || d || '-{tag}'), 1, 8))::bigint + 0.5) / 4294967296.0)"


@query(SQL + f" select prompt_id, cast(d as integer) as draw_idx, round(greatest(0.0, least(1.0, coalesce(judge_score, 0.5) + 0.02 * sqrt(-2 * ln({U('a')})) * cos(2 * pi() * {U('b')}))), 9) as judge_score from logged cross join (select unnest(range(5)) as d)")
def h8_synthetic_draws(spark, sf_dir):
    return rounded(estimators.synthetic_draws(bridge.logged(spark, sf_dir)), 9)


@query(SQL + ", n as (select policy, judge_score, count(*) over (partition by policy order by judge_score) as below, count(*) over (partition by policy) as n from w) select policy, judge_score, round(any_value((below - 0.5) / n), 9) as rank from n group by policy, judge_score")
def is5_ecdf_rank(spark, sf_dir):
    return rounded(diagnostics.ecdf(weighted(spark, sf_dir), "judge_score"), 9)


@query(WEIGHTS + ", m as (select policy, var_pop(w) as vr, var_pop(w_cal) as vc, covar_pop(w, w_cal) as c from wcal group by 1), a as (select *, 0.5 * vr as cap, vr + vc - 2 * c as vd, c - vr as b from m), l as (select *, greatest(0, least(1, -b / vd)) as low from a), f as (select *, case when vc <= cap * 1.001 then 1.0 when vd <= 1e-12 then 0.0 when vr + 2 * low * b + low * low * vd > cap * 1.001 then low else greatest(0, least(1, (-b + sqrt(greatest(b * b - vd * (vr - cap), 0))) / (vd + 1e-12))) end as alpha from l) select policy, round(alpha, 6) as alpha, round(vr + 2 * alpha * b + alpha * alpha * vd, 6) as variance, vr + 2 * alpha * b + alpha * alpha * vd <= cap * 1.001 as feasible from f")
def w8_variance_safe_blend(spark, sf_dir):
    return rounded(estimators.safe_blend(calibrated(spark, sf_dir), 0.5))


@query(SQL + ", " + "w0 as (select policy, least(floor(w * 10), 99) as bin, w from w) select policy, cast(bin as bigint) as bin, count(*) as n, round(sum(w), 6) as mass from w0 group by 1, 2")
def v4_weight_histogram(spark, sf_dir):
    return rounded(weighted(spark, sf_dir).groupBy("policy", F.least(F.floor(F.col("w") * 10), F.lit(99)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("mass")))


@query(SQL + ", l as (select policy, round(w, 3) as w, count(*) as c from w group by 1, 2) select policy, w, round(sum(c) over (partition by policy order by w desc) / sum(c) over (partition by policy), 9) as share from l")
def v3_weight_ccdf(spark, sf_dir):
    """The share of rows with a weight of at least w, by levels of three decimals."""
    return rounded(diagnostics.ccdf(weighted(spark, sf_dir).withColumn("w", F.round("w", 3)), "w"), 9)


@query(SQL + " select cast(least(floor(judge_score * 20), 19) as bigint) as x, cast(least(floor(oracle_label * 20), 19) as bigint) as y, count(*) as n from logged where oracle_label is not null group by 1, 2")
def v1_calibration_grid(spark, sf_dir):
    at = lambda c: F.least(F.floor(F.col(c) * 20), F.lit(19)).cast("long")
    return bridge.logged(spark, sf_dir).where("oracle_label is not null").groupBy(at("judge_score").alias("x"), at("oracle_label").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(HILL + ", a as (select policy, sum(w) * sum(w) / sum(w * w) / count(*) as e from w group by 1), h as (select policy, least(1.0, avg(sqrt(greatest(w, 1e-10)))) as affinity, count(*) as n from w group by 1) select round(sum(n * e) / sum(n), 6) as ess_fraction, round(avg(affinity), 6) as affinity, sum(n) as n, round(min(alpha), 6) as alpha, case when min(alpha) < 1.5 then 'critical' when min(alpha) < 2 then 'warning' else 'good' end as status from a join h using (policy) join hill using (policy)")
def d10_ips_diagnostics(spark, sf_dir):
    return rounded(diagnostics.ips_summary(weighted(spark, sf_dir)))


@query(HILL + ", a as (select policy, sum(w) * sum(w) / sum(w * w) / count(*) as e from w group by 1) select policy, round(e, 6) as ess_fraction, case when e < 0.1 then 'high' when e < 0.3 then 'medium' else 'low' end as variance_risk, round(alpha, 6) as alpha, case when alpha < 2 then 'critical' when alpha < 2.5 then 'high' else 'low' end as tail_risk from a join hill using (policy)")
def d12_policy_risk(spark, sf_dir):
    return rounded(diagnostics.policy_risk(weighted(spark, sf_dir)))
