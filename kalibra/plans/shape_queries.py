"""Residualised influence, the fast projection of weights, and the shape of influence, over the bridge tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import diagnostics, estimators, projection, residuals, shape
from . import bridge
from .bridge import SQL
from .inference_queries import DR
from .oracle_sql import CALIBRATED, OUTCOMES, iso, pred
from .queries import KENDALL, ORACLE_SQL, QUERIES, outcomes, query, rounded, scored, weighted

#: CTE raw_(policy, row_id, fold, judge_score, c, phi): raw IPS.
RAW = CALIBRATED + ", psi_ as (select policy, sum(w * reward) / sum(w) as psi from scored group by 1), raw_ as (select policy, row_id, fold, judge_score, c, p - avg(p) over (partition by policy) as phi from (select *, w * reward as c, w * (reward_oof - psi) - psi * (w - 1) as p from scored join psi_ using (policy)))"
#: The rank correlation's sign, a rising fit of the influence along it from the other folds, and what is left.
ISOTONIC = f""", sg as (select policy, case when corr(a, b) < 0 then -1.0 else 1.0 end as sg from (select policy, rank() over (partition by policy order by judge_score) + (count(*) over (partition by policy, judge_score) - 1) / 2.0 as a, rank() over (partition by policy order by phi) + (count(*) over (partition by policy, phi) - 1) / 2.0 as b from raw_) group by policy),
rs as (select raw_.*, sg from raw_ join sg using (policy)), {iso("ci", "select policy || '-' || f.k as k, judge_score as x, sg * phi as y, 1.0 as w from rs cross join (select unnest([0, 1, 2, 3, 4]) as k) f where fold <> f.k")}, {pred("pc", "ci", "select policy || '-' || fold as k, judge_score as x from rs")},
rh as (select policy, c, phi, phi - (h - avg(h) over (partition by policy)) as left_ from (select rs.*, sg * pc.y as h from rs join pc on pc.k = policy || '-' || fold and pc.x = judge_score))"""
SUMMARY = " select policy, count(*) as n, true as applied, round(greatest(0, 1 - sum(left_ * left_) / (var_samp(phi) * (count(*) - 1))), 6) as r2, round(greatest(0, 1 - var_samp(left_) / var_samp(phi)), 6) as var_reduction, round(greatest(0, 1 - sqrt(var_samp(left_) / var_samp(phi))), 6) as se_reduction, round(var_samp(phi) / var_samp(left_), 6) as ess_gain, round(stddev_samp(left_) / sqrt(count(*)), 6) as se, round(avg(c), 6) as estimate from rh group by policy"


def _residualised(spark, sf_dir, form):
    rows = scored(spark, sf_dir)
    left, summary = residuals.residualised(estimators.raw_ips(rows), rows, form)
    errors = left.groupBy("policy").agg((F.stddev_samp("phi") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.avg("c").alias("estimate"))
    return rounded(summary.join(F.broadcast(errors), "policy"))


def c13_residualised_influence(spark, sf_dir):
    """Raw IPS, its influence less a rising or falling fit on the score."""
    return _residualised(spark, sf_dir, "isotonic")


QUERIES["c13_residualised_influence"], ORACLE_SQL["c13_residualised_influence"] = c13_residualised_influence, RAW + ISOTONIC + SUMMARY


@query()
def c13_spline_residuals(spark, sf_dir):
    """Raw IPS, its influence less penalised splines of the score."""
    return _residualised(spark, sf_dir, "spline")


@query(SQL + """, s as (select policy, row_id, w, row_number() over (partition by policy order by w, row_id) as i, sum(w - 1) over (partition by policy order by w, row_id rows unbounded preceding) as z from w),
t as (select *, z - (w - 1) as before, avg(z) over (partition by policy order by i rows between current row and unbounded following) as rest from s),
turn as (select policy, max(i) filter (where before >= rest or i = 1) as i, max_by(rest - before + 1, case when before >= rest or i = 1 then i else 0 end) as v from t group by policy),
f as (select s.policy, s.row_id, s.i, case when s.i < turn.i then w when s.i = turn.i then greatest(0.0, turn.v) else 1.0 end as v from s join turn using (policy)),
g as (select policy, row_id, max(v) over (partition by policy order by i rows unbounded preceding) as v from f)
select policy, row_id, round(v / avg(v) over (partition by policy), 6) as w_fast from g""")
def w7_fast_projection(spark, sf_dir):
    return rounded(projection.fast(weighted(spark, sf_dir)).select("policy", "row_id", "w_fast"))


#: A normal deviate's lower tail, by the series of the error function; both tails' logarithms are taken of values that do not cancel.
TAIL = "(case when {z} < 0 then 0.5 * (1 - {e}) else 0.5 * (1 + {e}) end)"
ERF = "(2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 150), lambda i: exp((2 * i + 1) * ln(greatest(abs(z), 1e-12) / sqrt(2)) + i * ln(2) - (lgamma(2 * i + 3) - (i + 1) * ln(2) - lgamma(i + 2))))))"


@query(OUTCOMES + DR + f""", st as (select policy, row_id, (phi - avg(phi) over (partition by policy)) / stddev_samp(phi) over (partition by policy) as z, row_number() over (partition by policy order by phi, row_id) as i, count(*) over (partition by policy) as n from dc),
fz as (select *, {TAIL.format(z="z", e=ERF)} as low, {TAIL.format(z="-z", e=ERF)} as high from st),
ad as (select policy, any_value(n) as n, -any_value(n) - sum((2 * i - 1) * ln(low) + (2 * (n - i) + 1) * ln(high)) / any_value(n) as a2 from fz group by policy)
select policy, n, 'anderson-darling' as test, round(a2, 3) as statistic, case when a2 > round(1.092 / (1 + 4.0 / n - 25.0 / n / n), 3) then 0.01 else 0.5 end as p_value, not a2 > round(1.092 / (1 + 4.0 / n - 25.0 / n / n), 3) as normal from ad""")
def d29_normality(spark, sf_dir):
    """Doubly robust influence: over 5,000 rows a policy the test is Anderson and Darling's."""
    out = shape.normality(estimators.dr_cpo(outcomes(spark, sf_dir)))
    return out.withColumn("statistic", F.round("statistic", 3))


POINTS = ", ".join(f"({i}, {NormalDist().inv_cdf(i / 100)!r})" for i in range(1, 100))


@query(OUTCOMES + DR + f", st as (select policy, (phi - avg(phi) over (partition by policy)) / stddev_pop(phi) over (partition by policy) as z from dc), q as (select policy, quantile_cont(z, [{', '.join(str(i / 100) for i in range(1, 100))}]) as v from st group by policy) select policy, i / 100.0::double as p, round(normal, 6) as normal, round(v[i], 6) as sample from q cross join (values {POINTS}) t(i, normal)")
def d29_qq_points(spark, sf_dir):
    """Percentiles of the doubly robust influence beside those of the normal distribution."""
    out = shape.qq_points(estimators.dr_cpo(outcomes(spark, sf_dir)))
    return out.select("policy", F.round("p", 2).alias("p"), F.round("normal", 6).alias("normal"), F.round("sample", 6).alias("sample"))


@query(SQL + KENDALL.replace("BATCH", "row_id // 400") + " select a.batch, round(a.tau, 6) as tau, round(b.tau, 6) as tau_next, round(b.tau - a.tau, 6) as tau_change, abs(b.tau - a.tau) > 0.1 as drift, case when abs(b.tau - a.tau) > 0.2 then 'high' when abs(b.tau - a.tau) > 0.1 then 'moderate' end as severity from k a join k b on b.batch = a.batch + 1")
def d25_label_drift(spark, sf_dir):
    """Batches of 400 rows: does the judge still order as the labels do?"""
    rows = bridge.logged(spark, sf_dir).where("oracle_label is not null").select(F.floor(F.col("row_id") / 400).alias("batch"), "judge_score", "oracle_label")
    return rounded(diagnostics.label_drift(rows, "batch", "judge_score", "oracle_label"))
