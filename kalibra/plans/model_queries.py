"""Outcome models, saved calibrators, each estimator's own jackknife, and all estimators with intervals, over the bridge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, calibration, estimators, jackknife, outcomes, store, weights
from ..operators.tables import scratch, written
from . import bridge
from .bridge import POLICIES, SQL
from .inference_queries import DRAWS, T4
from .oracle_sql import CALIBRATED, FOLD, OUTCOMES, WEIGHTS, iso, pred, summary
from .queries import LABEL_CHANCE, MRDR, ORACLE_SQL, TMLE, mean_weight, query, rounded
from .queries import models as models_of
from .queries import outcomes as with_outcomes

#: A reward for every row, of 101 levels: what a log holds whose rewards were given.
GIVEN_REWARD = "cast(floor(100 * greatest(0.0, least(1.0, 0.15 + 0.7 * judge_score + ((row_id * 19) % 61 - 30) / 150.0)) + 0.123456) as double) / 100"
GIVEN = f"""{SQL}, cal as (select *, {FOLD} as fold, {GIVEN_REWARD} as reward, {GIVEN_REWARD} as reward_oof from logged),
scored as (select w.policy, w.w, c.row_id, c.prompt_id, c.fold, c.judge_score, c.oracle_label, c.reward, c.reward_oof from w join cal c using (row_id))"""
GIVEN_WEIGHTS = GIVEN + WEIGHTS.removeprefix(CALIBRATED)


def given(spark, sf_dir):
    """Weighted rows whose rewards were given, with calibrated weights."""
    logged = bridge.logged(spark, sf_dir).withColumn("reward", F.expr(GIVEN_REWARD))
    rows = weights.hajek(weights.by_policy(weights.valid_rows(analysis.prepared_rewards(logged)[0], POLICIES)))
    return written(estimators.stabilised(written(rows, "scored")), "calibrated")


def modelled(name: str, value: str) -> str:
    """CTE dr over wcal with g and q by a model: value is the outcome of a row (policy, fold, judge_score) joined to {name}."""
    return f""", drawn as (select policy, prompt_id, avg(g) as q, count(*) as draws from (select f.policy, f.prompt_id, {value} as g from (select *, {FOLD} as fold from fresh) f {name}) group by 1, 2),
dr as (select f.*, d.q, d.draws, {value} as g from wcal f join drawn d using (policy, prompt_id) {name})"""


O2 = GIVEN_WEIGHTS + ", " + iso("go", "select policy || '-' || f.k as k, judge_score as x, reward as y, 1.0 as w from wcal cross join (select unnest([0, 1, 2, 3, 4]) as k) f where fold <> f.k") + ", " + pred("pgo", "go", f"select policy || '-' || {FOLD} as k, judge_score as x from fresh union all select policy || '-' || fold, judge_score from wcal")
O3 = GIVEN_WEIGHTS + ", rs as (select policy, fold, count(*) as n, sum(judge_score) as sx, sum(judge_score * judge_score) as sxx, sum(reward) as sy, sum(judge_score * reward) as sxy from wcal group by 1, 2), rt as (select a.policy, a.fold, sum(b.n) + 1 as n, sum(b.sx) as sx, sum(b.sxx) + 1 as sxx, sum(b.sy) as sy, sum(b.sxy) as sxy from rs a join rs b on a.policy = b.policy and a.fold <> b.fold group by 1, 2), rc as (select policy, fold, (n * sxy - sx * sy) / (n * sxx - sx * sx) as slope, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) as level from rt)"


@query(O2 + modelled("join pgo on pgo.k = f.policy || '-' || f.fold and pgo.x = f.judge_score", "pgo.y") + ", " + summary("dr", "q + w_cal * (reward - g)"))
def o2_isotonic_outcome(spark, sf_dir):
    """Doubly robust values of given rewards, the outcome model a cross-fitted rising fit of rewards on scores."""
    rows = given(spark, sf_dir)
    fitted = outcomes.fit(rows, outcomes.Isotonic())
    return rounded(estimators.cluster_robust(estimators.dr_cpo(written(outcomes.with_model(rows, bridge.fresh(spark, sf_dir), fitted), "outcomes"))))


@query(O3 + modelled("join rc on rc.policy = f.policy and rc.fold = f.fold", "greatest(0.0, least(1.0, rc.level + rc.slope * f.judge_score))") + ", " + summary("dr", "q + w_cal * (reward - g)"))
def o3_ridge_outcome(spark, sf_dir):
    """As o2, by ridge regression on the score, from sums by policy and fold."""
    rows = given(spark, sf_dir)
    fitted = outcomes.fit(rows, outcomes.linear([F.col("judge_score"), F.lit(1.0)]))
    return rounded(estimators.cluster_robust(estimators.dr_cpo(written(outcomes.with_model(rows, bridge.fresh(spark, sf_dir), fitted), "outcomes"))))


@query(CALIBRATED + f", {pred('ps', 'm0', 'select 0 as k, judge_score as x from fresh')}, {pred('psk', 'mk', f'select {FOLD} as k, judge_score as x from fresh')} select policy, f.prompt_id, draw_idx, round(greatest(0.0, least(1.0, ps.y)), 9) as reward, round(greatest(0.0, least(1.0, psk.y)), 9) as reward_oof from (select *, {FOLD} as fold from fresh) f join ps on ps.x = f.judge_score join psk on psk.k = f.fold and psk.x = f.judge_score")
def c11_saved_calibrator(spark, sf_dir):
    """A calibration of the log is saved, and the saved one is applied to the fresh draws: by all labels, and out of fold."""
    logged, path = bridge.logged(spark, sf_dir), scratch(spark, "calibrator")
    store.save(spark, calibration.fit(logged.withColumn("fold", estimators.fold_of(F.col("prompt_id")))), path)
    rows = bridge.fresh(spark, sf_dir).withColumn("fold", estimators.fold_of(F.col("prompt_id")))
    out = store.apply(store.apply(rows, path), path, "fold", name="reward_oof")
    return rounded(out.select("policy", "prompt_id", "draw_idx", "reward", "reward_oof"), 9)


#: Contributions of each estimator but the stacked one, and what its value owes a logged row's reward under the model in turn; of (CTE full_).
CONTRIBUTIONS = {
    "orthogonalized-ips": ("w_cal * reward + (w - m) * (reward - reward_oof) + reward_oof * (w - w_cal)", "m - w_cal", False),
    "dr-cpo": ("q + w_cal * (reward - g)", "w_cal", True),
    "oc-dr-cpo": ("q + w_cal * (reward_oof - g) + (w - w_cal) * (reward_oof - g) + (w - m) * (reward - reward_oof)", "m", True),
    "mrdr": ("q + w_cal * (reward - gm)", "w_cal", True),
    "tmle": ("q + w_cal * (reward - gt)", "w_cal", True),
    "tr-cpo": ("q + w * (reward - g) + case when oracle_label is null then 0 else w * (oracle_label - reward) / pi end", "w - case when oracle_label is null then 0 else w / pi end", True),
    "tr-cpo-e": ("q + w * (reward - g) + case when oracle_label is null then 0 else m * (oracle_label - reward) / pi end", "w - case when oracle_label is null then 0 else m / pi end", True),
}
OWN = {"raw-ips": "wc_", "calibrated-ips": "w_cal", **{n: coefficient for n, (_, coefficient, _) in CONTRIBUTIONS.items()}}


def _pair(i: int, j: int) -> str:
    """The best mixture of two parts as a struct of its variance and three weights."""
    t = f"greatest(0.0, least(1.0, (s{j}{j} - s{i}{j}) / (s{i}{i} + s{j}{j} - 2 * s{i}{j})))"
    at = [t if k == i else f"1 - {t}" if k == j else "0.0" for k in (1, 2, 3)]
    return f"{{'v': {t} * {t} * s{i}{i} + 2 * {t} * (1 - {t}) * s{i}{j} + (1 - {t}) * (1 - {t}) * s{j}{j}, 'a1': {at[0]}, 'a2': {at[1]}, 'a3': {at[2]}}}"


#: CTEs ending in every(estimator, policy, row_id, fold, c, phi), est, jack(estimator, policy, oracle_var) and mc(policy, mc).
EVERY = (OUTCOMES + MRDR + TMLE).replace("with logged", "with recursive logged", 1) + mean_weight("dr") + LABEL_CHANCE + DRAWS + """,
full_ as (select o.*, least(o.w, 100.0) / avg(least(o.w, 100.0)) over (partition by o.policy) as wc_, greatest(0.001, least(0.999, pl.y)) as pi, greatest(0.0, least(1.0, pm.y)) as gm, t.gt from orth o join pl on pl.k = o.policy || '-' || o.fold and pl.x = o.judge_score join pm on pm.k = o.policy || '-' || o.fold and pm.x = o.judge_score join tf t on t.policy = o.policy and t.row_id = o.row_id),
psi_ as (select policy, sum(wc_ * reward) / sum(wc_) as psi from full_ group by 1),
parts as (select 'raw-ips' as estimator, policy, row_id, fold, wc_ * reward as c, wc_ * (reward_oof - psi) - psi * (wc_ - 1) as p from full_ join psi_ using (policy)
 union all select 'calibrated-ips', policy, row_id, o, w_cal * reward, (w_cal * (reward_oof - psi_train) - psi_train * (w_cal - w_train)) / w_train from full_
""" + "".join(f" union all select '{n}', policy, row_id, fold, {c}, {c} from full_\n" for n, (c, _, _) in CONTRIBUTIONS.items()) + """),
single as (select estimator, policy, row_id, fold, c, p - avg(p) over (partition by estimator, policy) as phi from parts),
three as (select a.policy, a.row_id, a.fold, a.c as c1, b.c as c2, d.c as c3, a.phi as p1, b.phi as p2, d.phi as p3 from single a join single b on b.estimator = 'mrdr' and b.policy = a.policy and b.row_id = a.row_id join single d on d.estimator = 'tmle' and d.policy = a.policy and d.row_id = a.row_id where a.estimator = 'dr-cpo'),
cov as (select policy, """ + ", ".join(f"covar_samp(p{i}, p{j}) + count(*) * any_value(mc)" + (" + 1e-4" if i == j else "") + f" as s{i}{j}" for i, j in ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3))) + """ from three join mc using (policy) group by policy),
free as (select *, (s22 * s33 - s23 * s23) + (s13 * s23 - s12 * s33) + (s12 * s23 - s13 * s22) as b1, (s13 * s23 - s12 * s33) + (s11 * s33 - s13 * s13) + (s12 * s13 - s11 * s23) as b2, (s12 * s23 - s13 * s22) + (s12 * s13 - s11 * s23) + (s11 * s22 - s12 * s12) as b3 from cov),
alpha as (select policy, case when least(b1, b2, b3) >= 0 then {'v': 0.0, 'a1': b1 / (b1 + b2 + b3), 'a2': b2 / (b1 + b2 + b3), 'a3': b3 / (b1 + b2 + b3)} else least(""" + ", ".join(_pair(i, j) for i, j in ((1, 2), (1, 3), (2, 3))) + """) end as a from free),
every as (select * from single union all select 'stacked-dr', policy, row_id, fold, a.a1 * c1 + a.a2 * c2 + a.a3 * c3, a.a1 * p1 + a.a2 * p2 + a.a3 * p3 from three join alpha using (policy)),
sums as (select estimator, policy, fold, sum(phi) as t from every group by 1, 2, 3),
spread as (select estimator, policy, count(*) * 1.0 / (count(*) - 1) * (sum(t * t) - count(*) * avg(t) * avg(t)) as v, count(*) as groups from sums group by 1, 2),
est as (select estimator, policy, count(*) as n, avg(c) as estimate, stddev_samp(phi) / sqrt(count(*)) as se_naive, sqrt(greatest(any_value(v), 0)) / count(*) as se_cluster, any_value(groups) as groups from every join spread using (estimator, policy) group by 1, 2),
""" + pred("jf", "mk", "select f.k, judge_score as x from fresh cross join (select unnest([0, 1, 2, 3, 4]) as k) f") + ", " + pred("jl", "mk", "select f.k, judge_score as x from logged cross join (select unnest([0, 1, 2, 3, 4]) as k) f") + """,
jq as (select f.policy, prompt_id, p.k, avg(greatest(0.0, least(1.0, p.y))) as q from fresh f join jf p on p.x = f.judge_score where (f.policy, prompt_id) in (select policy, prompt_id from dr) group by 1, 2, 3),
jd as (select policy, k, avg(q) as d from jq group by 1, 2),
jo as (""" + " union all ".join(f"select '{n}' as estimator, policy, judge_score, {c} as own, {str(n in analysis.ROBUST).lower()} as drawn from full_" for n, c in OWN.items()) + """),
js as (select estimator, policy, p.k, avg(own * greatest(0.0, least(1.0, p.y))) + any_value(case when drawn then d else 0.0 end) as psi from jo join jl p on p.x = jo.judge_score join jd using (policy, k) group by 1, 2, 3),
jw as (select * from js union all select 'stacked-dr', policy, k, sum(psi * case estimator when 'dr-cpo' then a.a1 when 'mrdr' then a.a2 else a.a3 end) from js join alpha using (policy) where estimator in ('dr-cpo', 'mrdr', 'tmle') group by policy, k),
jack as (select estimator, policy, 0.8 * greatest(sum(psi * psi) - 5 * avg(psi) * avg(psi), 0.0) as oracle_var from jw group by 1, 2)"""
ROBUST = "estimator in (" + ", ".join(f"'{n}'" for n in analysis.ROBUST) + ")"
SE = f"sqrt(se_cluster * se_cluster + oracle_var + case when {ROBUST} then mc else 0.0 end)"


@query(EVERY + f" select estimator, policy, n, round(estimate, 5) as estimate, round(se_naive, 5) as se_naive, round(se_cluster, 5) as se_cluster, groups, round(oracle_var, 8) as oracle_var, round(case when {ROBUST} then mc else 0.0 end, 8) as draw_var, round({SE}, 5) as se, round(estimate - {T4} * {SE}, 4) as lo, round(estimate + {T4} * {SE}, 4) as hi from est join jack using (estimator, policy) join mc using (policy)")
def e11_every_estimator(spark, sf_dir):
    """All ten estimators with intervals: clusters, each one's own jackknife over the labels, and draws."""
    out = analysis.analyze_many(bridge.logged(spark, sf_dir), bridge.fresh(spark, sf_dir), list(analysis.REGISTRY), POLICIES, mode="monotone")
    digits = {"oracle_var": 8, "draw_var": 8, "lo": 4, "hi": 4}
    return out.select(*[F.round(c, digits.get(c, 5)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(EVERY + " select estimator, policy, k, round(psi - avg(psi) over (partition by estimator, policy), 7) as shift from jw")
def e10_jackknife_paths(spark, sf_dir):
    """How far each fold's model moves each estimator from the mean over folds."""
    m = models_of(spark, sf_dir)
    rows, fresh = with_outcomes(spark, sf_dir, m), bridge.fresh(spark, sf_dir)
    single = [n for n in analysis.REGISTRY if n not in ("raw-ips", "stacked-dr")]
    found = jackknife.paths(rows, fresh, m, single).unionByName(jackknife.paths(weights.clipped(rows, analysis.CLIP), None, m, ["raw-ips"]))
    found = written(found, "jackknife")
    found = found.unionByName(jackknife.combined(found, analysis.stacked_dr(rows, draw_var=estimators.draw_variance(rows))[1]))
    mean = found.groupBy("estimator", "policy").agg(F.avg("psi").alias("mean"))
    return rounded(found.join(F.broadcast(mean), ["estimator", "policy"]).select("estimator", "policy", F.col("k").cast("int").alias("k"), (F.col("psi") - F.col("mean")).alias("shift")), 7)


# e9_stacked_dr is of the same parts; what draws add to every cell alike doesn't move weights of sum one
ORACLE_SQL["e9_stacked_dr"] = EVERY + " select policy, n, round(estimate, 5) as estimate, round(se_naive, 5) as se_naive, round(se_cluster, 5) as se_cluster, groups from est where estimator = 'stacked-dr'"
