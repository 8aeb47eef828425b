"""Queries over the bridge tables, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics, estimators, isotonic, weights
from ..operators.tables import written
from . import bridge
from .bridge import POLICIES, SQL
from .oracle_sql import CALIBRATED, ERRORS, FOLD, IPS, OUTCOMES, WEIGHTS, errors, iso, pred, summary, two_sided

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.hajek(weights.by_policy(weights.valid_rows(bridge.logged(spark, sf_dir), POLICIES)))


def models(spark: SparkSession, sf_dir: str):
    return estimators.calibrate(bridge.logged(spark, sf_dir).withColumn("fold", estimators.fold_of(F.col("prompt_id"))))


def scored(spark: SparkSession, sf_dir: str, m=None) -> DataFrame:
    """Weighted rows with rewards, written: what estimators read again and again."""
    rows = weighted(spark, sf_dir).withColumn("fold", estimators.fold_of(F.col("prompt_id")))
    return written(estimators.with_rewards(rows, m or models(spark, sf_dir)), "scored")


def calibrated(spark: SparkSession, sf_dir: str, m=None) -> DataFrame:
    return estimators.stabilised(scored(spark, sf_dir, m))


def outcomes(spark: SparkSession, sf_dir: str, m=None) -> DataFrame:
    m = m or models(spark, sf_dir)
    return written(estimators.with_outcomes(calibrated(spark, sf_dir, m), bridge.fresh(spark, sf_dir), m), "outcomes")


# 2.2 validation and filters


@query("select count(*) filter (where base_lp > 0 or lp_a > 0 or lp_b > 0) as n_invalid, count(*) as n from (" + SQL + " select * from logged)")
def f1_row_validation(spark, sf_dir):
    bad = (F.coalesce(F.col("base_lp"), F.lit(0.0)) > 0) | F.exists(F.map_values("target_lps"), lambda v: F.coalesce(v, F.lit(0.0)) > 0)
    return bridge.logged(spark, sf_dir).agg(F.count_if(bad).alias("n_invalid"), F.count(F.lit(1)).alias("n"))


@query(SQL + " select 'policy_a' as policy, count(*) as n_valid from logged where base_lp is not null and lp_a is not null union all select 'policy_b', count(*) from logged where base_lp is not null and lp_b is not null")
def f2_valid_by_policy(spark, sf_dir):
    return weights.by_policy(bridge.logged(spark, sf_dir)).where("base_lp is not null and target_lp is not null").groupBy("policy").agg(F.count(F.lit(1)).alias("n_valid"))


@query(SQL + " select row_id, prompt_id from complete")
def f3_estimation_filter(spark, sf_dir):
    return weights.valid_rows(bridge.logged(spark, sf_dir), POLICIES).select("row_id", "prompt_id")


@query(SQL + " select 'policy_a' as policy, count(*) as n, count(*) filter (where lp_a is null or base_lp is null) as n_missing from logged union all select 'policy_b', count(*), count(*) filter (where lp_b is null or base_lp is null) from logged")
def f4_missing_log_probabilities(spark, sf_dir):
    return weights.missing_counts(bridge.logged(spark, sf_dir))


@query(SQL + " select count(*) as n, count(*) filter (where judge_score is null) as no_judge, count(oracle_label) as n_labels, count(*) filter (where base_lp is null) as no_base, count(oracle_label) >= 10 as enough, count(oracle_label) >= 50 as comfortable from logged")
def f5_schema_validation(spark, sf_dir):
    n = F.count("oracle_label")
    return bridge.logged(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("judge_score").isNull()).alias("no_judge"), n.alias("n_labels"), F.count_if(F.col("base_lp").isNull()).alias("no_base"), (n >= 10).alias("enough"), (n >= 50).alias("comfortable"))


@query(SQL + ", want as (select prompt_id, policy from (select distinct prompt_id from logged) cross join (select unnest(['policy_a', 'policy_b', 'policy_c']) as policy)) select w.policy, count(*) as n_prompts, count(*) filter (where f.n is null) as n_uncovered, min(f.n) as least, round(avg(f.n), 6) as mean, max(f.n) as most from want w left join (select policy, prompt_id, count(*) as n from fresh group by 1, 2) f using (policy, prompt_id) group by w.policy")
def f7_fresh_coverage(spark, sf_dir):
    """Draws of every prompt for each policy asked for; policy_c has none."""
    return rounded(diagnostics.draw_coverage(bridge.logged(spark, sf_dir), bridge.fresh(spark, sf_dir), ["policy_a", "policy_b", "policy_c"]))


@query(SQL + " select policy, row_id, round(lr, 9) as log_ratio from rows_")
def f8_flatten_by_policy(spark, sf_dir):
    return rounded(weights.by_policy(weights.valid_rows(bridge.logged(spark, sf_dir), POLICIES)).select("policy", "row_id", "log_ratio"), 9)


@query(SQL + " select count(*) as n, round(avg(judge_score), 6) as mean, round(stddev_pop(judge_score), 6) as std from logged")
def f10_dataset_summary(spark, sf_dir):
    return rounded(bridge.logged(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg("judge_score").alias("mean"), F.stddev_pop("judge_score").alias("std")))


@query(SQL + " select round(avg(case when oracle_label is null then 0.0 else 1.0 end), 6) as coverage from logged")
def f11_oracle_coverage(spark, sf_dir):
    return rounded(bridge.logged(spark, sf_dir).agg(F.avg(F.col("oracle_label").isNotNull().cast("double")).alias("coverage")))


@query("select text, min(conv_id) as conv_id from (select conv_id, trim(text) as text, row_number() over (partition by conv_id order by turn) as rn from conversations where role = 'user' and trim(text) <> '') where rn = 1 group by text")
def f14_first_user_turn(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where((F.col("role") == "user") & (F.trim("text") != ""))
    first = turns.groupBy("conv_id").agg(F.min_by(F.trim("text"), "turn").alias("text"))
    return first.groupBy("text").agg(F.min("conv_id").alias("conv_id"))


# 2.3 folds, hashing, sampling


@query(SQL + f" select row_id, {FOLD} as fold from logged")
def h1_hash_fold(spark, sf_dir):
    return bridge.logged(spark, sf_dir).select("row_id", estimators.fold_of(F.col("prompt_id")).cast("long").alias("fold"))


@query(SQL + " select row_id, 'prompt_' || substr(sha256(prompt_id), 1, 12) as key from logged")
def h5_content_key(spark, sf_dir):
    return bridge.logged(spark, sf_dir).select("row_id", F.concat(F.lit("prompt_"), F.substring(F.sha2("prompt_id", 256), 1, 12)).alias("key"))


@query(SQL + " select row_id, judge_score from logged order by md5('7-' || cast(row_id as varchar)), row_id limit 100")
def h6_seeded_sample(spark, sf_dir):
    return bridge.logged(spark, sf_dir).orderBy(F.md5(F.concat(F.lit("7-"), F.col("row_id").cast("string"))), "row_id").limit(100).select("row_id", "judge_score")


@query(SQL + ", r as (select *, row_number() over (order by md5('m-' || cast(row_id as varchar)), row_id) as rn, count(*) over () as m from logged where oracle_label is not null) select row_id, oracle_label from r where rn <= greatest(2, floor(m * 0.25))")
def h7_label_mask(spark, sf_dir):
    """A quarter of the labels stay: the number is exact, so it is a limit, not a cut."""
    labelled = bridge.logged(spark, sf_dir).where("oracle_label is not null")
    keep = max(2, int(labelled.count() * 0.25))
    return labelled.orderBy(F.md5(F.concat(F.lit("m-"), F.col("row_id").cast("string"))), "row_id").limit(keep).select("row_id", "oracle_label")


# 2.4 weights


@query(SQL + " select policy, row_id, round(exp(least(lr, 709.782712893384)), 6) as w from rows_")
def w3_raw_weights(spark, sf_dir):
    return rounded(weights.by_policy(weights.valid_rows(bridge.logged(spark, sf_dir), POLICIES)).select("policy", "row_id", weights.raw(F.col("log_ratio")).alias("w")))


@query(SQL + " select policy, row_id, round(w, 6) as w from w")
def w4_hajek_weights(spark, sf_dir):
    return rounded(weighted(spark, sf_dir).select("policy", "row_id", "w"))


@query(SQL + " select policy, row_id, round(least(w, 2.0) / avg(least(w, 2.0)) over (partition by policy), 6) as w from w")
def w5_clipped_weights(spark, sf_dir):
    rows = weights.by_policy(weights.valid_rows(bridge.logged(spark, sf_dir), POLICIES))
    return rounded(weights.hajek(rows, clip=2.0).select("policy", "row_id", "w"))


@query(WEIGHTS + " select policy, row_id, round(w_cal, 6) as w from wcal")
def w10_stabilised_weights(spark, sf_dir):
    return rounded(calibrated(spark, sf_dir).select("policy", "row_id", F.col("w_cal").alias("w")))


# 2.5 isotonic regression


@query(SQL + ", " + iso("m", "select policy as k, judge_score as x, w as y, 1.0 as w from w") + ", " + pred("p", "m", "select policy as k, judge_score as x from w") + " select k as policy, x as judge_score, round(y, 6) as fitted from p")
def is1_isotonic_rising(spark, sf_dir):
    return _fit(weighted(spark, sf_dir), True)


@query(SQL + ", " + iso("m", "select policy as k, judge_score as x, w as y, 1.0 as w from w", rising=False) + " select k as policy, x as judge_score, round(y, 6) as fitted from m")
def is1_isotonic_falling(spark, sf_dir):
    return _fit(weighted(spark, sf_dir), False)


def _fit(rows: DataFrame, rising: bool) -> DataFrame:
    m = isotonic.knots(isotonic.fit(rows, ["policy"], "judge_score", "w", rising=rising), ["policy"])
    return rounded(isotonic.predict(rows.select("policy", "judge_score").distinct(), m, ["policy"], "judge_score", "fitted"))


@query(SQL + ", n as (select policy, row_id, judge_score, rank() over (partition by policy order by judge_score) as r, count(*) over (partition by policy, judge_score) as c, count(*) over (partition by policy) as n from w) select policy, judge_score, round(any_value((r + (c - 1) / 2.0 - 0.5) / n), 9) as mid_rank from n group by policy, judge_score")
def is6_average_rank(spark, sf_dir):
    """Ranks of levels from running counts: levels are counted first, so a window sees levels, not rows."""
    from pyspark.sql import Window as W

    levels = weighted(spark, sf_dir).groupBy("policy", "judge_score").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy("policy").orderBy("judge_score")) - F.col("c")
    n = levels.groupBy("policy").agg(F.sum("c").alias("n"))
    return rounded(levels.withColumn("before", before).join(F.broadcast(n), "policy").select("policy", "judge_score", ((F.col("before") + (F.col("c") + 1) / 2 - 0.5) / F.col("n")).alias("mid_rank")), 9)


# 2.6 calibration


@query(CALIBRATED + " select row_id, round(reward, 12) as reward, round(reward_oof, 12) as reward_oof from cal")
def c2_cross_fitted_rewards(spark, sf_dir):
    rows = bridge.logged(spark, sf_dir).withColumn("fold", estimators.fold_of(F.col("prompt_id")))
    return rounded(estimators.with_rewards(rows, models(spark, sf_dir)).select("row_id", "reward", "reward_oof"), 12)


@query(CALIBRATED + " select round(sqrt(avg((reward_oof - oracle_label) * (reward_oof - oracle_label))), 6) as rmse_oof, round(avg(case when abs(reward_oof - oracle_label) <= 0.1 then 1.0 else 0.0 end), 6) as within_tenth, round(sqrt(avg((reward - oracle_label) * (reward - oracle_label))), 6) as rmse, count(*) as n_oracle from cal where oracle_label is not null")
def c1_calibration_metrics(spark, sf_dir):
    rows = bridge.logged(spark, sf_dir).withColumn("fold", estimators.fold_of(F.col("prompt_id")))
    gap = F.col("reward_oof") - F.col("oracle_label")
    return rounded(estimators.with_rewards(rows, models(spark, sf_dir)).where("oracle_label is not null").agg(F.sqrt(F.avg(gap * gap)).alias("rmse_oof"), F.avg((F.abs(gap) <= 0.1).cast("double")).alias("within_tenth"), F.sqrt(F.avg(F.pow(F.col("reward") - F.col("oracle_label"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n_oracle")))


# 2.8 estimators


@query(SQL + ", psi as (select policy, sum(w * judge_score) / sum(w) as psi from w group by 1) select policy, count(*) as n, round(any_value(psi), 6) as estimate, round(stddev_samp(w * (judge_score - psi) - psi * (w - 1)) / sqrt(count(*)), 6) as se_naive from w join psi using (policy) group by policy")
def e0_value_of_logged_scores(spark, sf_dir):
    rows = weighted(spark, sf_dir).withColumns({"fold": estimators.fold_of(F.col("prompt_id")), "reward": F.col("judge_score"), "reward_oof": F.col("judge_score")})
    return rounded(estimators.cluster_robust(estimators.raw_ips(rows)).select("policy", "n", "estimate", "se_naive"))


@query(CALIBRATED + """, psi as (select policy, sum(w * reward) / sum(w) as psi from scored group by 1), phis as (select policy, fold, w * reward as c, w * (reward_oof - psi) - psi * (w - 1) as p from scored join psi using (policy)),
centred as (select *, p - avg(p) over (partition by policy) as phi from phis), sums as (select policy, fold, sum(phi) as t from centred group by 1, 2), spread as (select policy, 5.0 / 4 * (sum(t * t) - 5 * avg(t) * avg(t)) as v, count(*) as groups from sums group by 1)
select policy, count(*) as n, round(avg(c), 6) as estimate, round(stddev_samp(phi) / sqrt(count(*)), 6) as se_naive, round(sqrt(greatest(any_value(v), 0)) / count(*), 6) as se_cluster, any_value(groups) as groups from centred join spread using (policy) group by policy""")
def e1_raw_ips(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.raw_ips(scored(spark, sf_dir))))


@query(IPS + ", " + errors("ips") + ERRORS)
def e2_calibrated_ips(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.calibrated_ips(calibrated(spark, sf_dir))))


@query(OUTCOMES + ", " + summary("dr", "q + w_cal * (reward - g)"))
def e4_dr_cpo(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.dr_cpo(outcomes(spark, sf_dir))))


@query(OUTCOMES + " select policy, round((coalesce(sum(case when draws > 1 then draw_var / draws end), 0) + least(coalesce(var_samp(q), 0.25), 0.25) * count(*) filter (where draws <= 1)) / (count(*) * count(*)), 9) as mc_var from dr group by policy")
def e4a_draw_variance(spark, sf_dir):
    return rounded(estimators.draw_variance(outcomes(spark, sf_dir)), 9)


MRDR = ", " + iso("mr", "select policy || '-' || f.k as k, judge_score as x, reward as y, greatest(w_cal, 1e-8) as w from dr cross join (select unnest([0, 1, 2, 3, 4]) as k) f where fold <> f.k") + ", " + pred("pm", "mr", "select policy || '-' || fold as k, judge_score as x from dr")


@query(OUTCOMES + MRDR + ", " + summary("(select dr.*, greatest(0.0, least(1.0, pm.y)) as gm from dr join pm on pm.k = policy || '-' || fold and pm.x = judge_score)", "q + w_cal * (reward - gm)"))
def e5_mrdr(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.dr_cpo(estimators.weighted_outcome(outcomes(spark, sf_dir)))))


TMLE = ", tz as (select *, ln(least(greatest(g, 1e-7), 1 - 1e-7) / (1 - least(greatest(g, 1e-7), 1 - 1e-7))) as z from dr), te(i, policy, eps) as (select 0, policy, 0.0::double from dr group by policy union all select te.i + 1, tz.policy, any_value(te.eps) + greatest(-5.0, least(5.0, sum(w_cal * (reward - 1 / (1 + exp(-(z + te.eps * w_cal))))) / sum(w_cal * w_cal / (1 + exp(-(z + te.eps * w_cal))) * (1 - 1 / (1 + exp(-(z + te.eps * w_cal))))))) from tz join te on te.policy = tz.policy where te.i < 12 group by te.i, tz.policy), tf as (select tz.*, 1 / (1 + exp(-(z + te.eps * w_cal))) as gt from tz join te on te.policy = tz.policy and te.i = 12)"


@query((OUTCOMES + TMLE + ", " + summary("tf", "q + w_cal * (reward - gt)")).replace("with logged", "with recursive logged", 1).replace("round(estimate, 6)", "round(estimate, 5)").replace("round(se_naive, 6)", "round(se_naive, 5)").replace("round(se_cluster, 6)", "round(se_cluster, 5)"))
def e6_tmle(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.tmle(outcomes(spark, sf_dir))), 5)


def mean_weight(rows: str) -> str:
    """CTEs ending in orth: rows with m, the cross-fitted mean weight given the score."""
    return ", " + iso("mw", f"select policy || '-' || f.k as k, judge_score as x, w as y, 1.0 as w from {rows} cross join (select unnest([0, 1, 2, 3, 4]) as k) f where fold <> f.k") + ", " + pred("pw", "mw", f"select policy || '-' || fold as k, judge_score as x from {rows}") + f", orth as (select *, greatest(m0_, 0) / avg(greatest(m0_, 0)) over (partition by policy) as m from (select r.*, pw.y as m0_ from {rows} r join pw on pw.k = policy || '-' || fold and pw.x = judge_score))"


MEAN_WEIGHT = mean_weight("dr")


@query(WEIGHTS + mean_weight("wcal") + ", " + summary("orth", "w_cal * reward + (w - m) * (reward - reward_oof) + reward_oof * (w - w_cal)"))
def e3_orthogonalised_ips(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.orthogonalised_ips(written(calibrated(spark, sf_dir), "calibrated"))))


@query(OUTCOMES + MEAN_WEIGHT + ", " + summary("orth", "q + w_cal * (reward_oof - g) + (w - w_cal) * (reward_oof - g) + (w - m) * (reward - reward_oof)"))
def e7_orthogonalised_dr(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.orthogonalised_dr(outcomes(spark, sf_dir))))


LABEL_CHANCE = ", " + iso("ml", "select policy || '-' || f.k as k, judge_score as x, case when oracle_label is null then 0.0 else 1.0 end as y, 1.0 as w from dr cross join (select unnest([0, 1, 2, 3, 4]) as k) f where fold <> f.k") + ", " + pred("pl", "ml", "select policy || '-' || fold as k, judge_score as x from dr")


@query(OUTCOMES + MEAN_WEIGHT + LABEL_CHANCE + ", " + summary("(select orth.*, greatest(0.001, least(0.999, pl.y)) as pi from orth join pl on pl.k = policy || '-' || fold and pl.x = judge_score)", "q + w * (reward - g) + case when oracle_label is null then 0 else m * (oracle_label - reward) / pi end"))
def e8_tr_cpo(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.tr_cpo(outcomes(spark, sf_dir))))


@query()
def e9_stacked_dr(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    parts = {"dr": estimators.dr_cpo(rows), "mrdr": estimators.dr_cpo(estimators.weighted_outcome(rows)), "tmle": estimators.tmle(rows)}
    return rounded(estimators.cluster_robust(estimators.stacked(parts)), 5)


@query(CALIBRATED + ", " + pred("pj", "mk", "select f.k, judge_score as x from logged cross join (select unnest([0, 1, 2, 3, 4]) as k) f") + ", psis as (select policy, pj.k, avg(s.w * greatest(0.0, least(1.0, pj.y))) as psi from scored s join pj on pj.x = s.judge_score group by 1, 2) select policy, round(4.0 / 5 * (sum(psi * psi) - 5 * avg(psi) * avg(psi)), 9) as oracle_var from psis group by policy")
def e10_oracle_jackknife(spark, sf_dir):
    m = models(spark, sf_dir)
    return rounded(estimators.jackknife(scored(spark, sf_dir, m), m, F.col("w") * F.col("r")), 9)


# 2.9 inference and diagnostics

RANKED = SQL + ", ranked as (select *, row_number() over (partition by policy order by w desc, row_id) as rn, count(*) over (partition by policy) as n, sum(w) over (partition by policy) as total from w)"
HILL = RANKED + ", hill as (select policy, k, k / (sum(case when rn <= k then ln(w) end) - k * max(case when rn = k + 1 then ln(w) end)) as alpha from (select *, least(greatest(10, floor(n * 0.05)), floor(n * 0.1)) as k from ranked) where rn <= k + 1 group by policy, k)"


@query(SQL + " select policy, round(sum(w) * sum(w) / sum(w * w), 6) as ess from w group by policy")
def d1_effective_sample_size(spark, sf_dir):
    return rounded(weighted(spark, sf_dir).groupBy("policy").agg(diagnostics.ess(F.col("w")).alias("ess")))


@query(SQL + " select policy, case when quantile_cont(w, 0.05) <= 1e-12 then 'inf'::double else round(quantile_cont(w, 0.99) / quantile_cont(w, 0.05), 6) end as ratio from w group by policy")
def d2_tail_ratio(spark, sf_dir):
    return rounded(diagnostics.tail_ratio(weighted(spark, sf_dir)))


@query(RANKED + " select policy, round(sum(w) / any_value(total), 6) as share from ranked where rn <= greatest(1, floor(n * 0.01)) group by policy")
def d3_mass_concentration(spark, sf_dir):
    return rounded(diagnostics.mass_concentration(weighted(spark, sf_dir)))


@query(HILL + " select policy, cast(k as bigint) as k, round(alpha, 6) as alpha from hill")
def d4_hill_tail_index(spark, sf_dir):
    return rounded(diagnostics.hill_tail_index(weighted(spark, sf_dir)))


@query(HILL + ", a as (select policy, count(*) as n, sum(w) * sum(w) / sum(w * w) / count(*) as ess_fraction, max(w) as max_w, stddev_pop(w) / avg(w) as cv, avg(case when w < 1e-10 then 1.0 else 0.0 end) as zero_share from w group by 1) select policy, n, round(ess_fraction, 6) as ess_fraction, round(max_w, 6) as max_w, round(cv, 6) as cv, round(zero_share, 6) as zero_share, round(alpha, 6) as alpha, case when ess_fraction < 0.01 or alpha < 1 then 'critical' when ess_fraction < 0.1 or alpha < 2 then 'warning' else 'good' end as status from a join hill using (policy)")
def d6_weight_diagnostics(spark, sf_dir):
    return rounded(diagnostics.weight_diagnostics(weighted(spark, sf_dir)))


@query(SQL + " select policy, round(least(1.0, avg(sqrt(greatest(w, 1e-10)))), 6) as affinity from w group by policy")
def d7_hellinger_affinity(spark, sf_dir):
    return rounded(diagnostics.hellinger(weighted(spark, sf_dir)))


@query(HILL + ", a as (select policy, least(1.0, avg(sqrt(greatest(w, 1e-10)))) as affinity, sum(w) * sum(w) / sum(w * w) / count(*) as e from w group by 1) select policy, round(affinity, 6) as affinity, round(e, 6) as ess_fraction, round(alpha, 6) as alpha, case when affinity < 0.2 then 'catastrophic' when affinity < 0.35 then 'poor' when affinity < 0.5 then 'marginal' else 'good' end as quality, case when affinity < 0.2 then 'refuse' when alpha < 1.5 then 'dr' when e < 0.1 then case when affinity < 0.35 then 'refuse' else 'dr' end when e < 0.3 then 'calibrated-ips' else 'ips' end as recommendation, case when e > 0.001 then round(1 / sqrt(e), 6) else 'inf'::double end as penalty from a join hill using (policy)")
def d9_overlap_card(spark, sf_dir):
    return rounded(diagnostics.overlap_card(weighted(spark, sf_dir)))


@query(OUTCOMES + ", z as (select policy, avg(w_cal * (reward - g)) as score, stddev_pop(w_cal * (reward - g)) / sqrt(count(*)) as se from dr group by 1) select policy, round(score, 6) as score, round(se, 6) as se, round(score / se, 4) as z, round(score - 1.959963984540054 * se, 6) as lo, round(score + 1.959963984540054 * se, 6) as hi from z")
def d13_orthogonality(spark, sf_dir):
    return diagnostics.orthogonality(outcomes(spark, sf_dir)).select("policy", F.round("score", 6).alias("score"), F.round("se", 6).alias("se"), F.round("z", 4).alias("z"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(SQL + ", a as (select row_id % 200 as batch, judge_score as x, oracle_label as y from logged where oracle_label is not null) select p.batch, (select count(*) from a c where c.batch = p.batch) as n, round(sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))), 6) as tau from a p join a q on p.batch = q.batch group by p.batch")
def d25_kendall_by_batch(spark, sf_dir):
    rows = bridge.logged(spark, sf_dir).where("oracle_label is not null").select((F.col("row_id") % 200).alias("batch"), "judge_score", F.col("oracle_label").alias("y"))
    return rounded(diagnostics.kendall(rows, "batch", "judge_score", "y"))


#: Of batches BATCH: tau, the normal deviate z, s and whether nothing is tied, as CTE k; then p, counted out over all orders (mah: their numbers by
#: pairs out of order) or normal.
KENDALL = ", a as (select BATCH as batch, judge_score as x, oracle_label as y from logged where oracle_label is not null), n as (select batch, cast(count(*) as double) as n from a group by 1), tx as (select batch, sum(c * (c - 1)) as p, sum(c * (c - 1) * (c - 2)) as q, sum(c * (c - 1) * (2 * c + 5)) as r from (select batch, x, cast(count(*) as double) as c from a group by 1, 2) group by 1), ty as (select batch, sum(c * (c - 1)) as p, sum(c * (c - 1) * (c - 2)) as q, sum(c * (c - 1) * (2 * c + 5)) as r from (select batch, y, cast(count(*) as double) as c from a group by 1, 2) group by 1), s as (select p.batch, sum(sign(p.x - q.x) * sign(p.y - q.y)) as s, sum(abs(sign(p.x - q.x))) as sx, sum(abs(sign(p.y - q.y))) as sy from a p join a q on p.batch = q.batch group by p.batch), k as (select batch, n, case when sx > 0 and sy > 0 then s / sqrt(sx * sy) end as tau, s / 2 as s, tx.p = 0 and ty.p = 0 as untied, s / 2 / sqrt((n * (n - 1) * (2 * n + 5) - tx.r - ty.r) / 18 + tx.p * ty.p / (2 * n * (n - 1)) + tx.q * ty.q / (9 * n * (n - 1) * (n - 2))) as z from s join n using (batch) join tx using (batch) join ty using (batch))"
MAHONIAN = ", mah(m, c, ways) as (select 1, 0, 1.0::double union all select m + 1, c + j, sum(ways) from mah, range(0, 33) t(j) where j <= m and m < 33 group by m + 1, c + j), kc as (select *, cast(least((n * (n - 1) / 2 - s) / 2, n * (n - 1) / 2 - (n * (n - 1) / 2 - s) / 2) as bigint) as least_ from k), kp as (select batch, n, tau, z, untied, s, case when untied and n <= 33 then case when 4 * least_ = n * (n - 1) or n < 2 then 1.0 else (select least(1.0, 2 * sum(case when c <= least_ then ways else 0 end) / sum(ways)) from mah where m = n) end else " + two_sided("z") + " end as p from kc)"
DRIFT = " select batch, cast(n as bigint) as n, round(tau, 6) as tau, case when tau is not null then round(p, 6) end as p_value, coalesce(p < 0.05 and tau < 0.8, false) as drift, case when tau is null then 'unknown' when tau > 0.9 then 'excellent' when tau > 0.8 then 'good' when tau > 0.6 then 'moderate drift' when tau > 0.4 then 'significant drift' else 'severe drift' end as level from kp"


@query((SQL + KENDALL.replace("BATCH", "row_id % 200") + MAHONIAN + DRIFT).replace("with logged", "with recursive logged", 1))
def d25_drift_by_batch(spark, sf_dir):
    rows = bridge.logged(spark, sf_dir).where("oracle_label is not null").select((F.col("row_id") % 200).alias("batch"), "judge_score", F.col("oracle_label").alias("y"))
    return rounded(diagnostics.kendall_drift(rows, "batch", "judge_score", "y", counted=True))


@query((SQL + KENDALL.replace("BATCH", "row_id // 40") + MAHONIAN + DRIFT).replace("with logged", "with recursive logged", 1))
def d25_drift_of_small_batches(spark, sf_dir):
    """Ten labels a batch: p is counted out where nothing is tied."""
    rows = bridge.logged(spark, sf_dir).where("oracle_label is not null").select(F.floor(F.col("row_id") / 40).alias("batch"), "judge_score", F.col("oracle_label").alias("y"))
    return rounded(diagnostics.kendall_drift(rows, "batch", "judge_score", "y", counted=True))


@query(SQL + ", b as (select least(floor(judge_score * 10), 9) as bin, judge_score, oracle_label from logged where oracle_label is not null), a as (select bin, count(*) as n, avg(judge_score) as confidence, avg(oracle_label) as accuracy from b group by 1) select cast(r.i as integer) as bin, coalesce(n, 0) as n, round(coalesce(confidence, (r.i + 0.5) / 10), 6) as confidence, round(coalesce(accuracy, 0.0), 6) as accuracy from (select unnest(range(10)) as i) r left join a on a.bin = r.i")
def d28_reliability(spark, sf_dir):
    return rounded(diagnostics.reliability(bridge.logged(spark, sf_dir), "judge_score", "oracle_label"))


@query(SQL + ", b as (select least(floor(judge_score * 10), 9) as bin, judge_score as p, oracle_label as y from logged where oracle_label is not null), a as (select bin, count(*) as n, abs(avg(p) - avg(y)) as gap from b group by 1) select round(sum(n * gap) / sum(n), 6) as ece, round(max(gap), 6) as mce, (select round(avg((p - y) * (p - y)), 6) from b) as brier from a")
def v1_calibration_error(spark, sf_dir):
    return rounded(diagnostics.calibration_error(bridge.logged(spark, sf_dir), "judge_score", "oracle_label"))


@query(SQL + " select policy, prompt_id, count(*) as n, round(avg(judge_score), 9) as mean, round(coalesce(var_samp(judge_score), 0), 9) as var from fresh group by 1, 2")
def d31_draw_statistics(spark, sf_dir):
    return rounded(diagnostics.draw_statistics(bridge.fresh(spark, sf_dir)), 9)


@query(OUTCOMES + """, span as (select min(judge_score) as lo, max(judge_score) as hi, min(reward) as r_lo, max(reward) as r_hi from cal where oracle_label is not null),
gap as (select policy, abs(avg(q + w_cal * (reward - g)) - any_value(ips)) as gap from dr join (select policy, avg(w_cal * reward) as ips from wcal group by 1) using (policy) group by policy),
a as (select policy, avg(case when judge_score < lo then 1.0 else 0.0 end) as below, avg(case when judge_score > hi then 1.0 else 0.0 end) as above, avg(case when reward <= r_lo + 0.05 * (r_hi - r_lo) or reward >= r_hi - 0.05 * (r_hi - r_lo) then 1.0 else 0.0 end) as saturated, any_value(r_lo) as r_lo, any_value(r_hi) as r_hi from wcal cross join span group by 1)
select policy, round(below + above, 6) as outside, round(saturated, 6) as saturated, round(gap, 6) as gap, case when below + above > 0 then round(below * r_lo + above * (1 - r_hi), 6) end as width, case when below + above >= 0.05 then 'REFUSE-LEVEL' when saturated >= 0.2 or gap >= 0.1 then 'CAUTION' else 'OK' end as verdict from a join gap using (policy)""")
def d30_boundary_card(spark, sf_dir):
    m = models(spark, sf_dir)
    rows = outcomes(spark, sf_dir, m)
    labelled = estimators.with_rewards(bridge.logged(spark, sf_dir).where("oracle_label is not null").withColumn("fold", estimators.fold_of(F.col("prompt_id"))), m)
    gap = rows.groupBy("policy").agg(F.avg(F.col("q") + F.col("w_cal") * (F.col("reward") - F.col("g"))).alias("dr"), F.avg(F.col("w_cal") * F.col("reward")).alias("ips"))
    return rounded(diagnostics.boundary_card(rows, labelled, gap.select("policy", F.abs(F.col("dr") - F.col("ips")).alias("gap"))))
