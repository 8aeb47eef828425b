"""Further queries over the bridge tables: gates, stability, decompositions, drift, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics, estimators, splines
from . import bridge
from .bridge import SQL
from .oracle_sql import OUTCOMES, WEIGHTS, summary
from ..operators.tables import written
from .queries import MEAN_WEIGHT, RANKED, calibrated, outcomes, query, rounded, scored, weighted
from .report_queries import RUNS_SQL, first


def _hill(f: float) -> str:
    return f"select policy, k / (sum(case when rn <= k then ln(w) end) - k * max(case when rn = k + 1 then ln(w) end)) as alpha from (select *, least(greatest(10, floor(n * {f})), floor(n * 0.1)) as k from ranked) where rn <= k + 1 group by policy, k"


@query(RANKED + ", h as (" + " union all ".join(map(_hill, (0.01, 0.02, 0.05, 0.1))) + ") select policy, round(median(alpha), 6) as median, round(min(alpha), 6) as least, round(max(alpha), 6) as most, round(stddev_pop(alpha), 6) as spread from h group by 1")
def d5_hill_stability(spark, sf_dir):
    return rounded(diagnostics.hill_stability(written(weighted(spark, sf_dir), "weights")))


@query(SQL + " select policy, count(*) as n, round(least(1.0, greatest(0.001, 0.9604 / (count(*) * 0.05 * 0.05))), 9) as critical, round(least(1.0, greatest(0.001, 0.9604 / (count(*) * 0.05 * 0.05) * 0.5)), 9) as warning from w group by 1")
def d8_auto_thresholds(spark, sf_dir):
    n = weighted(spark, sf_dir).groupBy("policy").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.select("policy", "n", diagnostics.auto_threshold(F.col("n"), 0.05).alias("critical"), diagnostics.auto_threshold(F.col("n"), 0.05, "warning").alias("warning")), 9)


@query(WEIGHTS + ", r as (select policy, w_cal, w, row_number() over (partition by policy order by w_cal desc, row_id) as rn, count(*) over (partition by policy) as n, sum(w_cal) over (partition by policy) as total from wcal), t as (select policy, sum(w_cal) / any_value(total) as top_share from r where rn <= greatest(1, floor(n * 0.05)) group by 1), a as (select policy, sum(w_cal) * sum(w_cal) / sum(w_cal * w_cal) / count(*) as e, avg(case when w < 1e-10 then 1.0 else 0.0 end) as z, stddev_pop(w_cal) / avg(w_cal) as cv from r group by 1) select policy, round(e, 6) as ess_fraction, round(z, 6) as zero_share, round(top_share, 6) as top_share, round(cv, 6) as cv, e < 0.3 or z > 0.85 or (top_share > 0.3 and cv > 2) as refused from a join t using (policy)")
def e2a_refusal_gates(spark, sf_dir):
    return rounded(diagnostics.refusal_gates(written(calibrated(spark, sf_dir), "calibrated")))


@query(OUTCOMES + ", e as (select policy, sum(w_cal * (reward - g)) / sum(w_cal * w_cal) as eps from dr group by 1), " + summary("(select dr.*, eps from dr join e using (policy))", "q + w_cal * (reward - g - eps * w_cal)"))
def e6_tmle_identity(spark, sf_dir):
    return rounded(estimators.cluster_robust(estimators.tmle_identity(outcomes(spark, sf_dir))))


@query(OUTCOMES + " select policy, round(avg(q), 6) as model, round(avg(w_cal * (reward - g)), 6) as weighted, round(stddev_pop(q) / sqrt(count(*)), 6) as model_se, round(stddev_pop(w_cal * (reward - g)) / sqrt(count(*)), 6) as weighted_se, round(corr(q, w_cal * (reward - g)), 6) as correlation from dr group by 1")
def d14_decomposition(spark, sf_dir):
    return rounded(diagnostics.decomposition(outcomes(spark, sf_dir)))


@query(OUTCOMES + MEAN_WEIGHT + ", p as (select policy, avg(case when oracle_label is null then 0.0 else 1.0 end) as p from orth group by 1) select policy, round(any_value(p), 6) as p, round(avg(case when oracle_label is null then 0 else m * (oracle_label - reward) / p end), 6) as augmentation from orth join p using (policy) group by policy")
def c14_oracle_slice(spark, sf_dir):
    return rounded(estimators.oracle_slice(outcomes(spark, sf_dir)))


@query()
def a16_bootstrap(spark, sf_dir):
    return rounded(estimators.bootstrap_means(estimators.raw_ips(scored(spark, sf_dir))), 5)


@query(SQL + ", r as (select policy, w, sum(w) over (partition by policy order by w desc, row_id) as mass, sum(w) over (partition by policy) as total from w) select policy, s as share, 1 + count(*) filter (where mass < s * total - 1e-9) as rows from r cross join (select unnest([0.5, 0.9]::double[]) as s) group by 1, 2")
def v2_mass_points(spark, sf_dir):
    return diagnostics.mass_points(weighted(spark, sf_dir))


@query(SQL + ", b as (select row_id // 500 as batch, row_id % 500 as place, judge_score as v from logged) select p.batch, count(distinct p.place) as n, round(sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))), 6) as tau from (select a.batch, a.place, a.v as x, c.v as y from b a join b c on a.batch + 1 = c.batch and a.place = c.place) p join (select a.batch, a.place, a.v as x, c.v as y from b a join b c on a.batch + 1 = c.batch and a.place = c.place) q on p.batch = q.batch group by 1")
def d26_sequential_drift(spark, sf_dir):
    rows = bridge.logged(spark, sf_dir).select(F.floor(F.col("row_id") / 500).alias("batch"), (F.col("row_id") % 500).alias("place"), "judge_score")
    return rounded(diagnostics.sequential_drift(rows, "batch", "place", "judge_score"))


@query(RUNS_SQL + " select run_id, policy from runs1 where n in (250, 500) and round(coverage, 2) in (0.05, 0.1)")
def f12_regime_filter(spark, sf_dir):
    return first(spark, sf_dir).where(F.col("n").isin(250, 500) & F.round("coverage", 2).isin(0.05, 0.1)).select("run_id", "policy")


@query("select doc_id from documents where regexp_matches(lower(text), 'worthless|pathetic') or strpos(lower(text), 'idiot') > 0")
def f13_blocked_prompts(spark, sf_dir):
    t = F.lower("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(t.rlike("worthless|pathetic") | t.contains("idiot")).select("doc_id")


@query(SQL + " select policy, round(least(coalesce(m, 0) * (1 - coalesce(m, 0)), 0.25) / n, 12) as oracle_var, n from (select policy, avg(judge_score) as m, count(*) as n from fresh group by 1)")
def a19_oracle_variance(spark, sf_dir):
    a = bridge.fresh(spark, sf_dir).groupBy("policy").agg(F.avg("judge_score").alias("m"), F.count(F.lit(1)).alias("n"))
    return rounded(a.select("policy", (F.least(F.col("m") * (1 - F.col("m")), F.lit(0.25)) / F.col("n")).alias("oracle_var"), "n"), 12)


@query("select e.estimator, s.seed, c.n from (select unnest(['ips', 'dr', 'tmle']) as estimator) e cross join (select unnest(range(5)) as seed) s cross join (select unnest([250, 500, 1000]) as n) c where not (estimator = 'tmle' and n = 250)")
def a25_experiment_grid(spark, sf_dir):
    one = lambda values, name, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    grid = one(["ips", "dr", "tmle"], "estimator", "string").crossJoin(one(range(5), "seed", "long")).crossJoin(one([250, 500, 1000], "n", "int"))
    return grid.where(~((F.col("estimator") == "tmle") & (F.col("n") == 250)))


@query()
def is4_spline_smoother(spark, sf_dir):
    rows = bridge.logged(spark, sf_dir)
    smooth = splines.fit(rows, "judge_score", "oracle_label")
    return rounded(splines.predict(rows.select("judge_score").distinct(), smooth, "judge_score", "smooth"), 5)
