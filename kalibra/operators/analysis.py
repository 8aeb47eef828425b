"""From a log, and fresh draws where there are any, to policy values with intervals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import jsonl
from . import calibration, diagnostics, estimators, inference, jackknife, outcomes, residuals, weights
from .order_stats import quantiles
from .tables import written

#: Contributions by estimator name, from rows of estimators.stabilised(), with outcomes for those that need fresh draws.
DIRECT: dict[str, Callable[[DataFrame], DataFrame]] = {"raw-ips": estimators.raw_ips, "calibrated-ips": estimators.calibrated_ips, "orthogonalized-ips": estimators.orthogonalised_ips}
ROBUST: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dr-cpo": estimators.dr_cpo, "oc-dr-cpo": estimators.orthogonalised_dr, "mrdr": lambda rows: estimators.dr_cpo(estimators.weighted_outcome(rows)), "tmle": estimators.tmle,
    "tr-cpo": lambda rows: estimators.tr_cpo(rows, efficient=False), "tr-cpo-e": estimators.tr_cpo, "stacked-dr": lambda rows: stacked_dr(rows)[0],
}
REGISTRY = {**DIRECT, **ROBUST}
#: Parts of the stacked estimator, and its least number of rows a policy.
STACK, LEAST_ROWS = ("dr-cpo", "tmle", "mrdr"), 10
#: Weights of raw-ips beyond this are cut to it, after which they have mean one again.
CLIP = 100.0


def stacked_dr(rows: DataFrame, components: tuple[str, ...] = STACK, least_rows: int = LEAST_ROWS, draw_var: DataFrame | None = None) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """The components stacked, and their weights by policy; a single one is given as it is, and policies with fewer than least_rows rows are
    left out."""
    counts = [r["policy"] for r in rows.groupBy("policy").count().collect() if r["count"] >= least_rows]  # a row a policy
    rows = rows.where(F.col("policy").isin(counts))
    parts = {name: ROBUST[name](rows) for name in components}
    if len(parts) == 1:
        return next(iter(parts.values())), {p: {components[0]: 1.0} for p in counts}
    return estimators.stacking(parts, draw_var=draw_var)


def prepared_rewards(logged: DataFrame, mode: str = "auto") -> tuple[DataFrame, calibration.Calibration | None]:
    """Rows with fold, reward and reward_oof, and the models.

    Rewards that all rows have are taken as they are. Otherwise judge scores are calibrated on the labels, cross-fitted, in the mode asked for or the
    one whose errors are less (auto), and rewards that only some rows have are replaced. Where all rows are labelled the labels are the rewards.
    """
    rows = logged.withColumn("fold", estimators.fold_of(F.col("prompt_id")))
    known = F.count("reward") if "reward" in logged.columns else F.lit(0)
    rewarded, n, labelled = logged.agg(known, F.count(F.lit(1)), F.count("oracle_label")).first()
    if rewarded == n:
        return rows.withColumn("reward_oof", F.col("reward")), None
    if not labelled:
        raise ValueError("rewards are missing and there are no labels to calibrate judge scores on")
    models = calibration.fit(rows, mode)
    out = calibration.apply(rows.drop("reward"), models)
    return (out.withColumn("reward", F.col("oracle_label").cast("double")) if labelled == n else out), models


def analyze_many(logged: DataFrame, fresh: DataFrame | None, names: list[str], policies: list[str] | None = None, alpha: float = 0.05, mode: str = "auto", outcome: outcomes.SumsModel | outcomes.Isotonic | None = None, refuse: bool = False, residualise: str | None = None) -> DataFrame:
    """(estimator, policy, n, estimate, se_naive, se_cluster, groups, oracle_var, draw_var, se, lo, hi): each of the named estimators on one
    preparation of the rows.

    logged: (row_id, prompt_id, base_lp, target_lps, judge_score, oracle_label and, where rewards are known, reward); fresh:
    (prompt_id, policy, draw_idx, judge_score). Estimators of ROBUST need fresh. Rows without a log-probability of the base or of
    any policy don't count. Errors hold those of clusters, of the labels (each estimator's own jackknife; none where all rows are labelled or
    rewards were given) and of the draws. outcome: the outcome model; the calibration's own fold models by default, the rising fit of
    rewards on scores where rewards were given. refuse: policies whose weights fail the gates (diagnostics.refusal_gates) get no value and no errors, and a
    column refused tells which. residualise: spline or isotonic; the influence less what the score explains of it then makes the errors of
    clusters, values stay.
    """
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"unknown estimator {unknown[0]}; there are {', '.join(REGISTRY)}")
    robust = [n for n in names if n in ROBUST]
    if robust and fresh is None:
        raise ValueError(f"{robust[0]} needs fresh draws")
    policies = policies or jsonl.policies_of(logged)
    scored, models = prepared_rewards(logged, mode)
    rows = written(weights.hajek(weights.by_policy(weights.valid_rows(scored, policies)).where(F.col("policy").isin(policies))), "scored")
    rows = direct = written(estimators.stabilised(rows), "calibrated")
    draw_var = None
    if robust:
        if models is None or outcome is not None:
            rows = outcomes.with_model(rows, fresh, outcomes.fit(rows, outcome or outcomes.Isotonic()))
        else:
            rows = estimators.with_outcomes(rows, fresh, models)
        rows = written(rows, "outcomes")
        draw_var = written(estimators.draw_variance(rows), "draw-variance")
    found = {}
    for name in names:
        own = rows if name in ROBUST else weights.clipped(direct, CLIP) if name == "raw-ips" else direct  # prompts without draws count where none are needed
        found[name] = stacked_dr(own, draw_var=draw_var)[0] if name == "stacked-dr" else REGISTRY[name](own)
        if residualise:
            found[name] = residuals.residualised(found[name], own, residualise)[0]
    oracle = oracle_variances(direct, rows, fresh, models, names, draw_var) if models is not None and logged.where("oracle_label is null").limit(1).count() else None
    out = None
    for name, c in found.items():
        own = oracle.where(F.col("estimator") == name).drop("estimator") if oracle is not None else None
        one = inference.with_intervals(c, own, draw_var if name in ROBUST else None, alpha).select(F.lit(name).alias("estimator"), "*")
        out = one if out is None else out.unionByName(one)
    if not refuse:
        return out
    gates = written(diagnostics.refusal_gates(rows).select("policy", "refused"), "gates")
    kept = ("estimator", "policy", "n", "groups", "refused")
    return out.join(F.broadcast(gates), "policy", "left").select(*[F.col(c) if c in kept else F.when(~F.col("refused"), F.col(c)).alias(c) for c in (*out.columns, "refused")])


def oracle_variances(direct: DataFrame, rows: DataFrame, fresh: DataFrame | None, models, names: list[str], draw_var: DataFrame | None = None) -> DataFrame:
    """(policy, estimator, oracle_var): the jackknife over the labels' folds of each named estimator; the stacked one combines its parts at
    their weights. direct: the rows of estimators without draws, rows: those of the others."""
    stack = "stacked-dr" in names
    robust = [n for n in ROBUST if n != "stacked-dr" and (n in names or (stack and n in STACK))]
    kinds = [(weights.clipped(direct, CLIP), [n for n in names if n == "raw-ips"]), (direct, [n for n in names if n in DIRECT and n != "raw-ips"]), (rows, robust)]
    found = [jackknife.paths(own, fresh, models, named) for own, named in kinds if named]
    found = written(reduce(DataFrame.unionByName, found), "jackknife")
    if stack:
        found = found.unionByName(jackknife.combined(found, stacked_dr(rows, draw_var=draw_var)[1]))
    return written(jackknife.variance(found), "oracle-variance")


def analyze_tables(logged: DataFrame, fresh: DataFrame | None = None, estimator: str = "stacked-dr", policies: list[str] | None = None, alpha: float = 0.05, mode: str = "auto", outcome: outcomes.SumsModel | outcomes.Isotonic | None = None, refuse: bool = False, residualise: str | None = None) -> DataFrame:
    """analyze_many() of one estimator."""
    return analyze_many(logged, fresh, [estimator], policies, alpha, mode, outcome, refuse, residualise).drop("estimator")


def analyze(spark: SparkSession, log_path: str, fresh_path: str | None = None, estimator: str | None = None, judge_field: str = "judge_score", oracle_field: str = "oracle_label", alpha: float = 0.05) -> DataFrame:
    """analyze_tables() of JSON-lines files; stacked-dr by default, or calibrated-ips where there are no fresh draws."""
    logged = written(jsonl.read_logged(spark, log_path, judge_field, oracle_field)[0], "log")  # row ids are settled here
    fresh = jsonl.read_fresh(spark, fresh_path) if fresh_path else None
    return analyze_tables(logged, fresh, estimator or ("stacked-dr" if fresh is not None else "calibrated-ips"), alpha=alpha)


def calibration_summary(rows: DataFrame) -> DataFrame:
    """One row of what calibration did (rows: judge_score, oracle_label, reward, reward_oof): numbers of labels, errors in and out
    of fold, range and levels of rewards, and how many rows below the scores' 10 and 20 per cent quantiles are labelled."""
    scores = written(rows.select(F.lit("all").alias("policy"), F.col("judge_score").cast("double").alias("w")), "scores")
    low = quantiles(scores, (0.1, 0.2))
    q = low.agg(F.array(*[F.max(F.when(F.col("p") == p, F.col("q"))) for p in (0.1, 0.2)]).alias("q"))
    y, gap = F.col("oracle_label"), lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("oracle_label"), 2)))
    covered = lambda i: F.avg(F.when(F.col("judge_score") <= F.col("q")[i], y.isNotNull().cast("double")))
    return rows.crossJoin(F.broadcast(q)).agg(  # one row
        F.count(F.lit(1)).alias("n"), F.count(y).alias("n_labels"), gap("reward").alias("rmse"), gap("reward_oof").alias("rmse_oof"), F.min("reward").alias("f_min"), F.max("reward").alias("f_max"),
        F.countDistinct(F.round("reward", 6)).alias("levels"), covered(0).alias("covered_10"), covered(1).alias("covered_20"),
    )
