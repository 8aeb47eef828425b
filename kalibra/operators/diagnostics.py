"""How far weights, scores and estimates can be trusted."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import kendall_exact, normal_ppf
from .order_stats import kth_largest, quantiles, top_sums
from .tables import running, written

#: fixed values: levels of tau, by what it exceeds
TAU_LEVELS, TAU_LOWEST = ((0.9, "excellent"), (0.8, "good"), (0.6, "moderate drift"), (0.4, "significant drift")), "severe drift"


def ess(w: Column) -> Column:
    return F.pow(F.sum(w), 2) / F.greatest(F.sum(w * w), F.lit(1e-12))


def _status(ess_fraction: Column, tail: Column) -> Column:
    return F.when((ess_fraction < 0.01) | (tail < 1), "critical").when((ess_fraction < 0.1) | (tail < 2), "warning").otherwise("good")


def _weights(rows: DataFrame, w: str = "w") -> DataFrame:
    """(policy, w) written: selections and sums read it again and again."""
    return written(rows.select("policy", F.col(w).cast("double").alias("w")), "weights")


def _tail_size(n: Column, fraction: float | Column, min_k: int = 10) -> Column:
    return F.least(F.greatest(F.lit(min_k), F.floor(n * fraction)), F.floor(n * 0.1)).cast("long")


def mass_concentration(rows: DataFrame, top: float = 0.01, w: str = "w") -> DataFrame:
    """(policy, share): of the sum of weights, what the largest top of rows hold."""
    return _mass(_weights(rows, w), top)


def _mass(own: DataFrame, top: float = 0.01) -> DataFrame:
    total = own.groupBy("policy").agg(F.sum("w").alias("total"), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * top)).cast("long").alias("k"))
    return top_sums(own, total).join(total, ["policy", "k"]).select("policy", (F.col("sum") / F.col("total")).alias("share"))


def hill_tail_index(rows: DataFrame, fraction: float = 0.05, min_k: int = 10) -> DataFrame:
    """(policy, k, alpha): k over the sum of logs above the (k+1)-th largest weight; infinite where there is no tail."""
    return _hill(_weights(rows), (fraction,), min_k).select("policy", "k", F.coalesce("alpha", F.lit(float("inf"))).alias("alpha"))


def _hill(own: DataFrame, fractions: tuple[float, ...] = (0.05,), min_k: int = 10) -> DataFrame:
    """(policy, f, k, alpha) for each fraction of the tail; alpha null where there is none. Ties of the edge add nothing to the sum."""
    n = own.groupBy("policy").agg(F.count(F.lit(1)).alias("n")).withColumn("f", F.explode(F.array(*[F.lit(f) for f in fractions])))
    tails = n.select("policy", "f", (_tail_size(F.col("n"), F.col("f"), min_k) + 1).alias("k"))
    excess = F.col("ln_over") - F.col("over") * F.when(F.col("edge") > 0, F.ln("edge"))
    return kth_largest(own, tails).join(tails, ["policy", "k"]).select("policy", "f", (F.col("k") - 1).alias("k"), F.when(excess > 0, (F.col("k") - 1) / excess).alias("alpha"))


def weight_diagnostics(rows: DataFrame) -> DataFrame:
    """(policy, n, ess_fraction, max_w, cv, zero_share, alpha, status)."""
    return _diagnostics(_weights(rows))


def _diagnostics(own: DataFrame) -> DataFrame:
    a = own.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), (ess(F.col("w")) / F.count(F.lit(1))).alias("ess_fraction"), F.max("w").alias("max_w"), (F.stddev_pop("w") / F.avg("w")).alias("cv"), F.avg((F.col("w") < 1e-10).cast("double")).alias("zero_share"))
    tails = _hill(own).select("policy", F.coalesce("alpha", F.lit(float("inf"))).alias("alpha"))
    return a.join(tails, "policy").withColumn("status", _status(F.col("ess_fraction"), F.col("alpha")))


def hellinger(rows: DataFrame, eps: float = 1e-10) -> DataFrame:
    """(policy, affinity): the mean root of weights of mean 1, at most 1."""
    return rows.groupBy("policy").agg(F.least(F.lit(1.0), F.avg(F.sqrt(F.greatest("w", F.lit(eps))))).alias("affinity"))


def overlap_card(rows: DataFrame) -> DataFrame:
    """(policy, affinity, ess_fraction, alpha, quality, recommendation, penalty). A policy of fewer than 50 rows has no tail index."""
    return _card(_weights(rows))


def _card(own: DataFrame) -> DataFrame:
    a = hellinger(own).join(_diagnostics(own).select("policy", "n", "ess_fraction", "alpha"), "policy").withColumn("alpha", F.when(F.col("n") >= 50, F.col("alpha"))).drop("n")
    quality = F.when(F.col("affinity") < 0.2, "catastrophic").when(F.col("affinity") < 0.35, "poor").when(F.col("affinity") < 0.5, "marginal").otherwise("good")
    scarce = F.when(F.col("quality") == "poor", "refuse").otherwise("dr")
    advice = F.when(F.col("quality") == "catastrophic", "refuse").when(F.col("alpha") < 1.5, "dr").when(F.col("ess_fraction") < 0.1, scarce).when(F.col("ess_fraction") < 0.3, "calibrated-ips").otherwise("ips")
    penalty = F.when(F.col("ess_fraction") > 0.001, 1 / F.sqrt("ess_fraction")).otherwise(F.lit(float("inf")))
    return a.withColumn("quality", quality).withColumn("recommendation", advice).withColumn("penalty", penalty)


def tail_ratio(rows: DataFrame, low: float = 0.05, high: float = 0.99, w: str = "w") -> DataFrame:
    """(policy, ratio) of two quantiles; infinite where the lower one is 1e-12 or less."""
    return _ratio(_weights(rows, w), low, high)


def _ratio(own: DataFrame, low: float = 0.05, high: float = 0.99) -> DataFrame:
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("q")))
    q = quantiles(own, (low, high)).groupBy("policy").agg(at(low).alias("low"), at(high).alias("high"))
    return q.select("policy", F.when(F.col("low") > 1e-12, F.try_divide("high", "low")).otherwise(F.lit(float("inf"))).alias("ratio"))


def extremes(rows: DataFrame, k: int = 5, w: str = "w") -> DataFrame:
    """(policy, row_id, side, w, rn, policies): each policy's k largest and smallest weights, and how many policies' lists a row is in.

    Each task hands on k rows a policy at most, as Spark cuts a window's groups before the shuffle where the rank has a fixed bound.
    """
    own = written(rows.select("policy", "row_id", F.col(w).alias("w")), "weights")
    first = lambda side, order: own.withColumn("side", F.lit(side)).withColumn("rn", F.row_number().over(W.partitionBy("policy").orderBy(order, "row_id"))).where(F.col("rn") <= k)
    both = first("top", F.desc("w")).unionByName(first("bottom", F.asc("w")))
    return both.withColumn("policies", F.count(F.lit(1)).over(W.partitionBy("row_id", "side"))).select("policy", "row_id", "side", "w", "rn", "policies")


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of every bin; an empty one has accuracy 0 and its middle as confidence."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    own = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y)).alias("accuracy"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", (F.col("bin") + 0.5) / bins).alias("confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def calibration_error(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row (ece, mce, brier): the mean and largest gap of bins that have rows, the mean squared error."""
    r, gap = reliability(rows, p, y, bins).where("n > 0"), F.abs(F.col("confidence") - F.col("accuracy"))
    e = r.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    return e.crossJoin(rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier")))


def brier_parts(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row (ece, mce, brier, reliability, resolution, uncertainty, calibrated). Over bins, reliability is the mean squared gap of confidence
    and accuracy, resolution that of accuracy and the base rate, uncertainty the base rate's variance. An empty bin counts in mce alone,
    with accuracy 0 at its middle. calibrated: ece under 0.1. All null without rows that have both."""
    have = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    one = have.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(y).alias("__base"), F.count(F.lit(1)).alias("__n"))  # one row
    gap, share = F.col("confidence") - F.col("accuracy"), F.try_divide("n", "__n")
    a = reliability(rows, p, y, bins).crossJoin(F.broadcast(one)).groupBy("brier", "__base").agg(
        F.sum(share * F.abs(gap)).alias("ece"), F.max(F.when(F.col("__n") > 0, F.abs(gap))).alias("mce"), F.sum(share * gap * gap).alias("reliability"), F.sum(share * F.pow(F.col("accuracy") - F.col("__base"), 2)).alias("resolution"),
    )
    return a.select("ece", "mce", "brier", "reliability", "resolution", (F.col("__base") * (1 - F.col("__base"))).alias("uncertainty"), (F.col("ece") < 0.1).alias("calibrated"))


def score_test(contributions: DataFrame, value: str = "phi") -> DataFrame:
    """(policy, score_mean, score_se, score_z, score_p): whether a mean by policy is zero, with the population deviation and a two-sided
    normal p; z is 0 and p 1 where nothing varies."""
    a = contributions.groupBy("policy").agg(F.avg(value).alias("score_mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("score_se"))
    a = a.withColumn("score_z", F.when(F.col("score_se") > 0, F.col("score_mean") / F.col("score_se")).otherwise(0.0))

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:  # a row a policy
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))

    return a.withColumn("score_p", two_sided("score_z"))


def drawn_share(rows: DataFrame, fresh: DataFrame, least: float = 0.8) -> DataFrame:
    """(policy, coverage, coverage_ok): the share of rows whose prompt has a fresh draw of the policy; ok from least on."""
    hits = fresh.select("policy", "prompt_id").distinct().withColumn("__hit", F.lit(1.0))
    share = rows.select("policy", "prompt_id").join(hits, ["policy", "prompt_id"], "left").groupBy("policy").agg(F.avg(F.coalesce("__hit", F.lit(0.0))).alias("coverage"))
    return share.withColumn("coverage_ok", F.col("coverage") >= least)


def boundary_card(rows: DataFrame, labelled: DataFrame, gap: DataFrame, band: float = 0.05) -> DataFrame:
    """(policy, outside, saturated, gap, width, verdict) from rows (policy, judge_score, reward), labelled rows of the same columns
    and (policy, gap), how far two estimators are apart.

    outside: scores beyond those that have labels; saturated: rewards within a band of the ends of the labelled rows' rewards;
    width: what the scores outside leave open under monotone rewards, null where there are none.
    """
    span = labelled.agg(F.min("judge_score").alias("lo"), F.max("judge_score").alias("hi"), F.min("reward").alias("r_lo"), F.max("reward").alias("r_hi"))
    share, margin = lambda c: F.avg(c.cast("double")), band * (F.col("r_hi") - F.col("r_lo"))
    a = rows.crossJoin(F.broadcast(span)).groupBy("policy").agg(  # one row
        share(F.col("judge_score") < F.col("lo")).alias("below"), share(F.col("judge_score") > F.col("hi")).alias("above"),
        share((F.col("reward") <= F.col("r_lo") + margin) | (F.col("reward") >= F.col("r_hi") - margin)).alias("saturated"), F.first("r_lo").alias("r_lo"), F.first("r_hi").alias("r_hi"),
    ).join(gap, "policy", "left").withColumn("outside", F.col("below") + F.col("above"))
    verdict = F.when(F.col("outside") >= 0.05, "REFUSE-LEVEL").when((F.col("saturated") >= 0.2) | (F.col("gap") >= 0.1), "CAUTION").otherwise("OK")
    return a.select("policy", "outside", "saturated", "gap", F.when(F.col("outside") > 0, F.col("below") * F.col("r_lo") + F.col("above") * (1 - F.col("r_hi"))).alias("width"), verdict.alias("verdict"))


def _concordance(pairs: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Of each key: n, s (concordant less discordant pairs of rows) and the sums over ties of x and y that tau and its variance take.

    Ranks of x are halved again and again: two rows of different x part in one bit, where they share a node (the bits above it). In a
    node the rows of the lower half with less, or more, y are a running sum along y, so n cells cost n log n rows and no pairs.
    """
    own = pairs.where(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = written(own.groupBy(key, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("c")), "cells")
    ties = lambda v: cells.groupBy(key, v).agg(F.sum("c").alias("c")).groupBy(key).agg(F.sum("c").alias("n"), *[F.sum(f).alias(f"{v}{i}") for i, f in enumerate((F.col("c") * F.col("c"), F.expr("c * (c - 1) * (c - 2)"), F.expr("c * (c - 1) * (2 * c + 5)")))])
    ranks = written(running(cells.select(key, "x").distinct().withColumn("one", F.lit(1)), [key], "x", {"rank": "one"}).select(key, "x", F.col("rank").cast("long").alias("rank")), "ranks")
    bits = int(ranks.agg(F.max("rank")).first()[0] or 1).bit_length()
    node = cells.join(ranks, [key, "x"]).withColumn("bit", F.explode(F.array(*map(F.lit, range(bits)))))
    lower = F.expr("shiftright(rank, bit) & 1") == 0
    half = lambda side: F.sum(F.when(side, F.col("c")).otherwise(0.0))
    at = node.groupBy(key, "bit", F.expr("shiftright(rank, bit + 1)").alias("node"), "y").agg(half(lower).alias("l"), half(~lower).alias("r"))
    at = running(at, [key, "bit", "node"], "y", {"upto": "l"})
    # a node's pairs: r (upto - l) rise together, r (all - upto) do not; all comes once a node
    part = at.groupBy(key, "bit", "node").agg(F.sum(F.expr("r * (2 * upto - l)")).alias("s"), F.sum("l").alias("all"), F.sum("r").alias("right"))
    s = part.groupBy(key).agg(F.sum(F.expr("s - all * right")).alias("s"))
    return ties("x").join(ties("y").drop("n"), key).join(s, key)


def kendall(pairs: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, tau): tau-b of x and y in each key, null where a side is constant. Rows without key, x or y don't count."""
    apart = lambda v: F.col("n") * F.col("n") - F.col(f"{v}0")
    return _concordance(pairs, key, x, y).select(key, F.col("n").cast("long").alias("n"), F.when((apart("x") > 0) & (apart("y") > 0), 2 * F.col("s") / F.sqrt(apart("x") * apart("y"))).alias("tau"))


def kendall_drift(pairs: DataFrame, key: str, x: str, y: str, counted: bool = False) -> DataFrame:
    """kendall() with p_value, drift (p under 0.05 and tau under 0.8) and level.

    p_value is two-sided, of the normal approximation with its terms for ties; null where tau is. counted: where nothing is tied and there are
    few rows it is counted out over all orders (stats.kendall_exact)."""
    c = _concordance(pairs, key, x, y).withColumn("m", F.expr("n * (n - 1)"))
    ties = F.expr("(x0 - n) * (y0 - n) / (2 * m)") + F.when(F.col("n") > 2, F.expr("x1 * y1 / (9 * m * (n - 2))")).otherwise(0.0)
    variance = F.expr("(m * (2 * n + 5) - x2 - y2) / 18") + ties
    found = F.expr("n * n > x0 and n * n > y0")

    @F.pandas_udf("double")
    def two_sided(z: pd.Series, n: pd.Series, untied: pd.Series, s: pd.Series) -> pd.Series:  # a row a key
        def p(z: float, n: float, untied: bool, s: float) -> float | None:
            exact = kendall_exact(int(n), round((n * (n - 1) / 2 - s) / 2)) if counted and untied else None
            return exact if exact is not None else math.erfc(abs(z) / math.sqrt(2))

        return pd.Series([None if pd.isna(v[0]) else p(*v) for v in zip(z, n, untied, s, strict=True)], dtype="Float64")

    untied = F.expr("x0 = n and y0 = n")
    c = c.withColumns({"tau": F.when(found, F.expr("2 * s / sqrt((n * n - x0) * (n * n - y0))")), "p_value": two_sided(F.when(found, F.col("s") / F.sqrt(variance)), F.col("n"), untied, F.col("s"))})
    level = F.when(F.col("tau").isNull(), "unknown")
    for least, name in TAU_LEVELS:
        level = level.when(F.col("tau") > least, name)
    drift = F.coalesce((F.col("p_value") < 0.05) & (F.col("tau") < 0.8), F.lit(False))
    return c.select(key, F.col("n").cast("long").alias("n"), "tau", "p_value", drift.alias("drift"), level.otherwise(TAU_LOWEST).alias("level"))


def label_drift(rows: DataFrame, batch: str, score: str, label: str, least: float = 0.1, high: float = 0.2) -> DataFrame:
    """(batch, tau, tau_next, tau_change, drift, severity) of each batch and the next: how far the rank correlation of scores and labels
    moves. Over least it is a drift, moderate or (over high) high; null where a batch has none."""
    own = kendall(rows, batch, score, label).select(F.col(batch).alias("batch"), "tau")
    both = own.join(own.select((F.col("batch") - 1).alias("batch"), F.col("tau").alias("tau_next")), "batch").withColumn("tau_change", F.col("tau_next") - F.col("tau"))
    moved = F.abs("tau_change")
    return both.withColumn("drift", moved > least).withColumn("severity", F.when(moved > high, "high").when(moved > least, "moderate"))


def draw_statistics(fresh: DataFrame) -> DataFrame:
    """(policy, prompt_id, n, mean, var): sample variance, 0 for a single draw."""
    return fresh.groupBy("policy", "prompt_id").agg(F.count(F.lit(1)).alias("n"), F.avg("judge_score").alias("mean"), F.coalesce(F.var_samp("judge_score"), F.lit(0.0)).alias("var"))


def uncovered_prompts(logged: DataFrame, fresh: DataFrame, policies: list[str]) -> DataFrame:
    """(prompt_id, policy): logged prompts that have no fresh draw of a policy."""
    want = logged.select("prompt_id").distinct().withColumn("policy", F.explode(F.array(*map(F.lit, policies))))
    return want.join(fresh.select("policy", "prompt_id").distinct(), ["policy", "prompt_id"], "left_anti")


def draw_coverage(logged: DataFrame, fresh: DataFrame, policies: list[str]) -> DataFrame:
    """(policy, n_prompts, n_uncovered, least, mean, most): logged prompts, those without a draw, and the draws of the others."""
    want = logged.select("prompt_id").distinct().withColumn("policy", F.explode(F.array(*map(F.lit, policies))))
    drawn = want.join(fresh.groupBy("policy", "prompt_id").agg(F.count(F.lit(1)).alias("d")), ["policy", "prompt_id"], "left")
    return drawn.groupBy("policy").agg(F.count(F.lit(1)).alias("n_prompts"), F.count_if(F.col("d").isNull()).alias("n_uncovered"), F.min("d").alias("least"), F.avg("d").alias("mean"), F.max("d").alias("most"))


def extra_draws(logged: DataFrame, fresh: DataFrame) -> DataFrame:
    """(policy, n_prompts, n_draws): fresh draws of prompts that the log lacks; no row for a policy without any."""
    lone = fresh.join(logged.select("prompt_id").distinct(), "prompt_id", "left_anti").groupBy("policy", "prompt_id").agg(F.count(F.lit(1)).alias("d"))
    return lone.groupBy("policy").agg(F.count(F.lit(1)).alias("n_prompts"), F.sum("d").alias("n_draws"))


def policy_summary(logged: DataFrame, policies: list[str]) -> DataFrame:
    """(policy, n, n_valid, n_used, filter_rate): rows, those with the policy's and the base's log-probability, those with all policies', and the
    share that goes for want of one. One pass, a row a policy."""
    has = lambda p: F.col("base_lp").isNotNull() & F.col("target_lps")[p].isNotNull()
    whole = F.col("base_lp").isNotNull()
    for p in policies:
        whole &= F.col("target_lps")[p].isNotNull()
    one = logged.agg(F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("n_used"), F.array(*[F.struct(F.lit(p).alias("policy"), F.count_if(has(p)).alias("n_valid")) for p in policies]).alias("p"))
    return one.select("n", "n_used", F.inline("p")).select("policy", "n", "n_valid", "n_used", (1 - F.try_divide("n_used", "n")).alias("filter_rate"))


def orthogonality(rows: DataFrame) -> DataFrame:
    """Of (policy, w_cal, reward, g): the mean of w (reward - g), its error (population deviation), z and 95 % interval."""
    s, half = F.col("w_cal") * (F.col("reward") - F.col("g")), normal_ppf(0.975) * F.col("se")
    a = rows.groupBy("policy").agg(F.avg(s).alias("score"), (F.stddev_pop(s) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return a.withColumn("z", F.when(F.col("se") > 0, F.col("score") / F.col("se")).otherwise(0.0)).withColumn("lo", F.col("score") - half).withColumn("hi", F.col("score") + half)


def hill_stability(rows: DataFrame, fractions: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1)) -> DataFrame:
    """(policy, median, least, most, spread) of the tail index over fractions of the tail; infinite ones (no tail) are left out."""
    finite = _hill(_weights(rows), fractions).select("policy", "alpha")
    return finite.groupBy("policy").agg(F.percentile("alpha", 0.5).alias("median"), F.min("alpha").alias("least"), F.max("alpha").alias("most"), F.stddev_pop("alpha").alias("spread"))


def auto_threshold(n: Column, half_width: float, level: str = "critical") -> Column:
    """The least share of effective rows for an interval of that half width: 0.9604 / (n hw^2), half of it as a warning."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.001), 0.9604 / (n * half_width * half_width) * (1.0 if level == "critical" else 0.5)))


def refusal_gates(rows: DataFrame, w: str = "w_cal", raw: str = "w", ess_least: float = 0.3, zero_most: float = 0.85, top_most: float = 0.3, cv_most: float = 2.0) -> DataFrame:
    """(policy, ess_fraction, zero_share, top_share, cv, refused): too few effective rows, too many raw weights near zero (calibrated
    ones would hide them), or a heavy and scattered top."""
    a = rows.groupBy("policy").agg((ess(F.col(w)) / F.count(F.lit(1))).alias("ess_fraction"), F.avg((F.col(raw) < 1e-10).cast("double")).alias("zero_share"), F.try_divide(F.stddev_pop(w), F.avg(w)).alias("cv"))
    a = a.join(mass_concentration(rows, 0.05, w).withColumnRenamed("share", "top_share"), "policy")
    scattered = F.coalesce(F.col("cv"), F.lit(float("inf"))) > cv_most
    return a.withColumn("refused", (F.col("ess_fraction") < ess_least) | (F.col("zero_share") > zero_most) | ((F.col("top_share") > top_most) & scattered))


def decomposition(rows: DataFrame) -> DataFrame:
    """Of (policy, w_cal, reward, g, q): the means and errors of the model part q and the weighted part, and their correlation."""
    part, n = F.col("w_cal") * (F.col("reward") - F.col("g")), F.sqrt(F.count(F.lit(1)))
    return rows.groupBy("policy").agg(F.avg("q").alias("model"), F.avg(part).alias("weighted"), (F.stddev_pop("q") / n).alias("model_se"), (F.stddev_pop(part) / n).alias("weighted_se"), F.corr(F.col("q"), part).alias("correlation"))


def mass_points(rows: DataFrame, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(policy, share, rows): how many of the largest weights make each share of the sum. Running sums see levels, not rows."""
    levels = rows.groupBy("policy", (-F.col("w")).alias("down")).agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("s"))
    total = levels.groupBy("policy").agg(F.sum("s").alias("total"))
    run = running(levels, ["policy"], "down", {"upto": "c", "mass": "s"}).join(F.broadcast(total), "policy")
    asked = run.withColumn("share", F.explode(F.array(*[F.lit(x) for x in shares]))).where(F.col("mass") >= F.col("share") * F.col("total") - 1e-9)
    hit = asked.groupBy("policy", "share").agg(F.min_by(F.struct("upto", "mass", "s", "c", "total"), "upto").alias("h"))
    need = (F.col("share") * F.col("h.total") - (F.col("h.mass") - F.col("h.s"))) / (F.col("h.s") / F.col("h.c"))
    return hit.select("policy", "share", (F.col("h.upto") - F.col("h.c") + F.greatest(F.lit(1), F.ceil(need - 1e-9))).cast("long").alias("rows"))


def sequential_drift(rows: DataFrame, batch: str, place: str, value: str) -> DataFrame:
    """(batch, n, tau) of each batch with the next one, rows paired by place."""
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{batch}") + 1 == F.col(f"b.{batch}")) & (F.col(f"a.{place}") == F.col(f"b.{place}")))
    return kendall(pairs.select(F.col(f"a.{batch}").alias("batch"), F.col(f"a.{value}").alias("x0"), F.col(f"b.{value}").alias("y0")), "batch", "x0", "y0")


def dr_diagnostics(rows: DataFrame, w: str = "w_cal") -> DataFrame:
    """A row a policy: the model part and the weighted part, residuals of the outcome model, tails of the influence, and how the parts correlate."""
    part, res = F.col(w) * (F.col("reward") - F.col("g")), F.col("reward") - F.col("g")
    means = rows.groupBy("policy").agg(F.avg(F.col("q") + part).alias("__psi"))
    own = written(rows.select("policy", "reward", "g", "q", *{w} - {"reward", "g", "q"}).join(F.broadcast(means), "policy").withColumn("__phi", F.abs(F.col("q") + part - F.col("__psi"))), "influence")
    a = own.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), F.avg("q").alias("dm_mean"), F.avg(part).alias("ips_mean"), F.first("__psi").alias("estimate"), F.stddev_pop("q").alias("dm_std"), F.stddev_pop(part).alias("ips_std"),
        F.avg(res).alias("residual_mean"), F.stddev_pop(res).alias("residual_std"), F.sqrt(F.avg(res * res)).alias("residual_rmse"),
        (1 - F.sum(res * res) / F.greatest(F.var_pop("reward") * F.count(F.lit(1)), F.lit(1e-12))).alias("r2"), F.sqrt(F.avg(F.col("__phi") * F.col("__phi"))).alias("if_std"), F.corr(F.col("q"), part).alias("correlation"),
    )
    tails = own.select("policy", F.col("__phi").alias("w"))
    return a.join(_ratio(tails).withColumnRenamed("ratio", "if_tail"), "policy").join(_mass(tails).withColumnRenamed("share", "if_top"), "policy")


def influence_shape(contributions: DataFrame) -> DataFrame:
    """(policy, skewness, kurtosis, n_outliers, outlier_fraction): moments of the influence (of the population; kurtosis beyond the normal's 3) and rows beyond three deviations."""
    sd = contributions.groupBy("policy").agg(F.stddev_pop("phi").alias("__sd"), F.skewness("phi").alias("skewness"), F.kurtosis("phi").alias("kurtosis"), F.avg("phi").alias("__m"))
    own = contributions.join(F.broadcast(sd), "policy")
    out = F.abs(F.col("phi") - F.col("__m")) > 3 * F.col("__sd")
    return own.groupBy("policy").agg(F.first("skewness").alias("skewness"), F.first("kurtosis").alias("kurtosis"), F.count_if(out).alias("n_outliers"), F.avg(out.cast("double")).alias("outlier_fraction"))


def floor_mass(rows: DataFrame, fresh: DataFrame, everyone: DataFrame, reward: str = "reward") -> DataFrame:
    """(policy, logged, fresh): the share of rewards within 1e-6 of the least reward that calibration gives."""
    low = everyone.agg(F.min(reward).alias("__low"))
    share = lambda own, name: own.crossJoin(F.broadcast(low)).groupBy("policy").agg(F.avg((F.abs(F.col(reward) - F.col("__low")) <= 1e-6).cast("double")).alias(name))  # noqa: E731  one row
    return share(rows, "logged").join(share(fresh, "fresh"), "policy")


def ecdf(rows: DataFrame, x: str) -> DataFrame:
    """(policy, x, rank): (rows at or below x - 1/2) / n, by levels."""
    levels = rows.groupBy("policy", x).agg(F.count(F.lit(1)).alias("c"))
    n = levels.groupBy("policy").agg(F.sum("c").alias("n"))
    return running(levels, ["policy"], x, {"upto": "c"}).join(F.broadcast(n), "policy").select("policy", x, ((F.col("upto") - 0.5) / F.col("n")).alias("rank"))


def ccdf(rows: DataFrame, x: str) -> DataFrame:
    """(policy, x, share): the share of rows at or above x, by levels."""
    levels = rows.groupBy("policy", x).agg(F.count(F.lit(1)).alias("c"))
    n = levels.groupBy("policy").agg(F.sum("c").alias("n"))
    return running(levels, ["policy"], x, {"upto": "c"}).join(F.broadcast(n), "policy").select("policy", x, ((F.col("n") - F.col("upto") + F.col("c")) / F.col("n")).alias("share"))


def ips_summary(rows: DataFrame) -> DataFrame:
    """One row: the effective share of all rows, mean affinity, worst tail index, and a status (critical under 1.5, warning under 2)."""
    own = _weights(rows)
    a = _diagnostics(own).join(hellinger(own), "policy")
    one = a.agg((F.sum(F.col("n") * F.col("ess_fraction")) / F.sum("n")).alias("ess_fraction"), F.avg("affinity").alias("affinity"), F.min("alpha").alias("alpha"), F.sum("n").alias("n"))
    return one.withColumn("status", F.when(F.col("alpha") < 1.5, "critical").when(F.col("alpha") < 2, "warning").otherwise("good"))


def policy_risk(rows: DataFrame) -> DataFrame:
    """(policy, ess_fraction, alpha, variance_risk, tail_risk)."""
    a = weight_diagnostics(rows)
    variance = F.when(F.col("ess_fraction") < 0.1, "high").when(F.col("ess_fraction") < 0.3, "medium").otherwise("low")
    tail = F.when(F.col("alpha") < 2, "critical").when(F.col("alpha") < 2.5, "high").otherwise("low")
    return a.select("policy", "ess_fraction", "alpha", variance.alias("variance_risk"), tail.alias("tail_risk"))


def run_diagnostics(rows: DataFrame, w: str = "w") -> DataFrame:
    """(policy, n, ess_absolute, ess_relative, alpha, cv, max_share, near_zero, affinity, quality, recommendation) of one experiment:
    ess_relative in per cent; near_zero the share of rows with less than a tenth of an even share of the sum."""
    held = _weights(rows, w)
    total = held.groupBy("policy").agg(F.sum("w").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    own, x, part = held.join(F.broadcast(total), "policy"), F.col("w"), F.try_divide("w", "__sum")
    a = own.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), ess(x).alias("ess_absolute"), (100 * ess(x) / F.count(F.lit(1))).alias("ess_relative"), F.try_divide(F.stddev_pop("w"), F.avg("w")).alias("cv"),
        F.max(part).alias("max_share"), F.avg((part < 1 / (10 * F.col("__n"))).cast("double")).alias("near_zero"),
    )
    return a.join(_card(held).select("policy", "alpha", "affinity", "quality", "recommendation"), "policy")


def batches(rows: DataFrame, order: str, least: int, parts: int = 10) -> DataFrame:
    """Adds batch and place: runs of max(least, n // parts) rows in the order; the rows after the last whole run are left out."""
    n = rows.count()
    size = max(least, n // parts)
    at = running(rows.withColumn("__one", F.lit(1)), [], order, {"__at": "__one"}).withColumn("__at", F.col("__at") - 1)
    return at.where(F.col("__at") < n // size * size).withColumn("batch", F.floor(F.col("__at") / size)).withColumn("place", F.col("__at") % size).drop("__one", "__at")


def stability(rows: DataFrame, order: str = "row_id", x: str = "judge_score", y: str = "oracle_label") -> DataFrame:
    """(kind, batch, n, tau): how scores drift from each batch to the next (drift), how they rank with the labels in each batch of
    labelled rows (batch) and in all (overall), and the population deviation over batches (spread, in tau). Tau is null where a side
    is constant; rows without a score don't count."""
    own = rows.where(F.col(x).isNotNull())
    pairs = own.where(F.col(y).isNotNull())
    drift = sequential_drift(batches(own.select(order, x), order, 50), "batch", "place", x)
    each = kendall(batches(pairs.select(order, x, y), order, 10), "batch", x, y)
    every = kendall(pairs.withColumn("batch", F.lit(-1).cast("long")), "batch", x, y)
    spread = each.agg(F.lit(-1).cast("long").alias("batch"), F.count("tau").alias("n"), F.stddev_pop("tau").alias("tau"))
    kinds = [t.select(F.lit(k).alias("kind"), F.col("batch").cast("long").alias("batch"), F.col("n").cast("long").alias("n"), "tau") for k, t in (("drift", drift), ("batch", each), ("overall", every), ("spread", spread))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])


def records(card: DataFrame, estimates: DataFrame) -> DataFrame:
    """(policy, n, estimate, se, ess_fraction, alpha, issues, status) from weight_diagnostics() and (policy, estimate, se): issues lists
    values that contradict each other, and status is critical where there are any or weights are, else that of the weights."""
    own = card.select("policy", "n", "ess_fraction", "alpha", "status").join(estimates.select("policy", "estimate", "se"), "policy", "full_outer")
    rules = {
        "no weights": F.col("n").isNull(), "no estimate": F.col("estimate").isNull() | F.isnan("estimate"), "estimate outside [0, 1]": ~F.col("estimate").between(0, 1), "negative error": F.col("se") < 0,
        "effective share outside (0, 1]": (F.col("ess_fraction") <= 0) | (F.col("ess_fraction") > 1 + 1e-9), "no rows": F.col("n") == 0,
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return own.withColumn("issues", issues).withColumn("status", F.when(F.size("issues") > 0, "critical").otherwise(F.col("status"))).select("policy", "n", "estimate", "se", "ess_fraction", "alpha", "issues", "status")


def dr_summary(card: DataFrame) -> DataFrame:
    """One row of dr_diagnostics(): policies, range of estimates, worst residual fit and influence tail, mean correlation of the parts."""
    return card.agg(F.count(F.lit(1)).alias("policies"), F.min("estimate").alias("least"), F.max("estimate").alias("most"), F.min("r2").alias("worst_r2"), F.max("if_tail").alias("worst_tail"), F.max("if_top").alias("most_top"), F.avg("correlation").alias("correlation"))
