"""Policy values from logged rows, weights and fresh draws.

Rows here are (policy, row_id, prompt_id, fold, judge_score, reward, reward_oof, w); every estimator returns
contributions (policy, row_id, fold, c, phi): the value is the mean of c, phi its influence, centred.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import simplex_weights, t_ppf
from . import bootstrap, isotonic
from .tables import small, written
from .weights import mean_one

FOLDS = 5


def fold_of(prompt_id: Column, folds: int = FOLDS, seed: int = 42) -> Column:
    """Rows of one prompt share a fold, in any table: md5 of prompt, seed and number of folds."""
    return (F.conv(F.substring(F.md5(F.concat_ws("-", prompt_id, F.lit(str(seed)), F.lit(str(folds)))), 1, 8), 16, 10).cast("long") % folds).cast("int")


def calibrate(rows: DataFrame, folds: int = FOLDS) -> tuple[dict, dict]:
    """(model, models by fold): isotonic fits of oracle_label on judge_score; a fold's model has not seen the fold.

    Labels are added up by (fold, score) in one pass; all fits start from these sums.
    """
    labelled = rows.where(F.col("oracle_label").isNotNull()).groupBy("fold", "judge_score").agg(F.avg("oracle_label").alias("y"), F.count(F.lit(1)).cast("double").alias("c"))
    # the model of all labels is fitted beside those of the folds, as fold -1
    left_out = F.array_append(F.array_remove(F.sequence(F.lit(0), F.lit(folds - 1)), F.col("fold")), F.lit(-1))
    fitted = isotonic.model(isotonic.fit(labelled.select(F.explode(left_out).alias("fold"), "judge_score", "y", "c"), ["fold"], "judge_score", "y", F.col("c")), ["fold"])
    if isinstance(fitted, DataFrame):
        return fitted.where("fold = -1").withColumn("fold", F.lit(0)), fitted.where("fold <> -1")
    return {(0,): m for k, m in fitted.items() if k == (-1,)}, {k: m for k, m in fitted.items() if k != (-1,)}


def with_rewards(rows: DataFrame, models: tuple[dict, dict]) -> DataFrame:
    """Adds reward and reward_oof, both in [0, 1]."""
    out = isotonic.predict(rows.withColumn("g", F.lit(0)), models[0], ["g"], "judge_score", "reward", 0.0, 1.0).drop("g")
    return isotonic.predict(out, models[1], ["fold"], "judge_score", "reward_oof", 0.0, 1.0)


def fold_reward(rows: DataFrame, models, fold: str, name: str, score: str = "judge_score") -> DataFrame:
    """Adds name: the reward by the model of the fold in the column fold, in [0, 1]. models: of calibrate(), or a calibration.Calibration."""
    return isotonic.predict(rows, models[1], [fold], score, name, 0.0, 1.0) if isinstance(models, tuple) else models.at(rows, fold, name, score)


def _centred(rows: DataFrame, c: Column) -> DataFrame:
    own = rows.withColumn("c", c)
    means = own.groupBy("policy").agg(F.avg("c").alias("__psi"))
    return own.join(F.broadcast(means), "policy").select("policy", "row_id", "fold", "c", (F.col("c") - F.col("__psi")).alias("phi"))


def raw_ips(rows: DataFrame) -> DataFrame:
    """Self-normalised: mean of w * reward; phi = w (R - psi) - psi (w - mean w), w of mean 1."""
    psi = rows.groupBy("policy").agg((F.sum(F.col("w") * F.col("reward")) / F.sum("w")).alias("__psi"))
    own = rows.join(F.broadcast(psi), "policy").withColumn("__phi", F.col("w") * (F.col("reward_oof") - F.col("__psi")) - F.col("__psi") * (F.col("w") - 1))
    mean = own.groupBy("policy").agg(F.avg("__phi").alias("__m"))
    return own.join(F.broadcast(mean), "policy").select("policy", "row_id", "fold", (F.col("w") * F.col("reward")).alias("c"), (F.col("__phi") - F.col("__m")).alias("phi"))


def stabilised(rows: DataFrame, index: str = "reward_oof", folds: int = FOLDS, outer_seed: int = 1042, ess_floor: float = 0.2, var_cap: float = 1.0, floor: float = 1e-9, ridge: float = 1e-8) -> DataFrame:
    """Adds w_cal (calibrated weights), outer (their fold), psi_train and w_train (of the other outer folds, on raw weights).

    For each outer fold, the rows of the others give a rising and a falling fit of w on the index (to nine decimals, so what
    differs by rounding is a tie); both, of mean 1, are mixed for the least variance of their influence, each inner fold's with
    the means of the others, and pulled toward 1 as far as the floor of the effective sample or the cap on variance asks. The
    held-out rows take these fits, mean 1 within the fold, and in the end all weights of a policy have mean 1. A fold with
    fewer than 10 rows to learn from, fewer than 2 of its own, or a weight of zero among the former keeps its raw weights.
    All sums are by level of the index, so only levels are copied for the folds; means of held-out fits are sums over levels too, and the rows
    themselves are only mapped.
    """
    own = rows.withColumn("outer", fold_of(F.col("prompt_id"), folds, outer_seed)).withColumn("__x", F.round(index, 9))
    levels = written(own.groupBy("policy", "outer", "fold", F.col("__x").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("w").alias("sw"), F.min("w").alias("least"), F.sum(F.col("w") * F.col(index)).alias("swr")), "levels")
    train = levels.select("policy", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(folds - 1)), F.col("outer"))).alias("k"), "fold", "x", "n", "sw", "swr", "least", (F.col("sw") / F.col("n")).alias("y"))
    # a falling fit is a rising one along -x, so both are one job
    both = train.select("policy", "k", F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"), "x", "y", "n").withColumn("x", F.col("x") * F.col("way"))
    model = isotonic.model(isotonic.fit(both, ["policy", "k", "way"], "x", "y", F.col("n")), ["policy", "k", "way"])

    def fits(rows: DataFrame, k: str, x: str) -> DataFrame:
        for name, way in (("u", 1), ("d", -1)):
            rows = isotonic.predict(rows.withColumns({"__way": F.lit(way), "__at": F.col(x) * way}), model, ["policy", k, "__way"], "__at", name, floor)
        return rows.drop("__way", "__at")

    cand = fits(train.groupBy("policy", "k", "fold", "x").agg(F.sum("n").alias("n")), "k", "x")
    cand = written(cand, "candidates")
    mean = cand.groupBy("policy", "k").agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"m_{c}") for c in "ud"])
    cand = cand.join(F.broadcast(mean), ["policy", "k"]).select("policy", "k", "fold", "x", "n", *[(F.col(c) / F.col(f"m_{c}")).alias(c) for c in "ud"])
    by_fold = cand.groupBy("policy", "k", "fold").agg(F.sum("n").alias("n_f"), *[F.sum(F.col("n") * F.col(c)).alias(f"s_{c}") for c in "ud"], *[F.sum(F.col("n") * F.col(c) * F.col("x")).alias(f"sx_{c}") for c in "ud"])
    total = by_fold.groupBy("policy", "k").agg(F.sum("n_f").alias("n_t"), *[F.sum(f"{a}_{c}").alias(f"{a}t_{c}") for c in "ud" for a in ("s", "sx")])
    rest = by_fold.join(total, ["policy", "k"]).select("policy", "k", "fold", *[((F.col(f"st_{c}") - F.col(f"s_{c}")) / F.greatest(F.col("n_t") - F.col("n_f"), F.lit(1e-12))).alias(f"w_{c}") for c in "ud"], *[((F.col(f"sxt_{c}") - F.col(f"sx_{c}")) / F.greatest(F.col(f"st_{c}") - F.col(f"s_{c}"), F.lit(1e-12))).alias(f"psi_{c}") for c in "ud"])
    phi = {c: (F.col(c) * (F.col("x") - F.col(f"psi_{c}")) - F.col(f"psi_{c}") * (F.col(c) - F.col(f"w_{c}"))) / F.greatest(f"w_{c}", F.lit(1e-12)) for c in "ud"}
    w, sum_of = F.col("n"), lambda c: F.sum(F.col("n") * c)
    moments = cand.join(F.broadcast(rest), ["policy", "k", "fold"]).groupBy("policy", "k").agg(F.sum(w).alias("n"), *[sum_of(phi[c]).alias(f"f_{c}") for c in "ud"], *[sum_of(phi[a] * phi[b]).alias(f"f_{a}{b}") for a, b in ("uu", "ud", "dd")], *[sum_of((F.col(a) - 1) * (F.col(b) - 1)).alias(f"v_{a}{b}") for a, b in ("uu", "ud", "dd")])
    raw = train.groupBy("policy", "k").agg(F.sum("n").alias("n_train"), F.min("least").alias("least"), (F.sum("swr") / F.sum("sw")).alias("psi_train"), (F.sum("sw") / F.sum("n")).alias("w_train"))
    served = written(fits(levels.groupBy("policy", "outer", "x").agg(F.sum("n").alias("n"), F.sum("sw").alias("sw")), "outer", "x"), "served")
    tests = served.groupBy("policy", F.col("outer").alias("k")).agg(F.sum("n").alias("n_test"), *[(F.sum(F.col("n") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))).alias(f"mean_{c}") for c in "ud"])
    plan = []
    for r in raw.join(tests, ["policy", "k"]).join(moments, ["policy", "k"]).collect():  # a row a policy and fold
        cov = np.array([[(r[f"f_{a}{b}"] - r[f"f_{a}"] * r[f"f_{b}"] / r["n"]) / max(r["n"] - 1, 1) for a, b in pair] for pair in (("uu", "ud"), ("ud", "dd"))])
        a, b = simplex_weights(cov + ridge * np.trace(cov) / 2 * np.eye(2))
        var = (a * a * r["v_uu"] + 2 * a * b * r["v_ud"] + b * b * r["v_dd"]) / r["n"]
        keep = min(1.0, (min(1 / ess_floor - 1, var_cap) / var) ** 0.5) if var > 0 else 1.0
        enough = r["n_train"] >= 10 and r["n_test"] >= 2 and r["least"] > 0
        # a mean of zero or none leaves zeros
        a, b = (float(v) / r[f"mean_{c}"] if (r[f"mean_{c}"] or 0) > 0 else 0.0 for v, c in ((a, "u"), (b, "d")))
        plan.append((r["policy"], r["k"], a, b, float(keep), bool(enough), r["psi_train"], r["w_train"]))
    mix = small(rows.sparkSession, plan, "policy string, outer int, a double, b double, keep double, enough boolean, psi_train double, w_train double")
    blend = F.col("a") * F.col("u") + F.col("b") * F.col("d")
    mixed = F.when(F.col("keep") < 1, F.greatest(1 + F.col("keep") * (blend - 1), F.lit(floor))).otherwise(blend)
    # sums of the mixed weights by outer fold, for their means of 1 in it and in the policy
    of_fold = served.join(F.broadcast(mix), ["policy", "outer"]).withColumn("m", mixed).groupBy("policy", "outer").agg(F.first("enough").alias("enough"), F.sum("n").alias("n"), F.sum("sw").alias("sw"), F.sum(F.when(F.col("m").isNotNull(), F.col("n"))).alias("nm"), F.sum(F.col("n") * F.col("m")).alias("sm")).collect()  # a row a policy and fold
    scale, sums = {}, {}
    for r in of_fold:
        one = r["nm"] / r["sm"] if (r["sm"] or 0) > 0 else 0.0
        s, n = (one * (r["sm"] or 0.0), r["nm"] or 0.0) if r["enough"] else (r["sw"], r["n"])
        scale[r["policy"], r["outer"]] = one if r["enough"] else 1.0
        sums.setdefault(r["policy"], []).append((s, n))
    last = {p: sum(n for _, n in v) / s if (s := sum(s for s, _ in v)) > 0 else 0.0 for p, v in sums.items()}
    scales = small(rows.sparkSession, [(p, k, v * last[p]) for (p, k), v in scale.items()], "policy string, outer int, scale double")
    own = fits(own, "outer", "__x").join(F.broadcast(mix), ["policy", "outer"]).join(F.broadcast(scales), ["policy", "outer"])
    own = own.withColumn("w_cal", F.when(F.col("enough"), mixed).otherwise(F.col("w")) * F.col("scale"))
    return own.drop("__x", "u", "d", "a", "b", "keep", "enough", "scale")


def calibrated_ips(rows: DataFrame, explained: Column | None = None) -> DataFrame:
    """Mean of w_cal * reward; the influence of a row takes the value and mean weight of the other outer folds, and outer folds are its
    clusters. explained: what is taken off the influence."""
    psi, w_train = F.col("psi_train"), F.when(F.col("w_train") > 0, F.col("w_train")).otherwise(1.0)
    phi = (F.col("w_cal") * (F.col("reward_oof") - psi) - psi * (F.col("w_cal") - F.col("w_train"))) / w_train
    phi = phi if explained is None else phi - explained
    own = rows.select("policy", "row_id", F.col("outer").alias("fold"), (F.col("w_cal") * F.col("reward")).alias("c"), phi.alias("phi"))
    mean = own.groupBy("policy").agg(F.avg("phi").alias("__m"))
    return own.join(F.broadcast(mean), "policy").withColumn("phi", F.col("phi") - F.col("__m")).drop("__m")


def honest_ips(rows: DataFrame, least_r2: float = 0.02, folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """calibrated_ips() less what the score explains of a row's influence, by a rising fit on the rows of the other outer folds; and
    (policy, outer, r2, applied) of these fits.

    A fold's fit is applied where it explains least_r2 of its rows' influence, has 30 rows and 8 scores to learn from and 5 rows to serve.
    Fits are on sums by score: the influence of training rows is linear in w R, w and one, its square in their products.
    """
    w, wr = F.col("w_cal"), F.col("w_cal") * F.col("reward_oof")
    levels = written(rows.where(F.col("judge_score").isNotNull()).groupBy("policy", "outer", "judge_score").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(wr).alias("a"), F.sum(w).alias("b"), F.sum(wr * wr).alias("aa"), F.sum(wr * w).alias("ab"), F.sum(w * w).alias("bb")), "influence")
    known = rows.groupBy("policy", F.col("outer").alias("k")).agg(F.first("psi_train").alias("psi"), F.first("w_train").alias("mw"), F.count(F.lit(1)).alias("served"))
    train = levels.select("policy", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(folds - 1)), F.col("outer"))).alias("k"), "judge_score", "n", "a", "b", "aa", "ab", "bb").groupBy("policy", "k", "judge_score").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "ab", "bb")])
    psi, mw, d = F.col("psi"), F.col("mw"), F.when(F.col("mw") > 0, F.col("mw")).otherwise(1.0)
    total = (F.col("a") - 2 * psi * F.col("b") + psi * mw * F.col("n")) / d
    square = (F.col("aa") + 4 * psi * psi * F.col("bb") + psi * psi * mw * mw * F.col("n") - 4 * psi * F.col("ab") + 2 * psi * mw * F.col("a") - 4 * psi * psi * mw * F.col("b")) / (d * d)
    train = train.join(F.broadcast(known), ["policy", "k"]).select("policy", "k", "served", "judge_score", "n", total.alias("t"), square.alias("tt"), (total / F.col("n")).alias("y"))
    fitted = isotonic.model(isotonic.fit(train, ["policy", "k"], "judge_score", "y", F.col("n")), ["policy", "k"])
    held = isotonic.predict(train, fitted, ["policy", "k"], "judge_score", "h")
    n, left, left2 = F.sum("n"), F.sum(F.col("t") - F.col("n") * F.col("h")), F.sum(F.col("tt") - 2 * F.col("h") * F.col("t") + F.col("n") * F.col("h") * F.col("h"))
    all_, rest = F.sum("tt") - F.sum("t") * F.sum("t") / n, left2 - left * left / n
    r2 = F.when(all_ > 0, F.greatest(F.lit(0.0), 1 - rest / all_)).otherwise(0.0)
    fits = held.groupBy("policy", F.col("k").alias("outer")).agg(r2.alias("r2"), n.alias("n"), F.count(F.lit(1)).alias("scores"), F.first("served").alias("served"))
    fits = fits.select("policy", "outer", "r2", ((F.col("r2") >= least_r2) & (F.col("n") >= 30) & (F.col("scores") >= 8) & (F.col("served") >= 5)).alias("applied"))
    plan = fits.collect()  # a row a policy and fold
    good = {(r["policy"], r["outer"]) for r in plan if r["applied"]}
    if isinstance(fitted, DataFrame):
        fitted = fitted.join(F.broadcast(small(rows.sparkSession, sorted(good), "policy string, k int")), ["policy", "k"])
    else:
        fitted = {k: m for k, m in fitted.items() if k in good}
    own = isotonic.predict(rows, fitted, ["policy", "outer"], "judge_score", "__h")
    return calibrated_ips(own, F.coalesce("__h", F.lit(0.0))), rows.sparkSession.createDataFrame(plan, fits.schema)


def with_outcomes(rows: DataFrame, fresh: DataFrame, models: tuple[dict, dict]) -> DataFrame:
    """Adds g (the fold model at the logged score), q (its mean over the row's fresh draws), draws and draw_var (of a sample; 0 for one draw).

    Rows whose prompt has no draw of the policy go. A prompt's draws are added up before the join.
    """
    drawn = fold_reward(fresh.withColumn("fold", fold_of(F.col("prompt_id"))), models, "fold", "g")
    stats = drawn.groupBy("policy", "prompt_id").agg(F.avg("g").alias("q"), F.count(F.lit(1)).alias("draws"), F.coalesce(F.var_samp("g"), F.lit(0.0)).alias("draw_var"))
    return rows.join(stats, ["policy", "prompt_id"]).withColumn("g", F.col("reward_oof"))


def dr_cpo(rows: DataFrame, w: str = "w_cal") -> DataFrame:
    """q + w (R - g), on calibrated weights unless told otherwise."""
    return _centred(rows, F.col("q") + F.col(w) * (F.col("reward") - F.col("g")))


def weighted_outcome(rows: DataFrame, omega: str = "w", w: str = "w_cal") -> DataFrame:
    """g refitted by policy and fold, rows weighted by w, w squared or (w - 1) squared, at least 1e-8."""
    weight = F.greatest({"w": F.abs(w), "w2": F.col(w) * F.col(w), "snips": F.pow(F.col(w) - 1, 2)}[omega], F.lit(1e-8))
    train = rows.select("policy", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(FOLDS - 1)), F.col("fold"))).alias("fold"), "judge_score", "reward", weight.alias("omega"))
    return isotonic.predict(rows.drop("g"), isotonic.model(isotonic.fit(train, ["policy", "fold"], "judge_score", "reward", F.col("omega")), ["policy", "fold"]), ["policy", "fold"], "judge_score", "g", 0.0, 1.0)


def tmle(rows: DataFrame, steps: int = 50, tol: float = 1e-8, w: str = "w_cal") -> DataFrame:
    """q + w (R - g*), g* the logistic fluctuation of g along w. A Newton step is one sum for all policies at once, over rows
    that are best written before (see tables.written)."""
    guard = 1e-7
    z = F.least(F.greatest("g", F.lit(guard)), F.lit(1 - guard))
    own = rows.withColumn("__z", F.ln(z / (1 - z)))
    eps = {r["policy"]: 0.0 for r in rows.select("policy").distinct().collect()}
    at = lambda: F.create_map(*[F.lit(x) for p, e in eps.items() for x in (p, e)])[F.col("policy")]
    mu = lambda: 1 / (1 + F.exp(-(F.col("__z") + at() * F.col(w))))
    for _ in range(steps):
        m = mu()
        moved = False
        for r in own.groupBy("policy").agg(F.sum(F.col(w) * (F.col("reward") - m)).alias("score"), F.sum(F.col(w) * F.col(w) * m * (1 - m)).alias("info")).collect():
            if r["info"] > 0 and abs(r["score"]) / r["info"] ** 0.5 > tol:
                eps[r["policy"]] += max(-5.0, min(5.0, r["score"] / r["info"]))
                moved = True
        if not moved:
            break
    return _centred(own, F.col("q") + F.col(w) * (F.col("reward") - mu()))


def cross_fitted(rows: DataFrame, y: Column, name: str, low: float, high: float | None = None, least_rows: int = 100, least_scores: int = 8) -> DataFrame:
    """Adds name: the isotonic mean of y given the score, by policy, from the other folds, cut to [low, high].

    A fold with fewer than least_rows rows or least_scores scores to learn from gets their plain mean, a row without a score the mean of all that
    have one. Rows are added up by (policy, fold, score) once; only these levels are copied for the folds.
    """
    own = rows.where(F.col("judge_score").isNotNull()).groupBy("policy", "fold", "judge_score").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"))
    own = written(own, "levels")
    others = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(FOLDS - 1)), F.col("fold"))).alias("fold")
    train = own.select("policy", others, "judge_score", "n", "s").groupBy("policy", "fold", "judge_score").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("y", F.col("s") / F.col("n"))
    models = isotonic.model(isotonic.fit(train, ["policy", "fold"], "judge_score", "y", F.col("n")), ["policy", "fold"])
    few = train.groupBy("policy", "fold").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("scores"), F.sum("s").alias("s")).where((F.col("n") < least_rows) | (F.col("scores") < least_scores))
    flat = [(r["policy"], r["fold"], 0.0, 0.0, r["s"] / r["n"], r["n"]) for r in few.collect()]  # a row a policy and fold
    if isinstance(models, DataFrame):
        flat = small(rows.sparkSession, flat, "policy string, fold int, x_lo double, x_hi double, y double, weight double")
        models = models.join(F.broadcast(flat), ["policy", "fold"], "left_anti").unionByName(flat)
    else:
        models |= {(p, f): (np.zeros(1), np.full(1, y)) for p, f, _, _, y, _ in flat}
    means = own.groupBy("policy").agg((F.sum("s") / F.sum("n")).alias("__mean"))
    out = isotonic.predict(rows, models, ["policy", "fold"], "judge_score", name, low, high).join(F.broadcast(means), "policy", "left")  # a row a policy
    return out.withColumn(name, F.coalesce(name, "__mean")).drop("__mean")


def mean_weight(rows: DataFrame) -> DataFrame:
    """Adds m: the isotonic mean of w given the score, from the other folds, of mean 1. See cross_fitted() for folds with little to learn from."""
    return mean_one(cross_fitted(rows, F.col("w"), "m", 0.0), w="m")


def label_chance(rows: DataFrame) -> DataFrame:
    """Adds pi: the isotonic chance of a label given the score, from the other folds, in [0.001, 0.999]; it takes six scores to learn it."""
    return cross_fitted(rows, F.col("oracle_label").isNotNull().cast("double"), "pi", 1e-3, 1 - 1e-3, least_scores=6)


def orthogonalised_ips(rows: DataFrame) -> DataFrame:
    """w~ R + (w - m)(R - R_oof) + R_oof (w - w~); rows have w (raw) and w_cal."""
    r = F.col("reward")
    return _centred(mean_weight(rows), F.col("w_cal") * r + (F.col("w") - F.col("m")) * (r - F.col("reward_oof")) + F.col("reward_oof") * (F.col("w") - F.col("w_cal")))


def orthogonalised_dr(rows: DataFrame) -> DataFrame:
    """q + w~ (R_oof - g) + (w - w~)(R_oof - g) + (w - m)(R - R_oof); rows have w (raw) and w_cal (w~)."""
    left = F.col("reward_oof") - F.col("g")
    return _centred(mean_weight(rows), F.col("q") + F.col("w_cal") * left + (F.col("w") - F.col("w_cal")) * left + (F.col("w") - F.col("m")) * (F.col("reward") - F.col("reward_oof")))


def tr_cpo(rows: DataFrame, efficient: bool = True, anchored: bool = False, orthogonalised: bool = False) -> DataFrame:
    """q + w (R - g) + L / pi * omega (Y - R): pi the isotonic chance of a label given the score, omega = m (efficient) or w.

    anchored: the part with w is split into one with calibrated weights and the rest, given as columns anchor and retarget, which
    sum to it. orthogonalised: (w - m)(R - R_oof) is added, of mean near zero, which takes the two fits' errors apart.
    """
    own = label_chance(mean_weight(rows))
    label = F.when(F.col("oracle_label").isNotNull(), (F.col("m") if efficient else F.col("w")) * (F.col("oracle_label") - F.col("reward")) / F.col("pi")).otherwise(0.0)
    left = F.col("reward") - F.col("g")
    value = F.col("q") + F.col("w") * left + label
    if orthogonalised:
        value = value + (F.col("w") - F.col("m")) * (F.col("reward") - F.col("reward_oof"))
    out = _centred(own, value)
    if not anchored:
        return out
    parts = rows.select("policy", "row_id", (F.col("w_cal") * left).alias("anchor"), ((F.col("w") - F.col("w_cal")) * left).alias("retarget"))
    return out.join(parts, ["policy", "row_id"])


def cluster_robust(contributions: DataFrame, cluster: str = "fold") -> DataFrame:
    """(policy, n, estimate, se_naive, se_cluster, groups): CRV1, G / (G - 1) times the spread of group sums over n squared."""
    sums = contributions.groupBy("policy", cluster).agg(F.sum("phi").alias("t"))
    spread = sums.groupBy("policy").agg((F.count(F.lit(1)) / (F.count(F.lit(1)) - 1) * (F.sum(F.col("t") * F.col("t")) - F.count(F.lit(1)) * F.pow(F.avg("t"), 2))).alias("v"), F.count(F.lit(1)).alias("groups"))
    a = contributions.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("estimate"), (F.stddev_samp("phi") / F.sqrt(F.count(F.lit(1)))).alias("se_naive"))
    return a.join(spread, "policy").select("policy", "n", "estimate", "se_naive", (F.sqrt(F.greatest("v", F.lit(0.0))) / F.col("n")).alias("se_cluster"), "groups")


def draw_variance(rows: DataFrame) -> DataFrame:
    """(policy, mc_var): what drawing adds to the variance of the value; a bound stands in for single draws."""
    many, n = F.col("draws") > 1, F.count(F.lit(1))
    bound = F.least(F.coalesce(F.var_samp("q"), F.lit(0.25)), F.lit(0.25))
    exact = F.coalesce(F.sum(F.when(many, F.col("draw_var") / F.col("draws"))), F.lit(0.0)) / (n * n)
    return rows.groupBy("policy").agg((exact + bound * F.count_if(~many) / (n * n)).alias("mc_var"))


def intervals(estimates: DataFrame, alpha: float = 0.05, se: str = "se") -> DataFrame:
    """Adds lo and hi from Student's t with groups - 1 degrees of freedom."""
    q = {r["groups"]: t_ppf(1 - alpha / 2, r["groups"] - 1) for r in estimates.select("groups").distinct().collect() if r["groups"] > 1}
    at = F.create_map(*[F.lit(x) for k, v in q.items() for x in (k, v)])[F.col("groups")] if q else F.lit(None).cast("double")
    return estimates.withColumn("lo", F.col("estimate") - at * F.col(se)).withColumn("hi", F.col("estimate") + at * F.col(se))


def stacking(parts: dict[str, DataFrame], ridge: float = 1e-4, draw_var: DataFrame | None = None, draw_share: float = 1.0) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """One estimator from several, on the rows that all have, and its weights by policy and part: by the covariance of their influence, not
    negative, of sum 1; equal where it is near singular.

    draw_var (policy, mc_var): what drawing adds to the variance of each part. The parts share their draws, so it counts as wholly
    correlated: n times draw_share times the product of its roots is added to each cell.
    """
    names = sorted(parts)
    joint = None
    for n in names:
        own = parts[n].select("policy", "row_id", "fold", F.col("c").alias(f"c_{n}"), F.col("phi").alias(f"phi_{n}"))
        joint = own if joint is None else joint.join(own.drop("fold"), ["policy", "row_id"])
    cov = joint.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(f"phi_{a}", f"phi_{b}").alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]).collect()
    drawn = {r["policy"]: max(r["mc_var"] or 0.0, 0.0) for r in draw_var.collect()} if draw_var is not None else {}  # a row a policy
    alpha = {}
    for r in cov:
        s = np.array([[r[f"{i}_{j}"] for j in range(len(names))] for i in range(len(names))]) + draw_share * r["n"] * drawn.get(r["policy"], 0.0) + ridge * np.eye(len(names))
        alpha[r["policy"]] = simplex_weights(s) if np.linalg.cond(s) < 1e8 else np.full(len(names), 1 / len(names))
    mix = lambda kind: sum(F.create_map(*[F.lit(x) for p, a in alpha.items() for x in (p, float(a[i]))])[F.col("policy")] * F.col(f"{kind}_{n}") for i, n in enumerate(names))
    return joint.select("policy", "row_id", "fold", mix("c").alias("c"), mix("phi").alias("phi")), {p: dict(zip(names, map(float, a), strict=True)) for p, a in alpha.items()}


def stacked(parts: dict[str, DataFrame], ridge: float = 1e-4, draw_var: DataFrame | None = None) -> DataFrame:
    """The contributions of stacking()."""
    return stacking(parts, ridge, draw_var)[0]


def jackknife(rows: DataFrame, models: tuple[dict, dict], value: Column, folds: int = FOLDS) -> DataFrame:
    """(policy, oracle_var): (K - 1) / K times the spread of the value re-estimated with each fold model in turn.

    value: the mean of it is the estimate, an expression over r (the reward of the model in turn) and the rows' columns.
    """
    every = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("__k"))
    own = isotonic.predict(every, models[1], ["__k"], "judge_score", "r", 0.0, 1.0)
    by_fold = own.groupBy("policy", "__k").agg(F.avg(value).alias("psi"))
    return by_fold.groupBy("policy").agg(((F.count(F.lit(1)) - 1) / F.count(F.lit(1)) * (F.sum(F.col("psi") * F.col("psi")) - F.count(F.lit(1)) * F.pow(F.avg("psi"), 2))).alias("oracle_var"))


def tmle_identity(rows: DataFrame, w: str = "w_cal") -> DataFrame:
    """q + w (R - g - eps w), eps = sum w (R - g) / sum w^2: the fluctuation without a link."""
    eps = rows.groupBy("policy").agg((F.sum(F.col(w) * (F.col("reward") - F.col("g"))) / F.sum(F.col(w) * F.col(w))).alias("__eps"))
    return _centred(rows.join(F.broadcast(eps), "policy"), F.col("q") + F.col(w) * (F.col("reward") - F.col("g") - F.col("__eps") * F.col(w)))


def oracle_slice(rows: DataFrame) -> DataFrame:
    """(policy, augmentation, p): the mean of L / p * m (Y - R), m the mean weight given the score, p the share of labels."""
    own = mean_weight(rows)
    p = own.groupBy("policy").agg(F.avg(F.col("oracle_label").isNotNull().cast("double")).alias("p"))
    term = F.when(F.col("oracle_label").isNotNull(), F.col("m") * (F.col("oracle_label") - F.col("reward")) / F.col("p")).otherwise(0.0)
    return own.join(F.broadcast(p), "policy").groupBy("policy", "p").agg(F.avg(term).alias("augmentation"))


def bootstrap_means(contributions: DataFrame, replicates: int = 1000, seed: int = 11) -> DataFrame:
    """(policy, se, lo, hi) of the mean by bootstrap.bootstrap(): rows are added up in cells once, and replicates draw cells."""
    return bootstrap.bootstrap(contributions, bootstrap.mean("c"), replicates=replicates, seed=seed).select("policy", "se", "lo", "hi")


def balanced_folds(rows: DataFrame, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """Adds fold: labelled rows take turns in the order of a hash, so folds' label counts differ by one at most; others as fold_of().

    Turns come from counts by slices of the hash, so no task holds all labels.
    """
    h = F.md5(F.concat_ws("-", "prompt_id", F.lit(str(seed))))
    own = rows.withColumn("__h", h).withColumn("__s", F.substring("__h", 1, 2))
    labelled = own.where(F.col("oracle_label").isNotNull())
    counts = labelled.groupBy("__s").count()
    ahead = counts.select("__s", F.coalesce(F.sum("count").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__a"))  # 256 slices
    turn = F.row_number().over(W.partitionBy("__s").orderBy("__h", "row_id")) - 1
    even = labelled.withColumn("__t", turn).join(F.broadcast(ahead), "__s").withColumn("fold", ((F.col("__t") + F.col("__a")) % folds).cast("int")).drop("__t", "__a")
    return even.unionByName(own.where(F.col("oracle_label").isNull()).withColumn("fold", fold_of(F.col("prompt_id"), folds, seed))).drop("__h", "__s")


def synthetic_draws(logged: DataFrame, draws: int = 5, correlation: float = 0.8) -> DataFrame:
    """(prompt_id, draw_idx, judge_score): the score, 0.5 where it is missing, and normal noise of deviation 0.1 (1 - correlation), made from hashes."""
    own = logged.select("prompt_id", F.coalesce("judge_score", F.lit(0.5)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw_idx"))
    u = lambda tag: (F.conv(F.substring(F.md5(F.concat_ws("-", "prompt_id", F.col("draw_idx").cast("string"), F.lit(tag))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    noise = 0.1 * (1 - correlation) * F.sqrt(-2 * F.ln(u("a"))) * F.cos(2 * F.pi() * u("b"))
    return own.select("prompt_id", "draw_idx", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s") + noise)).alias("judge_score"))


def safe_blend(rows: DataFrame, share: float = 1.0, raw: str = "w", cal: str = "w_cal") -> DataFrame:
    """(policy, alpha, variance, feasible): the largest alpha in [0, 1] for which (1 - alpha) raw + alpha cal has at most share of
    the variance of raw (a thousandth more is let pass); where none has, the alpha of least variance; 0 where the two are one."""
    m = rows.groupBy("policy").agg(F.var_pop(raw).alias("vr"), F.var_pop(cal).alias("vc"), F.covar_pop(raw, cal).alias("c"))
    m = m.withColumn("cap", share * F.col("vr")).withColumn("vd", F.col("vr") + F.col("vc") - 2 * F.col("c")).withColumn("b", F.col("c") - F.col("vr"))
    at = lambda a: F.col("vr") + 2 * a * F.col("b") + a * a * F.col("vd")
    unit = lambda a: F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    m = m.withColumn("low", F.coalesce(unit(F.try_divide(-F.col("b"), F.col("vd"))), F.lit(0.0)))
    root = F.sqrt(F.greatest(F.col("b") * F.col("b") - F.col("vd") * (F.col("vr") - F.col("cap")), F.lit(0.0)))
    largest = F.when(at(F.col("low")) > F.col("cap") * 1.001, F.col("low")).otherwise(unit((root - F.col("b")) / (F.col("vd") + 1e-12)))
    m = m.withColumn("alpha", F.when(F.col("vc") <= F.col("cap") * 1.001, 1.0).when(F.col("vd") <= 1e-12, 0.0).otherwise(largest))
    m = m.withColumn("variance", at(F.col("alpha")))
    return m.select("policy", "alpha", "variance", (F.col("variance") <= F.col("cap") * 1.001).alias("feasible"))


def to_mean(rows: DataFrame, index: str, target: float = 1.0, share: float | None = 1.0) -> tuple[DataFrame, DataFrame]:
    """Rows with w_to (weights that rise with the index, nearest to w in squares, of mean target) and (policy, alpha, variance, feasible).

    Negative weights count as zero, rows of an equal index are one level. Of weights of mean one the nearest rising ones have mean
    one too, so the projection is the rising fit itself. share: at most this share of the variance of w, by safe_blend(); None asks
    for no bound. A policy whose weights are all zero or all equal gets the target for each; so does a row without an index.
    """
    own = mean_one(rows.withColumn("__raw", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0))), w="__raw")
    flat = own.groupBy("policy").agg(((F.max("__raw") - F.min("__raw") < 1e-8) | (F.var_pop("__raw") < 1e-12)).alias("__flat"))
    fitted = isotonic.knots(isotonic.fit(own, ["policy"], index, "__raw"), ["policy"])
    own = mean_one(isotonic.predict(own, fitted, ["policy"], index, "__cal", 0.0).withColumn("__cal", F.coalesce("__cal", F.lit(1.0))), w="__cal")
    own = written(own, "projected")
    blend = safe_blend(own, share, "__raw", "__cal") if share is not None else own.groupBy("policy").agg(F.lit(1.0).alias("alpha"), F.var_pop("__cal").alias("variance"), F.lit(None).cast("boolean").alias("feasible"))
    own = own.join(F.broadcast(blend.select("policy", F.col("alpha").alias("__a"))), "policy").join(F.broadcast(flat), "policy")
    value = F.when(F.col("__flat"), 1.0).otherwise((1 - F.col("__a")) * F.col("__raw") + F.col("__a") * F.col("__cal"))
    own = mean_one(own.withColumn("w_to", value), w="w_to").withColumn("w_to", target * F.col("w_to"))
    return own.drop("__raw", "__cal", "__a", "__flat"), blend
