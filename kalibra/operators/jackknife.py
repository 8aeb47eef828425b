"""What the labels' sampling adds to an estimator's variance: the value anew under each fold's calibration model, weights as they are.

Every estimator is linear in the rewards of the model in turn: a fixed part, a coefficient a logged row, and for the robust ones
a mean over draws. So coefficients are added up by score once, for all estimators together, and the models are asked at the scores only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import estimators
from .tables import written

#: Estimators whose formula has the mean weight given the score, and those with the chance of a label.
WITH_MEAN_WEIGHT, WITH_LABEL_CHANCE = ("orthogonalized-ips", "oc-dr-cpo", "tr-cpo-e"), ("tr-cpo", "tr-cpo-e")


def _terms(name: str) -> tuple[Column, Column, str | None]:
    """(fixed part, coefficient of the reward in turn, how draws are averaged: over prompts, over rows, or not at all)."""
    w, cal, r = F.col("w"), F.col("w_cal"), F.col("reward")
    if name in ("raw-ips", "calibrated-ips"):
        return F.lit(0.0), w if name == "raw-ips" else cal, None
    m, g = F.col("m"), F.col("g")
    if name == "orthogonalized-ips":  # the calibrated part keeps the rewards; the two corrections take those in turn
        return cal * r + (w - m) * r, m - cal, None
    if name in ("dr-cpo", "mrdr", "tmle"):
        return -cal * g, cal, "prompts"
    if name == "oc-dr-cpo":
        return -w * g + (w - m) * r, m, "prompts"
    if name in WITH_LABEL_CHANCE:
        share = F.when(F.col("oracle_label").isNotNull(), (m if name == "tr-cpo-e" else w) / F.col("pi")).otherwise(0.0)
        return -w * g + share * F.coalesce("oracle_label", F.lit(0.0)), w - share, "rows"
    raise ValueError(f"no jackknife for {name}")


def paths(rows: DataFrame, fresh: DataFrame | None, models, names: list[str], folds: int = estimators.FOLDS) -> DataFrame:
    """(policy, estimator, k, psi): each estimator's value under the k-th fold's model.

    rows: as estimators take them (for robust ones with outcomes, and draws: how many a prompt has). Outcome predictions, weights, the
    chance of a label and the mean weight stay as they are.
    """
    if set(names) & set(WITH_MEAN_WEIGHT):
        rows = estimators.mean_weight(rows)
    if set(names) & set(WITH_LABEL_CHANCE):
        rows = estimators.label_chance(rows)
    terms = {n: _terms(n) for n in names}
    sums = [F.sum(t[0]).alias(f"fixed_{i}") for i, t in enumerate(terms.values())] + [F.sum(t[1]).alias(f"own_{i}") for i, t in enumerate(terms.values())]
    levels = written(rows.groupBy("policy", "judge_score").agg(F.count(F.lit(1)).alias("n"), *sums), "coefficients")
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("__k")
    scored = estimators.fold_reward(levels.select("*", every), models, "__k", "r")
    n = F.sum("n")
    values = scored.groupBy("policy", "__k").agg(*[((F.sum(f"fixed_{i}") + F.sum(F.col(f"own_{i}") * F.col("r"))) / n).alias(f"v_{i}") for i in range(len(terms))])
    if any(t[2] for t in terms.values()):
        prompts = rows.groupBy("policy", "prompt_id").agg(F.count(F.lit(1)).alias("held"), F.max("draws").alias("draws"))
        drawn = fresh.select("policy", "prompt_id", "judge_score").join(prompts, ["policy", "prompt_id"])
        drawn = written(drawn.groupBy("policy", "judge_score").agg(F.sum(1 / F.col("draws")).alias("prompts"), F.sum(F.col("held") / F.col("draws")).alias("rows")), "draws")
        by = estimators.fold_reward(drawn.select("*", every), models, "__k", "r").groupBy("policy", "__k")
        values = values.join(by.agg(*[(F.sum(F.col(c) * F.col("r")) / F.sum(c)).alias(f"d_{c}") for c in ("prompts", "rows")]), ["policy", "__k"])
    psi = [F.struct(F.lit(name).alias("estimator"), (F.col(f"v_{i}") + (F.col(f"d_{t[2]}") if t[2] else 0.0)).alias("psi")) for i, (name, t) in enumerate(terms.items())]
    return values.select("policy", F.col("__k").alias("k"), F.explode(F.array(*psi)).alias("x")).select("policy", "x.estimator", "k", "x.psi")


def combined(found: DataFrame, alpha: dict[str, dict[str, float]], name: str = "stacked-dr") -> DataFrame:
    """The paths of a stacked estimator: those of its parts at fixed weights alpha, by policy and part."""
    rows = [(p, e, float(a)) for p, own in alpha.items() for e, a in own.items()]
    weights = found.sparkSession.createDataFrame(rows, "policy string, estimator string, alpha double")
    own = found.join(F.broadcast(weights), ["policy", "estimator"])  # a row a policy and part
    return own.groupBy("policy", "k").agg(F.sum(F.col("alpha") * F.col("psi")).alias("psi")).select("policy", F.lit(name).alias("estimator"), "k", "psi")


def variance(found: DataFrame) -> DataFrame:
    """(policy, estimator, oracle_var): (K - 1) / K times the spread of the values."""
    k = F.count(F.lit(1))
    return found.groupBy("policy", "estimator").agg(((k - 1) / k * F.greatest(F.sum(F.col("psi") * F.col("psi")) - k * F.pow(F.avg("psi"), 2), F.lit(0.0))).alias("oracle_var"))
