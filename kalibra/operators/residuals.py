"""Influence less what the judge score explains of it: values stay, errors shrink."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import isotonic, splines
from .estimators import FOLDS
from .tables import running, written

#: The least rows of a policy, and of a fold's training rows, for a fit; training rows a knot.
LEAST_ROWS, LEAST_TRAIN, ROWS_A_KNOT = 50, 10, 20


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, rho): the correlation of average ranks in each key; null where a side is constant. Rows with a null don't count.

    Ranks come from running sums over ranges of levels, so no key is one task.
    """
    own = written(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count(F.lit(1)).alias("__c")), "cells")
    ranked = own
    for v in ("__x", "__y"):
        levels = running(own.groupBy(*keys, v).agg(F.sum("__c").alias("__n")), keys, v, {"__upto": "__n"})
        ranked = ranked.join(levels.select(*keys, v, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(f"{v}_rank")), [*keys, v])
    n, total = F.col("__c"), lambda e: F.sum(F.col("__c") * e)
    a, b = F.col("__x_rank"), F.col("__y_rank")
    m = ranked.groupBy(*keys).agg(F.sum(n).alias("n"), total(a).alias("a"), total(b).alias("b"), total(a * a).alias("aa"), total(b * b).alias("bb"), total(a * b).alias("ab"))
    spread = lambda u: F.col(f"{u}{u}") - F.col(u) * F.col(u) / F.col("n")
    product = spread("a") * spread("b")
    return m.select(*keys, F.when((spread("a") > 1e-9) & (spread("b") > 1e-9), (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(product)).alias("rho"))


def residualised(contributions: DataFrame, rows: DataFrame, form: str = "spline", cross_fit: bool = True) -> tuple[DataFrame, DataFrame]:
    """(contributions, summary): phi less the centred mean of phi given the score, fitted on the other folds (or on all rows).

    form: spline (penalised, one knot for 20 rows, 4 to 8) or isotonic (rising or falling by the sign of the rank correlation in the policy).
    A fold with fewer than 10 rows to learn from takes their mean; a row without a score the mean of those that have one. A policy with
    fewer than 50 scored rows, or an influence that is not finite, stays as it is. Means of phi are the same before and after.

    summary: (policy, n, applied, r2, var_reduction, se_reduction, ess_gain) of each policy.
    """
    if form not in ("spline", "isotonic"):
        raise ValueError(f"unknown form {form}")
    own = written(contributions.join(rows.select("policy", "row_id", F.col("judge_score").cast("double").alias("__s")), ["policy", "row_id"]), "influence")
    finite = F.col("phi").isNotNull() & ~F.isnan("phi") & (F.abs("phi") < float("inf"))
    held = own.groupBy("policy").agg(F.count("__s").alias("scored"), F.count_if(~finite).alias("broken")).collect()  # a row a policy
    able = sorted(r["policy"] for r in held if r["scored"] >= LEAST_ROWS and not r["broken"])
    fit_on = own.where(F.col("policy").isin(able) & F.col("__s").isNotNull())
    levels = written(fit_on.groupBy("policy", "fold", F.col("__s").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("phi").alias("s"), F.sum(F.col("phi") * F.col("phi")).alias("ss")), "influence-levels")
    numbers = F.create_map(*[v for i, p in enumerate(able) for v in (F.lit(p), F.lit(i))])[F.col("policy")] if able else F.lit(-1)
    key = lambda fold: (numbers * (FOLDS + 1) + fold).cast("int")
    served = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(FOLDS - 1)), F.col("fold").cast("int"))) if cross_fit else F.lit(FOLDS)
    train = levels.select("policy", served.alias("k"), "x", "c", "s", "ss").withColumn("k", key(F.col("k"))).groupBy("k", "x").agg(*[F.sum(v).alias(v) for v in ("c", "s", "ss")])
    train = written(train, "influence-train")
    sizes = {r["k"]: (r["n"], r["s"]) for r in train.groupBy("k").agg(F.sum("c").alias("n"), F.sum("s").alias("s")).collect()}  # a row a policy and fold
    own = own.withColumn("__k", F.coalesce(key(F.col("fold") if cross_fit else F.lit(FOLDS)), F.lit(-1)))
    large = [k for k, (n, _) in sizes.items() if n >= LEAST_TRAIN]
    if form == "spline":
        smoothers = splines.fit_levels(train.where(F.col("k").isin(large)), rows_a_knot=ROWS_A_KNOT) if large else {}
        own = splines.predict_keyed(own, smoothers, "__k", "__s", "__h")
    else:
        signs = {r["policy"]: -1.0 if (r["rho"] or 0.0) < 0 else 1.0 for r in spearman(fit_on, ["policy"], "__s", "phi").collect()}
        sign = F.create_map(*[F.lit(v) for i, p in enumerate(able) for k in range(FOLDS + 1) for v in (i * (FOLDS + 1) + k, signs.get(p, 1.0))]) if able else F.create_map(F.lit(-1), F.lit(1.0))
        turned = train.where(F.col("k").isin(large)).withColumn("y", sign[F.col("k")] * F.col("s") / F.col("c"))
        fitted = isotonic.knots(isotonic.fit(turned, ["k"], "x", "y", F.col("c")), ["k"])
        own = isotonic.predict(own, fitted, ["__k"], "__s", "__h").withColumn("__h", F.col("__h") * F.coalesce(sign[F.col("__k")], F.lit(1.0)))
    small = {k: s / n for k, (n, s) in sizes.items() if n < LEAST_TRAIN}
    fallback = F.create_map(*[F.lit(v) for k, m in small.items() for v in (k, float(m))])[F.col("__k")] if small else F.lit(None).cast("double")
    means = own.groupBy("policy").agg(F.avg(F.when(F.col("__s").isNotNull(), F.col("phi"))).alias("__mean"))
    own = own.join(F.broadcast(means), "policy")  # a row a policy
    fit_value = F.when(F.col("__s").isNull(), F.col("__mean")).otherwise(F.coalesce("__h", fallback, F.lit(0.0)))
    own = written(own.withColumn("__h", F.when(F.col("policy").isin(able), fit_value).otherwise(0.0)), "fitted")
    centre = own.groupBy("policy").agg(F.avg("__h").alias("__centre"))
    own = own.join(F.broadcast(centre), "policy").withColumn("__left", F.col("phi") - (F.col("__h") - F.col("__centre")))
    v0, v1 = F.var_samp("phi"), F.var_samp("__left")
    unexplained = F.sum(F.pow(F.col("phi") - (F.col("__h") - F.col("__centre")), 2))
    part = lambda e: F.greatest(F.lit(0.0), F.when(v0 > 0, e).otherwise(0.0))
    summary = own.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col("policy").isin(able)).alias("applied"), part(1 - unexplained / (v0 * (F.count(F.lit(1)) - 1))).alias("r2"),
        part(1 - v1 / v0).alias("var_reduction"), part(1 - F.sqrt(v1 / v0)).alias("se_reduction"), F.when(v1 > 0, v0 / v1).otherwise(1.0).alias("ess_gain"),
    )
    return own.select("policy", "row_id", "fold", "c", F.col("__left").alias("phi")), summary
