"""How near an influence is to a normal one: quantiles beside the normal's, and tests of normality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf, normal_ppf
from .tables import running, written

#: Up to so many rows a policy is tested by Shapiro and Wilk, beyond by Anderson and Darling, whose limit at one per cent is the other.
SHAPIRO_MOST, ANDERSON_LIMIT = 5000, 1.092
#: Fixed values of Royston's approximation (1995): corrections of the two outer coefficients, mean and deviation of the transformed statistic.
OUTER = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _polynomial(c: tuple[float, ...], x: float) -> float:
    return sum(v * x**i for i, v in enumerate(c))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """(W, p) by Royston's approximation, of 3 to 5000 values; (1, 1) where all are equal."""
    n = len(x)
    if not 3 <= n <= SHAPIRO_MOST:
        raise ValueError(f"3 to {SHAPIRO_MOST} values are needed")
    x = np.sort(np.asarray(x, float))
    spread = ((x - x.mean()) ** 2).sum()
    if x[-1] - x[0] < 1e-19 or spread <= 0:
        return 1.0, 1.0
    m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    squares, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(squares)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        outer = a[-1] + _polynomial(OUTER[0], u)
        if n > 5:
            second = a[-2] + _polynomial(OUTER[1], u)
            left = (squares - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * outer**2 - 2 * second**2)
            a = m / math.sqrt(left)
            a[[1, -2]] = -second, second
        else:
            a = m / math.sqrt((squares - 2 * m[-1] ** 2) / (1 - 2 * outer**2))
        a[[0, -1]] = -outer, outer
    w = min(float((a @ x) ** 2 / spread), 1.0)
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return 1.0, 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = _polynomial(SMALL[2], n)
        if y >= gamma:
            return w, 1e-99
        y, mean, deviation = -math.log(gamma - y), _polynomial(SMALL[0], n), math.exp(_polynomial(SMALL[1], n))
    else:
        mean, deviation = _polynomial(LARGE[0], math.log(n)), math.exp(_polynomial(LARGE[1], math.log(n)))
    return w, 0.5 * math.erfc((y - mean) / deviation / math.sqrt(2))


def _ranked(contributions: DataFrame) -> DataFrame:
    """(policy, z, c, upto, n): levels of the influence less its mean over its deviation (of a sample), and how many rows are at or below."""
    known = contributions.where(F.col("phi").isNotNull())
    m = known.groupBy("policy").agg(F.avg("phi").alias("mean"), F.stddev_samp("phi").alias("sd"), F.count(F.lit(1)).alias("n"))
    levels = known.groupBy("policy", "phi").agg(F.count(F.lit(1)).alias("c"))
    levels = running(levels, ["policy"], "phi", {"upto": "c"}).join(F.broadcast(m), "policy")  # a row a policy
    return levels.select("policy", F.try_divide(F.col("phi") - F.col("mean"), F.when(F.col("sd") > 0, F.col("sd"))).alias("z"), "c", "upto", "n", "mean", "sd")


def qq_points(contributions: DataFrame, points: int = 99) -> DataFrame:
    """(policy, p, normal, sample) at p = 1 / (points + 1), 2 / (points + 1)...: quantiles of the normal distribution, and of the influence less its
    mean over its deviation (of the population), linear between ranks. Ranks come from running sums; a policy is no task."""
    at = [(i / (points + 1), normal_ppf(i / (points + 1))) for i in range(1, points + 1)]
    asked = contributions.sparkSession.createDataFrame(at, "p double, normal double")
    levels = written(_ranked(contributions), "ranks")
    place = (F.col("n") - 1) * F.col("p")
    own = levels.crossJoin(F.broadcast(asked)).withColumn("low", F.floor(place)).withColumn("high", F.ceil(place))  # points rows
    holds = lambda rank: (F.col("upto") - F.col("c") <= F.col(rank)) & (F.col(rank) < F.col("upto"))
    found = own.where(holds("low") | holds("high")).groupBy("policy", "p", "normal").agg(
        F.max(F.when(holds("low"), F.col("z"))).alias("a"), F.max(F.when(holds("high"), F.col("z"))).alias("b"), F.first(place - F.col("low")).alias("t"), F.first("n").alias("n"))
    z = F.col("a") + (F.col("b") - F.col("a")) * F.col("t")
    return found.select("policy", "p", "normal", (z * F.sqrt(F.col("n") / (F.col("n") - 1))).alias("sample"))


def normality(contributions: DataFrame, most: int = SHAPIRO_MOST) -> DataFrame:
    """(policy, n, test, statistic, p_value, normal): Shapiro and Wilk's test up to most rows a policy, Anderson and Darling's beyond, whose p is
    0.01 over the limit and else 0.5. Policies of fewer than three rows or without spread have no test and no p.

    The statistic of Anderson and Darling is one sum over ranks, which levels of the influence make up: equal values share theirs.
    """
    if most > SHAPIRO_MOST:
        raise ValueError(f"Shapiro and Wilk's test takes {SHAPIRO_MOST} rows at most")
    levels = written(_ranked(contributions), "ranks")

    @F.pandas_udf("struct<low double, high double>")
    def tails(z: pd.Series) -> pd.DataFrame:
        floor = 5e-324
        return pd.DataFrame({"low": [math.log(max(normal_cdf(v), floor)) if v == v else None for v in z], "high": [math.log(max(normal_cdf(-v), floor)) if v == v else None for v in z]})

    # the ranks upto - c + 1 .. upto: twice a rank less one adds up to c (2 upto - c), and c of 2 (n - rank) + 1 to c (2 n - 2 upto + c)
    large = levels.where((F.col("n") > most) & F.col("z").isNotNull()).withColumn("t", tails("z"))
    a2 = large.groupBy("policy", "n").agg(F.sum(F.expr("c * (2 * upto - c) * t.low + c * (2 * n - 2 * upto + c) * t.high")).alias("s"))
    a2 = a2.select("policy", "n", F.lit("anderson-darling").alias("test"), (-F.col("n") - F.col("s") / F.col("n")).alias("statistic"))
    a2 = a2.withColumn("p_value", F.when(F.col("statistic") > F.round(F.expr(f"{ANDERSON_LIMIT}d / (1 + 4 / n - 25 / n / n)"), 3), 0.01).otherwise(0.5))

    def small_test(g: pd.DataFrame) -> pd.DataFrame:  # at most `most` rows
        w, p = shapiro_wilk(np.repeat(g["z"].to_numpy(float), g["c"].to_numpy(int)))
        return pd.DataFrame({"policy": g["policy"].iloc[:1], "n": g["n"].iloc[:1], "test": "shapiro-wilk", "statistic": w, "p_value": p})

    small = levels.where((F.col("n") <= most) & (F.col("n") >= 3) & F.col("z").isNotNull()).select("policy", "n", "z", "c")
    w = small.groupBy("policy").applyInPandas(small_test, "policy string, n long, test string, statistic double, p_value double")
    every = levels.groupBy("policy").agg(F.first("n").alias("n"))
    out = every.join(F.broadcast(a2.unionByName(w).drop("n")), "policy", "left")
    return out.select("policy", "n", "test", "statistic", "p_value", (F.col("p_value") > 0.05).alias("normal"))
