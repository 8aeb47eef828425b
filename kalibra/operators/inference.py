"""Standard errors put together, intervals, comparisons and bootstraps of estimates.

Contributions are (policy, row_id, fold, c, phi), as estimators give them: the value is the mean of c, phi its influence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf, normal_ppf, t_ppf
from . import reporting
from .estimators import cluster_robust
from .tables import written


def compose(se: Column, oracle_var: Column | None = None, draw_var: Column | None = None) -> Column:
    """The root of independent variances: of the influence, of the labels and of the draws."""
    zero = F.lit(0.0)
    return F.sqrt(F.greatest(se * se + F.coalesce(oracle_var if oracle_var is not None else zero, zero) + F.coalesce(draw_var if draw_var is not None else zero, zero), zero))


def t_critical(df: Column, alpha: float = 0.05) -> Column:
    """Student's t quantile by degrees of freedom (1 at least), a batch of rows at a time; rows are estimates, a row a policy."""

    @F.pandas_udf("double")
    def at(v: pd.Series) -> pd.Series:
        known = {d: t_ppf(1 - alpha / 2, max(d, 1.0)) for d in v.dropna().unique()}
        return v.map(known)

    return at(df.cast("double"))


def two_sided(z: Column) -> Column:
    """The p-value of a normal deviate."""

    @F.pandas_udf("double")
    def at(v: pd.Series) -> pd.Series:
        return v.map(lambda x: 2 * (1 - normal_cdf(abs(x))), na_action="ignore")

    return at(z)


def with_intervals(contributions: DataFrame, oracle_var: DataFrame | None = None, draw_var: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """(policy, n, estimate, se_naive, se_cluster, groups, oracle_var, draw_var, se, lo, hi): errors by clusters, labels (policy,
    oracle_var) and draws (policy, mc_var) together, and t intervals of groups - 1 degrees of freedom."""
    out = cluster_robust(contributions)
    out = out.join(oracle_var, "policy", "left") if oracle_var is not None else out.withColumn("oracle_var", F.lit(0.0))
    out = out.join(draw_var.withColumnRenamed("mc_var", "draw_var"), "policy", "left") if draw_var is not None else out.withColumn("draw_var", F.lit(0.0))
    out = out.withColumn("se", compose(F.col("se_cluster"), F.col("oracle_var"), F.col("draw_var")))
    half = t_critical(F.col("groups") - 1, alpha) * F.col("se")
    return out.withColumn("lo", F.col("estimate") - half).withColumn("hi", F.col("estimate") + half)


def two_way(contributions: DataFrame, first: str, second: str) -> DataFrame:
    """(policy, se, df): clusters of two kinds; the variance of both less that of their crossing, degrees of freedom of the
    kind with more clusters."""
    parts = []
    for name, keys in (("a", [first]), ("b", [second]), ("ab", [first, second])):
        sums = contributions.groupBy("policy", *keys).agg(F.sum("phi").alias("t"), F.count(F.lit(1)).alias("m"))
        g = F.count(F.lit(1))
        v = F.try_divide(g, g - 1) * (F.sum(F.col("t") * F.col("t")) - g * F.pow(F.avg("t"), 2)) / F.pow(F.sum("m"), 2)
        parts.append(sums.groupBy("policy").agg(F.coalesce(v, F.lit(0.0)).alias(f"v_{name}"), g.alias(f"g_{name}")))
    out = parts[0].join(parts[1], "policy").join(parts[2], "policy")
    return out.select("policy", F.sqrt(F.greatest(F.col("v_a") + F.col("v_b") - F.col("v_ab"), F.lit(0.0))).alias("se"), (F.greatest("g_a", "g_b") - 1).alias("df"))


def compare(contributions: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(first, second, difference, se, z, p, significant) of every pair of policies, by their influence on the same rows."""
    a, b = contributions.alias("a"), contributions.alias("b")
    pair = a.join(b, "row_id").where(F.col("a.policy") < F.col("b.policy"))
    d = F.col("a.phi") - F.col("b.phi")
    errors = pair.groupBy(F.col("a.policy").alias("first"), F.col("b.policy").alias("second")).agg((F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    value = contributions.groupBy("policy").agg(F.avg("c").alias("v"))
    one, two = value.select(F.col("policy").alias("first"), F.col("v").alias("v1")), value.select(F.col("policy").alias("second"), F.col("v").alias("v2"))
    out = errors.join(one, "first").join(two, "second").withColumn("difference", F.col("v1") - F.col("v2"))
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("difference") / F.col("se")).otherwise(0.0)).withColumn("p", two_sided(F.col("z")))
    return out.select("first", "second", "difference", "se", "z", "p", (F.col("p") < alpha).alias("significant"))


def best_policy(estimates: DataFrame) -> DataFrame:
    """One row: the policy of the largest estimate, the first by name among equals."""
    return estimates.agg(F.min_by("policy", F.struct(-F.col("estimate"), F.col("policy"))).alias("policy"), F.max("estimate").alias("estimate"))


def simultaneous(estimates: DataFrame, alpha: float = 0.05, se: str = "se") -> DataFrame:
    """(policy, estimate, se, critical, lo, hi, significant): bands that hold for all policies at once, by Bonferroni."""
    k = estimates.agg(F.count(F.lit(1)).alias("k"))
    at = F.pandas_udf(lambda v: v.map(lambda n: normal_ppf(1 - alpha / n / 2)), "double")
    out = estimates.crossJoin(F.broadcast(k)).withColumn("critical", at("k"))  # one row
    lo, hi = F.col("estimate") - F.col("critical") * F.col(se), F.col("estimate") + F.col("critical") * F.col(se)
    return out.select("policy", "estimate", F.col(se).alias("se"), "critical", lo.alias("lo"), hi.alias("hi"), ((lo > 0) | (hi < 0)).alias("significant"))


#: places of a policy that one task sums up: 56 MB of rows
SLICE = 1 << 21


def _in_order(contributions: DataFrame, order: str) -> DataFrame:
    """(policy, place, v, next): rows of each policy by place in the order from 0, and the value at the place after (null at the end).

    Places come from counts by range: rows are sorted by ranges, a range's rows are numbered in it, and the counts before it are added."""
    ranged = written(contributions.select("policy", order, F.col("c").alias("v")).repartitionByRange("policy", order).withColumn("part", F.spark_partition_id()), "ranges")
    inside, between = W.partitionBy("policy", "part").orderBy(order), W.partitionBy("policy").orderBy("part")
    own = ranged.withColumn("own", F.row_number().over(inside) - 1).withColumn("next", F.lead("v").over(inside))
    parts = ranged.groupBy("policy", "part").agg(F.count(F.lit(1)).alias("size"), F.min_by("v", order).alias("first"))
    ahead = parts.select("policy", "part", "size", F.coalesce(F.sum("size").over(between.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.lead("first").over(between).alias("after"))
    placed = own.join(F.broadcast(ahead), ["policy", "part"])  # a row a policy and range
    return placed.select("policy", (F.col("own") + F.col("ahead")).alias("place"), "v", F.when(F.col("own") == F.col("size") - 1, F.col("after")).otherwise(F.col("next")).alias("next"))


def _blocks(rng: np.random.Generator, n: int, length: int, stationary: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of a replicate's blocks, n places in all."""
    if stationary:
        sizes = np.zeros(0, np.int64)
        while sizes.sum() < n:
            sizes = np.append(sizes, rng.geometric(1 / length, max(16, int(1.2 * n / length))))
        starts = rng.integers(0, n, len(sizes))
    else:
        sizes = np.full(-(-n // length), length, np.int64)
        starts = rng.integers(0, n - length + 1, len(sizes))
    total = np.cumsum(sizes)
    last = int(np.searchsorted(total, n))
    sizes[last] -= total[last] - n
    return starts[: last + 1], sizes[: last + 1]


def _sum_within(sums: np.ndarray, low: int, n: int, starts: np.ndarray, sizes: np.ndarray) -> float:
    """What blocks have at places from low on; sums: running sums there from 0. A block goes on from place 0 at the end, n."""
    high, end, total = low + len(sums) - 1, starts + sizes, 0.0
    if sizes.max() >= n:
        total, end = float((sizes // n).sum() * sums[-1]), starts + sizes % n
    met = (starts < high) & (end > low)
    total += (sums[np.minimum(end[met], high) - low] - sums[np.maximum(starts[met], low) - low]).sum()
    over = end[end > n] - n
    return total + sums[np.minimum(over[over > low], high) - low].sum()


def block_bootstrap(contributions: DataFrame, order: str = "row_id", replicates: int = 1000, block: int | None = None, stationary: bool = False, alpha: float = 0.05, seed: int = 17) -> DataFrame:
    """(policy, estimate, se, lo, hi, block) of the mean of c by blocks of neighbours in order, percentile intervals.

    Moving blocks have a fixed length (n to the power 1/3), stationary ones a geometric length with that mean, made longer by the
    correlation of neighbours, and run on at the end from the start. A replicate's mean needs sums of blocks only, differences of two
    running sums. A task holds the running sums of SLICE neighbours, draws all blocks anew (draws depend on seed, replicate and policy
    only) and adds up what of them lies in its slice: no draw is sent or joined, and a slice hands on a sum a replicate. Places
    are exact, whatever the number of partitions.
    """
    spark = contributions.sparkSession
    rows = written(_in_order(contributions, order), "places")
    # neighbours' correlation is for the mean length of stationary blocks
    stats = rows.groupBy("policy").agg(F.avg("v").alias("estimate"), F.count(F.lit(1)).alias("n"), F.coalesce(F.corr("v", "next"), F.lit(0.0)).alias("rho"))
    lengths, info = {}, {r["policy"]: r for r in stats.collect()}  # a row a policy
    for p, r in info.items():
        base = max(1, round(r["n"] ** (1 / 3))) if stationary else max(1, int(r["n"] ** (1 / 3)))
        c = min(0.99, abs(r["rho"] or 0.0))
        lengths[p] = block or (min(max(1, round(base * (c / (1 - c)) ** 0.67)) if stationary and c >= 0.1 else base, max(1, r["n"] // 4)) if stationary else base)
    asked, width = {p: (int(r["n"]), int(lengths[p])) for p, r in info.items()}, SLICE

    def summed(table: pa.Table) -> pa.Table:
        policy, low = table["policy"][0].as_py(), table["slice"][0].as_py() * width
        n, length = asked[policy]
        sums = np.zeros(len(table) + 1)
        sums[table["own"].to_numpy() + 1] = table["v"].to_numpy()
        np.cumsum(sums, out=sums)
        found = [_sum_within(sums, low, n, *_blocks(np.random.default_rng([seed, rep, *policy.encode()]), n, length, stationary)) / n for rep in range(replicates)]
        return pa.table({"policy": pa.array([policy] * replicates, pa.string()), "replicate": pa.array(range(replicates), pa.int32()), "m": pa.array(found, pa.float64())})

    place = F.col("place")
    sliced = rows.select("policy", F.floor(place / width).cast("int").alias("slice"), (place % width).cast("int").alias("own"), F.coalesce("v", F.lit(0.0)).alias("v"))
    parts = sliced.groupBy("policy", "slice").applyInArrow(summed, "policy string, replicate int, m double")
    means = parts.groupBy("policy", "replicate").agg(F.sum("m").alias("m"))
    ends = means.groupBy("policy").agg(F.stddev_samp("m").alias("se"), F.percentile("m", alpha / 2).alias("lo"), F.percentile("m", 1 - alpha / 2).alias("hi"))
    held = spark.createDataFrame([(p, float(r["estimate"]), int(lengths[p])) for p, r in info.items()], "policy string, estimate double, block long")
    return held.join(ends, "policy").select("policy", "estimate", "se", "lo", "hi", "block")


def robust_inference(contributions: DataFrame, method: str = "cluster", alpha: float = 0.05, **settings) -> DataFrame:
    """(policy, estimate, se, lo, hi, p, adjusted): errors by method (cluster, stationary, block or classical), p-values of a value
    of zero and their false-discovery adjustment."""
    if method in ("stationary", "block"):
        out = block_bootstrap(contributions, stationary=method == "stationary", alpha=alpha, **settings).drop("block")
    elif method == "cluster":
        out = with_intervals(contributions, alpha=alpha, **settings).select("policy", "estimate", "se", "lo", "hi")
    elif method == "classical":
        half = normal_ppf(1 - alpha / 2) * F.col("se_naive")
        out = cluster_robust(contributions).select("policy", "estimate", F.col("se_naive").alias("se"), (F.col("estimate") - half).alias("lo"), (F.col("estimate") + half).alias("hi"))
    else:
        raise ValueError(f"unknown method {method}")
    out = out.withColumn("p", two_sided(F.when(F.col("se") > 0, F.col("estimate") / F.col("se")).otherwise(0.0)))
    adjusted = reporting.benjamini_hochberg(out.select(F.col("policy").alias("label"), "p")).select(F.col("label").alias("policy"), "adjusted")
    return out.join(adjusted, "policy")
