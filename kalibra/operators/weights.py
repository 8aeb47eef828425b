"""Importance weights of logged rows, by policy. Sums by policy are joined back, so no policy is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the largest log ratio whose exponential is finite.
LOG_MAX = 709.782712893384


def valid_rows(logged: DataFrame, policies: list[str]) -> DataFrame:
    """Rows with a base log-probability and one of every policy."""
    keep = F.col("base_lp").isNotNull()
    for p in policies:
        keep &= F.col("target_lps")[p].isNotNull()
    return logged.where(keep)


def by_policy(logged: DataFrame) -> DataFrame:
    """A row for each policy of the map, with its log ratio."""
    return logged.select("*", F.explode("target_lps").alias("policy", "target_lp")).drop("target_lps").withColumn("log_ratio", F.col("target_lp") - F.col("base_lp"))


def missing_counts(logged: DataFrame) -> DataFrame:
    """(policy, n, n_missing): rows, and those without that policy's or the base's log-probability."""
    gone = F.col("target_lp").isNull() | F.col("base_lp").isNull()
    return by_policy(logged).groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("n_missing"))


def raw(log_ratio: Column) -> Column:
    return F.when(log_ratio.isNull(), 0.0).otherwise(F.exp(F.least(log_ratio, F.lit(LOG_MAX))))  # least() passes over nulls


def hajek(rows: DataFrame, keys: tuple[str, ...] = ("policy",), clip: float | None = None) -> DataFrame:
    """Adds w: self-normalised weights of mean 1 within keys; clip cuts them, then means are 1 again.

    One pass finds the means: exponentials are added up by the whole part of the log ratio, so none overflows, and a key's few
    sums are then put on the scale of its largest. A missing log ratio has weight zero and counts in the mean.
    """
    whole = F.floor(F.col("log_ratio"))
    sums = rows.groupBy(*keys, whole.alias("b")).agg(F.sum(F.exp(F.col("log_ratio") - whole)).alias("s"), F.count(F.lit(1)).alias("c"))
    parts = sums.groupBy(*keys).agg(F.max("b").alias("__top"), F.sum("c").alias("n"), F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "s"))).alias("p"))
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["s"] * F.exp((x["b"] - F.col("__top")).cast("double"))) / F.col("n")
    own = rows.join(F.broadcast(parts.select(*keys, "__top", mean.alias("__mean"))), [*keys])
    own = own.withColumn("w", F.when(F.col("__mean") > 0, F.coalesce(F.exp(F.col("log_ratio") - F.col("__top")), F.lit(0.0)) / F.col("__mean")).otherwise(0.0)).drop("__top", "__mean")
    return own if clip is None else mean_one(own.withColumn("w", F.least("w", F.lit(clip))), keys)


def mean_one(rows: DataFrame, keys: tuple[str, ...] = ("policy",), w: str = "w") -> DataFrame:
    """w over its mean within keys; zeros where all are. One small row a key comes back by broadcast."""
    means = rows.groupBy(*keys).agg(F.avg(w).alias("__mean"))
    return rows.join(F.broadcast(means), [*keys]).withColumn(w, F.when(F.col("__mean") > 0, F.col(w) / F.col("__mean")).otherwise(0.0)).drop("__mean")


def clipped(rows: DataFrame, most: float, keys: tuple[str, ...] = ("policy",)) -> DataFrame:
    """w cut to most, then of mean one again."""
    return mean_one(rows.withColumn("w", F.least("w", F.lit(most))), keys)
