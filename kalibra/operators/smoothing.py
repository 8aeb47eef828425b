"""Weights along an ordering index: moving means over rows that lie side by side, and what calibration did to weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .diagnostics import ess
from .tables import running

#: rows of a block, which is what a task's window holds beside its neighbours' edges
BLOCK = 65_536


def moving_means(rows: DataFrame, key: str, index: str, tie: str, values: dict[str, str], half: int, block: int = BLOCK) -> DataFrame:
    """Adds for each (name, column) of values the column's mean over the row, the half rows before and the half rows after it, within
    key in the order of (index, tie), which has no ties; at the ends there are fewer. Means pass over nulls.

    Rows are numbered by ranges, then cut to blocks; rows within half of a block's end go to the next block too, so a window has a
    block and two edges, however many rows a key has. half may be as long as a block at most.
    """
    if not 0 <= half <= block:
        raise ValueError(f"half must be from 0 to {block}")
    at = running(rows.withColumn("__one", F.lit(1)).withColumn("__order", F.struct(index, tie)), [key], "__order", {"__nth": "__one"})
    place, inside = F.col("__nth") - 1, (F.col("__nth") - 1) % block
    own = at.withColumn("__own", F.floor(place / block)).drop("__one", "__order")
    beside = F.array_compact(F.array("__own", F.when((inside < half) & (F.col("__own") > 0), F.col("__own") - 1), F.when(inside >= block - half, F.col("__own") + 1)))
    shared = own.withColumn("__block", F.explode(beside))
    near = W.partitionBy(key, "__block").orderBy("__nth").rowsBetween(-half, half)
    return shared.select("*", *[F.avg(c).over(near).alias(n) for n, c in values.items()]).where(F.col("__block") == F.col("__own")).select(*rows.columns, *values)


def weights_along(rows: DataFrame, index: str = "judge_score", half: int = 50, raw: str = "w", cal: str = "w_cal", block: int = BLOCK) -> DataFrame:
    """(policy, row_id, index, raw, cal, raw_smooth, cal_smooth): weights and their moving means along the index. Rows without an index
    or with a weight that is not positive and finite are left out."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    own = rows.where(fine(index) & fine(raw) & fine(cal) & (F.col(raw) > 0) & (F.col(cal) > 0))
    own = own.select("policy", "row_id", F.col(index).alias("index"), F.col(raw).alias("raw"), F.col(cal).alias("cal"))
    return moving_means(own, "policy", "index", "row_id", {"raw_smooth": "raw", "cal_smooth": "cal"}, half, block)


def weight_summary(rows: DataFrame, raw: str = "w", cal: str = "w_cal") -> DataFrame:
    """(policy, n, ess_raw, ess_cal, uplift, var_ratio, max_raw, max_cal, over_10, over_100): effective rows before and after
    calibration and by what factor they grew, the ratio of variances (0 where raw weights are all the same), the largest weights, and how
    many raw weights are over 10 and over 100."""
    c = F.col(raw)
    a = rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("n"), ess(c).alias("ess_raw"), ess(F.col(cal)).alias("ess_cal"), F.var_pop(raw).alias("__v"), F.var_pop(cal).alias("__c"),
        F.max(raw).alias("max_raw"), F.max(cal).alias("max_cal"), F.count_if(c > 10).alias("over_10"), F.count_if(c > 100).alias("over_100"),
    )
    ratio = F.when(F.col("__v") > 0, F.col("__c") / F.col("__v")).otherwise(0.0)
    return a.select("policy", "n", "ess_raw", "ess_cal", F.try_divide("ess_cal", "ess_raw").alias("uplift"), ratio.alias("var_ratio"), "max_raw", "max_cal", "over_10", "over_100")
