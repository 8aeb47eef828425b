"""Isotonic regression of many groups at once.

Rows are first added up by (group, x). Pooling adjacent violators may start anywhere and gives the same
blocks, so each range of levels is pooled where it lies, and only the blocks left meet in the task of their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import written


def pool(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Starts of the blocks of the least-squares rising fit, in the order given."""
    starts, sums, weights = [], [], []
    for i, (v, w) in enumerate(zip(value, weight, strict=True)):
        starts.append(i)
        sums.append(v * w)
        weights.append(w)
        while len(starts) > 1 and sums[-2] * weights[-1] >= sums[-1] * weights[-2]:
            starts.pop()
            s, w2 = sums.pop(), weights.pop()
            sums[-1] += s
            weights[-1] += w2
    return np.array(starts, int)


def fit(rows: DataFrame, keys: list[str], x: str, y: str, w: Column | None = None, rising: bool = True) -> DataFrame:
    """(keys, x_lo, x_hi, y, weight): the blocks of each group's fit, x ascending. Rows without x or y don't count."""
    weight = F.lit(1.0) if w is None else w
    sign = 1.0 if rising else -1.0
    levels = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.sum(weight).alias("weight"), F.sum(weight * F.col(y)).alias("s"))
    levels = levels.where("weight > 0").select(*keys, F.col("x").alias("x_lo"), F.col("x").alias("x_hi"), (F.col("s") / F.col("weight")).alias("y"), "weight")
    schema = levels.schema

    def pooled(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("x_lo", kind="stable")
        starts = pool(sign * group["y"].to_numpy(), group["weight"].to_numpy())
        wy = np.add.reduceat((group["y"] * group["weight"]).to_numpy(), starts)
        weights = np.add.reduceat(group["weight"].to_numpy(), starts)
        out = group.iloc[starts].copy()
        out["x_hi"], out["weight"], out["y"] = group["x_hi"].to_numpy()[np.append(starts[1:], len(group)) - 1], weights, wy / weights
        return out

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, group in part.groupby(keys, sort=False, dropna=False):
                yield pooled(group)

    # ranges are contiguous in (keys, x); a batch of one is a run of neighbours, as order within a range is kept
    dealt = levels.repartitionByRange(*[F.col(k) for k in keys], F.col("x_lo")).sortWithinPartitions(*keys, "x_lo")
    return dealt.mapInPandas(local, schema).groupBy(*keys).applyInPandas(pooled, schema)


#: As many blocks the driver takes and broadcasts (24 bytes each).
MOST_BLOCKS = 2_000_000


def model(blocks: DataFrame, keys: list[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray]] | DataFrame:
    """What predict() takes: each group's breakpoints at the driver, or of more than MOST_BLOCKS blocks a written table of them.

    Of n levels about n to the power 1/3 are blocks where y scatters, but nearly all of them where it rises with x throughout.
    """
    seen = Observation()
    held = written(blocks.observe(seen, F.count(F.lit(1)).alias("n")), "blocks")
    return held if seen.get["n"] > MOST_BLOCKS else _at_driver(held, keys)


def knots(blocks: DataFrame, keys: list[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Each group's breakpoints, at the driver; more than MOST_BLOCKS are an error. For fits whose levels are few, as labels are; else see model()."""
    found = model(blocks, keys)
    if isinstance(found, DataFrame):
        raise ValueError(f"a fit has over {MOST_BLOCKS} blocks: round its scores")
    return found


def _at_driver(blocks: DataFrame, keys: list[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    out: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for key, group in blocks.toPandas().sort_values("x_lo", kind="stable").groupby(keys, sort=False, dropna=False):
        out[key if isinstance(key, tuple) else (key,)] = (group[["x_lo", "x_hi"]].to_numpy().ravel(), np.repeat(group["y"].to_numpy(), 2))
    return out


def predict(rows: DataFrame, models: dict[tuple, tuple[np.ndarray, np.ndarray]] | DataFrame, keys: list[str], x: str, name: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Adds name: linear between breakpoints, flat beyond them, cut to [low, high]; null where x is null or the group has no fit.
    models: of model() or knots(); a table's first columns are the keys, in their order."""
    if isinstance(models, DataFrame):
        return predict_levels(rows, models.toDF(*keys, *models.columns[len(keys) :]), keys, x, name, low, high)
    held = rows.sparkSession.sparkContext.broadcast(models)

    # not an iterator: predictions of one select share a Python worker's pass over the rows
    @F.pandas_udf("double")
    def at(*columns: pd.Series) -> pd.Series:
        *key, value = columns
        frame, x = pd.DataFrame(dict(enumerate(key))), value.to_numpy(float)
        out = np.full(len(x), np.nan)
        for k, places in frame.groupby(list(frame.columns), sort=False).indices.items():
            if (m := held.value.get(k if isinstance(k, tuple) else (k,))) is not None:
                out[places] = np.interp(x[places], *m)
        if low is not None or high is not None:
            out = np.clip(out, low, high)
        out[np.isnan(x)] = np.nan
        return pd.Series(pd.arrays.FloatingArray(out, np.isnan(out)))

    return rows.withColumn(name, at(*[F.col(k) for k in keys], F.col(x)))


def predict_levels(rows: DataFrame, blocks: DataFrame, keys: list[str], x: str, name: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """As predict(), from a table of blocks (keys, x_lo, x_hi, y) of any size: nothing of it comes to the driver.

    The levels of x in rows and the ends of blocks are dealt out by ranges; a level lies between the ends before and after it, of which
    those beyond its range are told by a row a range. Rows are then joined to their levels.
    """
    own = [F.col(k) for k in keys]
    ends = blocks.select(*own, F.explode(F.array(F.col("x_lo"), F.col("x_hi"))).alias("__x"), F.col("y").alias("__y")).distinct()
    levels = rows.where(F.col(x).isNotNull()).select(*own, F.col(x).cast("double").alias("__x")).distinct().withColumn("__y", F.lit(None).cast("double"))
    # an end and a level at one place lie in one range, as ranges are by place alone
    dealt = written(ends.unionByName(levels).repartitionByRange(*own, "__x").withColumn("__range", F.spark_partition_id()), "levels")
    end = F.when(F.col("__y").isNotNull(), F.struct("__x", "__y"))
    within = W.partitionBy("__range", *keys).orderBy("__x", F.col("__y").isNull())
    back, ahead = within.rowsBetween(W.unboundedPreceding, 0), within.rowsBetween(0, W.unboundedFollowing)
    spans = dealt.groupBy("__range", *keys).agg(F.min(end).alias("first"), F.max(end).alias("last"))
    order = W.partitionBy(*keys).orderBy("__range")
    spans = spans.select("__range", *own, F.last("last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("__before"), F.first("first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("__after"))
    placed = dealt.select("*", F.last(end, True).over(back).alias("__l"), F.first(end, True).over(ahead).alias("__h")).where("__y is null")
    same = placed["__range"] == spans["__range"]
    for k in keys:
        same = same & placed[k].eqNullSafe(spans[k])
    placed = placed.join(F.broadcast(spans), same).select(*[placed[k].alias(f"__k_{i}") for i, k in enumerate(keys)], placed["__x"].alias("__level"), F.coalesce("__l", "__before").alias("l"), F.coalesce("__h", "__after").alias("h"))
    gap = F.col("h.__x") - F.col("l.__x")
    value = F.when(F.col("l").isNull(), F.col("h.__y")).when(F.col("h").isNull() | (gap == 0), F.col("l.__y")).otherwise(F.col("l.__y") + (F.col("h.__y") - F.col("l.__y")) * (F.col("__level") - F.col("l.__x")) / gap)
    if low is not None:
        value = F.greatest(value, F.lit(low))
    if high is not None:
        value = F.least(value, F.lit(high))
    values = placed.where("l is not null or h is not null").select(*[f"__k_{i}" for i in range(len(keys))], "__level", value.alias(name))
    on = F.col(x).cast("double") == F.col("__level")
    for i, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(F.col(f"__k_{i}"))
    return rows.drop(name).join(values, on, "left").drop("__level", *[f"__k_{i}" for i in range(len(keys))])
