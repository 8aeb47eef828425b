"""Bootstraps of any statistic that sums decide: rows are added up in cells once, and replicates draw cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import running

#: cells of a key at most, and what a replicate's draws then take; replicates are drawn a hundred at a time
CELLS, _AT_ONCE = 4096, 100


@dataclass(frozen=True)
class Statistic:
    """sums: what is added up over rows, by name; value: the statistic from sums (arrays, one place a replicate), not a number where
    it has none."""

    sums: dict[str, Column]
    value: Callable[[dict[str, np.ndarray]], np.ndarray]


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.shape(a), np.nan), where=b != 0)


def ratio(above: str, below: str) -> Statistic:
    """The sum of one column over that of another."""
    return Statistic({"above": F.col(above), "below": F.col(below)}, lambda s: _over(s["above"], s["below"]))


def mean(column: str) -> Statistic:
    return Statistic({"above": F.col(column), "below": F.col(column).isNotNull().cast("double")}, lambda s: _over(s["above"], s["below"]))


def correlation(x: str, y: str) -> Statistic:
    a, b = F.col(x), F.col(y)

    def value(s: dict[str, np.ndarray]) -> np.ndarray:
        mx, my = _over(s["x"], s["n"]), _over(s["y"], s["n"])
        spread = (_over(s["xx"], s["n"]) - mx * mx) * (_over(s["yy"], s["n"]) - my * my)
        return _over(_over(s["xy"], s["n"]) - mx * my, np.sqrt(np.maximum(spread, 0)))

    both = a.isNotNull() & b.isNotNull()
    return Statistic({k: F.when(both, c) for k, c in {"n": F.lit(1.0), "x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}.items()}, value)


def quantile(column: str, p: float, edges: Sequence[float]) -> Statistic:
    """A quantile from counts between rising edges, even within two neighbours; values beyond the ends count at the ends."""
    x, at = F.col(column), np.asarray(edges, float)

    def value(s: dict[str, np.ndarray]) -> np.ndarray:
        below = np.stack([s[f"to {i}"] for i in range(len(at))], axis=-1)
        want = p * s["n"]
        i = np.clip((below < want[..., None]).sum(-1), 1, len(at) - 1)
        low, high = (np.take_along_axis(below, j[..., None], -1)[..., 0] for j in (i - 1, i))
        part = np.clip(_over(want - low, high - low), 0, 1)
        return np.where(s["n"] > 0, at[i - 1] + np.nan_to_num(part) * (at[i] - at[i - 1]), np.nan)

    return Statistic({"n": x.isNotNull().cast("double"), **{f"to {i}": (x <= float(e)).cast("double") for i, e in enumerate(at)}}, value)


def bootstrap(rows: DataFrame, statistic: Statistic, unit: str = "row_id", kind: str = "units", block: float | None = None, replicates: int = 1000, alpha: float = 0.05, seed: int = 17, key: str = "policy") -> DataFrame:
    """(key, n, cells, estimate, se, lo, hi): the statistic, its bootstrap error and percentile interval, of each key.

    kind "units": units (rows, or clusters such as prompts) are hashed into at most CELLS cells, and a replicate draws as many cells as
    there are, with return. A cell holds whole units, so it is a sample of them and what sums vary by is the same. kind "stationary" or
    "moving": unit is the order of rows (without ties); cells are runs of neighbours, single rows up to CELLS rows, and blocks are runs of
    cells, of geometric length with mean block, or of that length; n to the power 1/3 rows by default, one cell at least. Stationary
    blocks go on from the start at the end.

    Rows are read once and added up before the shuffle; a key is CELLS rows of sums in its task, whatever its number of rows or the
    number of replicates. Draws depend on seed and key only, so a task that runs again draws the same. Nulls add nothing. Replicates without a
    value are left out; error and interval are null where fewer than two have one, the estimate where it has none.
    """
    if kind not in ("units", "stationary", "moving"):
        raise ValueError(f"unknown kind {kind}")
    sums = {f"s{i}": c for i, c in enumerate(statistic.sums.values())}
    own = rows.select(F.col(key).cast("string").alias("key"), F.col(unit).alias("unit"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    if kind == "units":
        placed = own.withColumn("cell", F.pmod(F.xxhash64("unit"), F.lit(CELLS)))
    else:
        numbered = running(own.withColumn("one", F.lit(1)), ["key"], "unit", {"nth": "one"})
        length = numbered.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELLS).alias("length"))
        placed = numbered.join(F.broadcast(length), "key").withColumn("cell", F.floor((F.col("nth") - 1) / F.col("length")))
    cells = placed.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in sums])
    names, columns, value = list(statistic.sums), list(sums), statistic.value  # no Columns: tasks get this

    def replicated(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("cell")
        x, count, n, label = table[columns].to_numpy(float), len(table), int(table["n"].sum()), table["key"].iloc[0]
        rng = np.random.default_rng([seed, *str(label).encode()])
        at = lambda totals: value({name: totals[:, i] for i, name in enumerate(names)})
        span = max(1, min(count, round((block or max(1, int(n ** (1 / 3)))) * count / n)))
        found = np.concatenate([at(_times(rng, kind, count, span, min(_AT_ONCE, replicates - r)) @ x) for r in range(0, replicates, _AT_ONCE)])
        found, estimate = found[np.isfinite(found)], float(at(x.sum(0, keepdims=True))[0])
        se, lo, hi = (found.std(ddof=1), *np.quantile(found, [alpha / 2, 1 - alpha / 2])) if len(found) > 1 else (None, None, None)
        return pd.DataFrame({"key": [label], "n": [n], "cells": [count], "estimate": [estimate if np.isfinite(estimate) else None], "se": [se], "lo": [lo], "hi": [hi]})

    return cells.groupBy("key").applyInPandas(replicated, "key string, n long, cells long, estimate double, se double, lo double, hi double").withColumnRenamed("key", key)


def _times(rng: np.random.Generator, kind: str, count: int, span: int, replicates: int) -> np.ndarray:
    """How often each replicate (row) draws each of count cells."""
    if kind == "units":
        return rng.multinomial(count, np.full(count, 1 / count), size=replicates).astype(float)
    if kind == "moving":
        starts = rng.integers(0, count - span + 1, (replicates, -(-count // span)))
        drawn = (starts[:, :, None] + np.arange(span)).reshape(replicates, -1)[:, :count]
    else:
        # at each place a new block starts with a chance of one in span, else the neighbour follows
        fresh, starts, place = rng.random((replicates, count)) < 1 / span, rng.integers(0, count, (replicates, count)), np.arange(count)
        fresh[:, 0] = True
        begun = np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
        drawn = (np.take_along_axis(starts, begun, 1) + place - begun) % count
    return np.stack([np.bincount(d, minlength=count) for d in drawn]).astype(float)
