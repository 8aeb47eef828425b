"""A smooth mean given a score: cubic B-splines with a ridge penalty, from sums that Spark adds up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basis(x: np.ndarray, low: float, high: float, n_knots: int, degree: int = 3) -> np.ndarray:
    """Uniform B-splines over [low, high], by Cox and de Boor's recursion; the last one is left out, as an intercept stands for it.

    Beyond the ends the value at the end holds.
    """
    step = (high - low) / (n_knots - 1) or 1.0
    x = np.clip(x, low, low + step * (n_knots - 1))
    t = low + step * np.arange(-degree, n_knots + degree)
    b = ((x[:, None] >= t[:-1]) & (x[:, None] < t[1:])).astype(float)
    at_end = x >= t[n_knots - 1 + degree]
    b[at_end] = 0
    b[at_end, n_knots - 2 + degree] = 1
    for d in range(1, degree + 1):
        left, right = (x[:, None] - t[: -d - 1]) / (t[d:-1] - t[: -d - 1]), (t[d + 1 :] - x[:, None]) / (t[d + 1 :] - t[1:-d])
        b = left * b[:, :-1] + right * b[:, 1:]
    return b[:, : n_knots + degree - 2]


class Smoother:
    def __init__(self, low: float, high: float, n_knots: int, weights: np.ndarray):
        self.low, self.high, self.n_knots, self.weights = low, high, n_knots, weights

    def at(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + basis(x, self.low, self.high, self.n_knots) @ self.weights[1:]


def fit(rows: DataFrame, x: str, y: str, most_knots: int = 8, alphas: tuple[float, ...] = tuple(np.logspace(-3, 3, 13))) -> Smoother:
    """The smoother of y on x. Rows with nulls don't count."""
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.lit(0).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    found = fit_levels(sums(own, "k"), most_knots, alphas)
    if not found:
        raise ValueError("no rows to fit")
    return found[0]


def sums(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, c, s, ss): rows, the sum of y and of its squares, by level of x."""
    return rows.groupBy(*keys, "x").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))


def fit_levels(levels: DataFrame, most_knots: int = 8, alphas: tuple[float, ...] = tuple(np.logspace(-3, 3, 13)), rows_a_knot: int = 4) -> dict[int, Smoother]:
    """A smoother for each k (int) of levels (k, x, c, s, ss). Knots: one for rows_a_knot of k's rows, 4 to most_knots of them.

    Every task adds up its products of basis functions (at most 11 by 11 numbers a k); the penalty whose leave-one-out errors, added
    up in a second pass, are least wins.
    """
    spans = levels.groupBy("k").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("c").alias("n")).collect()  # a row a fold
    shape = {r["k"]: (r["low"], r["high"], int(min(most_knots, max(4, r["n"] // rows_a_knot)))) for r in spans}
    design = lambda k, x: np.column_stack([np.ones(len(x)), basis(x, *shape[k])])

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for p in parts:
            for k, g in p.groupby("k", sort=False):
                b = design(k, g["x"].to_numpy())
                total[k] = total.get(k, 0) + np.column_stack([b.T @ (b * g[["c"]].to_numpy()), b.T @ g["s"].to_numpy()])
        for k, m in total.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"k": k, "i": i.ravel(), "j": j.ravel(), "v": m.ravel()})

    cells = levels.mapInPandas(products, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect()
    made = {k: np.zeros((n + 2, n + 3)) for k, (_, _, n) in shape.items()}
    for r in cells:
        made[r["k"]][r["i"], r["j"]] = r["v"]
    solved = {k: [np.linalg.pinv(m[:, :-1] + a * np.diag([0.0, *np.ones(len(m) - 1)])) for a in alphas] for k, m in made.items()}
    weights = {k: [s @ m[:, -1] for s in solved[k]] for k, m in made.items()}

    def left_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k, g in p.groupby("k", sort=False):
                b, c, s, ss = design(k, g["x"].to_numpy()), g["c"].to_numpy(), g["s"].to_numpy(), g["ss"].to_numpy()
                for i, (inverse, w) in enumerate(zip(solved[k], weights[k], strict=True)):
                    f, own = b @ w, np.maximum(1 - np.einsum("ij,jk,ik->i", b, inverse, b), 1e-12)
                    yield pd.DataFrame({"k": [k], "i": [i], "v": [float(((ss - 2 * f * s + c * f * f) / own**2).sum())]})

    errors = levels.mapInPandas(left_out, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    best: dict[int, tuple[float, int]] = {}
    for r in errors:
        best[r["k"]] = min(best.get(r["k"], (np.inf, 0)), (r["v"], r["i"]))
    return {k: Smoother(*shape[k], weights[k][i]) for k, (_, i) in best.items()}


def predict(rows: DataFrame, smoother: Smoother, x: str, name: str) -> DataFrame:
    """Adds name, the smoother at x; null where x is null."""

    @F.pandas_udf("double")
    def at(v: pd.Series) -> pd.Series:
        held = v.notna().to_numpy()
        out = pd.Series([None] * len(v), dtype="Float64")
        out[held] = smoother.at(v.to_numpy(float)[held])
        return out

    return rows.withColumn(name, at(F.col(x).cast("double")))


def predict_keyed(rows: DataFrame, smoothers: dict[int, Smoother], key: str, x: str, name: str) -> DataFrame:
    """Adds name, the smoother of the row's key (int) at x; null where x is null or the key has none."""
    held = rows.sparkSession.sparkContext.broadcast(smoothers)  # some twelve numbers a key

    @F.pandas_udf("double")
    def at(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, v in parts:
            out, value = np.full(len(v), np.nan), v.to_numpy(float)
            for one, places in k.groupby(k, sort=False).indices.items():
                if (smoother := held.value.get(int(one))) is not None:
                    places = places[~np.isnan(value[places])]
                    out[places] = smoother.at(value[places])
            yield pd.Series(out).astype(object).where(~np.isnan(out), None).astype("Float64")

    return rows.withColumn(name, at(F.col(key), F.col(x).cast("double")))
