"""Outcome models: what a reward is expected to be, cross-fitted by folds, for the direct part of doubly robust estimates.

A model is fitted by (policy, fold) on the rows of the other folds. It needs only sums over rows, so Spark adds up each fold's
own and takes them off the total; a caller's model states its sums, how they become parameters, and the value at a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import calibration, estimators, isotonic
from .estimators import FOLDS
from .tables import written

KEYS = ["policy", "fold"]


def features(prompt: Column, response: Column, score: Column) -> list[Column]:
    """Words of the prompt, words of the response, the score, and one. Null texts have no words."""
    words = lambda t: F.when(F.coalesce(F.trim(t), F.lit("")) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+"))).cast("double")
    return [words(prompt), words(response), score.cast("double"), F.lit(1.0)]


@dataclass(frozen=True)
class SumsModel:
    """A model of a caller's: features are columns; sums(x, y) gives fixed-size sums over a batch's rows (x: rows by features), solve(sums)
    the parameters, value(parameters, x) the outcome at each row. low and high cut it."""

    x: list[Column]
    sums: Callable[[np.ndarray, np.ndarray], np.ndarray]
    solve: Callable[[np.ndarray], np.ndarray]
    value: Callable[[np.ndarray, np.ndarray], np.ndarray]
    low: float | None = 0.0
    high: float | None = 1.0


def linear(x: list[Column], penalty: float = 1.0) -> SumsModel:
    """Ridge regression: the penalty holds for all coefficients, the constant's included."""
    k = len(x)

    def solve(s: np.ndarray) -> np.ndarray:
        m = s.reshape(k, k + 1)
        return np.linalg.solve(m[:, :k] + penalty * np.eye(k), m[:, k])

    return SumsModel(x, lambda x, y: np.column_stack([x.T @ x, x.T @ y]).ravel(), solve, lambda c, x: x @ c)


@dataclass(frozen=True)
class Isotonic:
    """The rising fit of rewards on the score, or on the index of a calibration: out of fold where the model is fitted, that of all labels
    where it is asked."""

    index: calibration.Calibration | None = None


def _known(rows: DataFrame, known: list[tuple[str, int]], value: Column) -> Column:
    """value where the row's policy and fold have a model; an error, when computed, where they haven't."""
    has = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in KEYS]).isin([f"{p}\x1f{f}" for p, f in known]) & F.col("policy").isNotNull() & F.col("fold").isNotNull()
    told = F.concat(F.lit("no outcome model for policy and fold "), F.coalesce(F.col("policy").cast("string"), F.lit("null")), F.lit(", "), F.coalesce(F.col("fold").cast("string"), F.lit("null")))
    return F.when(has, value).otherwise(F.raise_error(told).cast("double"))


class Fitted:
    """Outcome models by policy and fold; predict() adds their value to any rows with policy, fold and what the features need."""

    def __init__(self, model: SumsModel | Isotonic, by: dict[tuple[str, int], object]):
        self.model, self.by = model, by

    def predict(self, rows: DataFrame, name: str = "g") -> DataFrame:
        """Null where a feature is null. A policy or fold without a model is an error when the result is computed."""
        model = self.model
        if isinstance(model, Isotonic):
            own = calibration.index(rows, model.index, None, "__x") if model.index else rows.withColumn("__x", F.col("judge_score").cast("double"))
            own = isotonic.predict(own, self.by, KEYS, "__x", name)
            return own.withColumn(name, _known(own, list(self.by), F.col(name))).drop("__x")
        by, value_at, low, high = rows.sparkSession.sparkContext.broadcast(self.by), model.value, model.low, model.high  # a few numbers a policy and fold

        @F.pandas_udf("double")
        def at(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for policy, fold, *x in parts:
                x, out = np.column_stack([v.to_numpy(float) for v in x]), np.full(len(policy), np.nan)
                for key, places in pd.DataFrame({0: policy, 1: fold}).groupby([0, 1], sort=False).indices.items():
                    if (parameters := by.value.get((key[0], int(key[1])))) is not None:
                        out[places] = value_at(parameters, x[places])
                out[np.isnan(x).any(axis=1)] = np.nan
                yield pd.Series((out if low is None and high is None else np.clip(out, low, high))).astype(object).where(~np.isnan(out), None).astype("Float64")

        value = at(*[F.col(k) for k in KEYS], *[c.cast("double") for c in model.x])
        return rows.withColumn(name, value).withColumn(name, _known(rows, list(self.by), F.col(name)))


def fit(rows: DataFrame, model: SumsModel | Isotonic, target: str = "reward") -> Fitted:
    """Cross-fitted models of rows (policy, fold, judge_score, target and what features need), one a policy and fold.

    Folds are those that rows have, whatever their numbers. A row without a fold, or a fold without rows in other folds of its policy, is an error.
    Rows with a null target or feature aren't learned from.
    """
    if isinstance(model, Isotonic):
        own = calibration.index(rows, model.index, "fold", "__x") if model.index else rows.withColumn("__x", F.col("judge_score").cast("double"))
        own = own.groupBy(*KEYS, "__x").agg(F.count(target).cast("double").alias("n"), F.sum(target).alias("s"))
    else:
        own = rows.select(*KEYS, F.col(target).cast("double").alias("__y"), *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(model.x)])
        own = own.mapInPandas(_adding(model.sums), "policy string, fold int, i int, n double").groupBy(*KEYS, "i").agg(F.sum("n").alias("n"))
    own = written(own, "outcome-sums")
    counts = own if isinstance(model, Isotonic) else own.where("i = -1")
    seen = counts.groupBy(*KEYS).agg(F.sum("n").alias("n")).collect()  # a row a policy and fold
    if any(r["fold"] is None or r["policy"] is None for r in seen):
        raise ValueError("rows without a policy or a fold can't be cross-fitted")
    totals: dict[str, float] = {}
    for r in seen:
        totals[r["policy"]] = totals.get(r["policy"], 0.0) + r["n"]
    if alone := sorted((r["policy"], r["fold"]) for r in seen if totals[r["policy"]] <= r["n"]):
        raise ValueError(f"no training data for policy and fold {alone[0]}")
    if isinstance(model, Isotonic):
        folds = F.create_map(*[v for p in totals for v in (F.lit(p), F.array(*[F.lit(r["fold"]) for r in seen if r["policy"] == p]))])[F.col("policy")]
        train = own.select("policy", F.explode(F.array_except(folds, F.array(F.col("fold")))).alias("fold"), "__x", "n", "s").groupBy(*KEYS, "__x").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return Fitted(model, isotonic.knots(isotonic.fit(train.where("n > 0").withColumn("y", F.col("s") / F.col("n")), KEYS, "__x", "y", F.col("n")), KEYS))
    sums: dict[tuple, np.ndarray] = {}
    for r in sorted(own.where("i >= 0").collect(), key=lambda r: r["i"]):  # a few numbers a policy and fold
        sums[r["policy"], r["fold"]] = np.append(sums.get((r["policy"], r["fold"]), np.zeros(0)), r["n"])
    every = {p: sum(v for (q, _), v in sums.items() if q == p) for p in totals}
    return Fitted(model, {k: model.solve(every[k[0]] - v) for k, v in sums.items()})


def _adding(sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sums of a task's rows as cells (policy, fold, i, n), and as cell -1 how many rows they are of."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for p in parts:
            for key, g in p.groupby(KEYS, sort=False, dropna=False):
                known = g.dropna(subset=list(g.columns[2:]))
                own = np.append(float(len(known)), sums(known.iloc[:, 3:].to_numpy(float), known.iloc[:, 2].to_numpy(float)))
                key = tuple(None if pd.isna(k) else k for k in key)
                total[key] = total[key] + own if key in total else own
        for (policy, fold), v in total.items():
            yield pd.DataFrame({"policy": policy, "fold": pd.array([fold] * len(v), dtype="Int32"), "i": np.arange(len(v), dtype=np.int32) - 1, "n": v})

    return add


def with_model(rows: DataFrame, fresh: DataFrame, fitted: Fitted) -> DataFrame:
    """As estimators.with_outcomes(), by any outcome model: adds g (at the logged row), q (its mean over the row's draws), draws and draw_var.

    fresh: (policy, prompt_id, draw_idx, judge_score and what features need); draws of policies without rows don't count. Rows whose prompt
    has no draw of the policy go.
    """
    policies = sorted({k[0] for k in fitted.by})
    drawn = fitted.predict(fresh.where(F.col("policy").isin(policies)).withColumn("fold", estimators.fold_of(F.col("prompt_id"))), "g")
    stats = drawn.groupBy("policy", "prompt_id").agg(F.avg("g").alias("q"), F.count(F.lit(1)).alias("draws"), F.coalesce(F.var_samp("g"), F.lit(0.0)).alias("draw_var"))
    return fitted.predict(rows.join(stats, ["policy", "prompt_id"]), "g")


def ridge(rows: DataFrame, target: str, x: list[Column], penalty: float = 1.0, folds: int = FOLDS) -> dict[int, np.ndarray]:
    """Coefficients by fold, each from the other folds' rows: the penalty holds for all of them, the constant's included.

    One pass adds up products by fold (a few numbers a fold); a fold's model takes the sums of all less its own.
    """
    k, own = len(x), rows.select("fold", F.col(target).alias("__y"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).where(F.col("__y").isNotNull())
    for i in range(k):
        own = own.where(F.col(f"x{i}").isNotNull())
    sums = own.groupBy("fold").agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col(f"x{i}") * F.col("__y")).alias(f"t{i}") for i in range(k)]).collect()
    a = {r["fold"]: np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for r in sums}
    b = {r["fold"]: np.array([r[f"t{i}"] for i in range(k)]) for r in sums}
    every_a, every_b = sum(a.values(), np.zeros((k, k))), sum(b.values(), np.zeros(k))
    return {f: np.linalg.solve(every_a - a.get(f, 0) + penalty * np.eye(k), every_b - b.get(f, 0)) for f in range(folds)}


def ridge_predict(rows: DataFrame, models: dict[int, np.ndarray], x: list[Column], name: str = "g") -> DataFrame:
    """Adds name, the fold's model at the row's features, cut to [0, 1]."""
    by_fold = F.create_map(*[v for f, c in models.items() for v in (F.lit(f), F.array(*[F.lit(float(w)) for w in c]))])[F.col("fold")]
    value = sum((by_fold[i] * c for i, c in enumerate(x)), F.lit(0.0))
    return rows.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
