"""Calibration of judge scores that need not be monotone: a smooth index first, then a rising fit on its ranks; and the choice between
this form and the monotone one.

All is a function of (fold, score): labels are added up by these once, and fits, errors and thirds come from the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import estimators, isotonic, splines
from .tables import running, written

#: Fixed value: fewer labels than these get no smooth index.
LEAST_LABELS = 20
Knots = dict[tuple, tuple[np.ndarray, np.ndarray]]


@dataclass
class Calibration:
    """mode; models by (fold,), of which fold -1 has seen all labels; smoothers by fold where the form has two stages; the errors that chose."""

    mode: str
    models: Knots
    smoothers: dict[int, splines.Smoother] = field(default_factory=dict)
    choice: dict[str, float] = field(default_factory=dict)

    def at(self, rows: DataFrame, fold: str | None, name: str, score: str = "judge_score") -> DataFrame:
        """Adds name: the reward in [0, 1] by the model of the row's fold (column fold), or of all labels; fold models are always asked at
        their own index, whatever the mode. Null where the score is."""
        own = rows.withColumn("__cal_k", F.col(fold).cast("int") if fold else F.lit(-1))
        own = own.withColumn("__cal_x", F.col(score).cast("double")) if self.mode == "monotone" else indexed(own, self.smoothers, "__cal_k", score, "__cal_x")
        return isotonic.predict(own, self.models, ["__cal_k"], "__cal_x", name, 0.0, 1.0).drop("__cal_k", "__cal_x")


def _steps(knots: Knots) -> Knots:
    """Each block's value from its start up to the next one's: ranks jump from the end of a block to the start of the next, so
    between them a rank is still the block's last."""
    out = {}
    for k, (x, y) in knots.items():
        low = x[0::2]
        out[k] = (np.column_stack([low, np.append(np.nextafter(low[1:], -np.inf), max(x[-1], low[-1]))]).ravel(), y)
    return out


def indexed(rows: DataFrame, smoothers: dict[int, splines.Smoother], fold: str, x: str, name: str) -> DataFrame:
    """Adds name: the fold's smoother at x, to twelve decimals, so that equal scores are ties; x itself where the fold has none."""
    held = rows.sparkSession.sparkContext.broadcast(smoothers)

    @F.pandas_udf("double")
    def at(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, v in parts:
            value, k = v.to_numpy(float), k.to_numpy()
            out = value.copy()
            for one in np.unique(k[~pd.isna(k)]):
                own = (k == one) & ~np.isnan(value)
                if (s := held.value.get(int(one))) is not None:
                    out[own] = np.round(s.at(value[own]), 12)
            yield pd.Series(out).astype(object).where(~np.isnan(out), None).astype("Float64")

    return rows.withColumn(name, at(F.col(fold), F.col(x).cast("double")))


def _levels(rows: DataFrame) -> DataFrame:
    """(fold, x, c, s, ss, s3, s4): labelled rows and sums of powers of labels, by fold and score."""
    y = F.col("oracle_label").cast("double")
    own = rows.where(F.col("judge_score").isNotNull() & y.isNotNull())
    return written(own.groupBy("fold", F.col("judge_score").cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"), F.sum(y * y * y).alias("s3"), F.sum(y * y * y * y).alias("s4")), "labels")


def fit(rows: DataFrame, mode: str = "monotone", folds: int = estimators.FOLDS) -> Calibration:
    """Of rows (fold, judge_score, oracle_label): mode is monotone, two_stage or auto. A fold's model has not seen the fold.

    two_stage: penalised splines of the label on the score, ranks of their values, a rising fit of the labels on the ranks. A fold
    with fewer than 20 labels ranks the scores; with fewer in all, the model of all labels is the monotone one.
    """
    if mode not in ("monotone", "two_stage", "auto"):
        raise ValueError(f"unknown mode {mode}")
    levels = _levels(rows)
    left_out = F.array_append(F.array_remove(F.sequence(F.lit(0), F.lit(folds - 1)), F.col("fold").cast("int")), F.lit(-1))
    train = levels.select(F.explode(left_out).alias("k"), "x", "c", "s", "ss").groupBy("k", "x").agg(*[F.sum(v).alias(v) for v in ("c", "s", "ss")])
    rising = lambda t, x: isotonic.knots(isotonic.fit(t.withColumn("y", F.col("s") / F.col("c")), ["k"], x, "y", F.col("c")), ["k"])
    monotone = Calibration("monotone", rising(train, "x")) if mode != "two_stage" else None
    if mode == "monotone":
        return monotone
    n = {r["k"]: r["n"] for r in train.groupBy("k").agg(F.sum("c").alias("n")).collect()}
    enough = [k for k, m in n.items() if m >= LEAST_LABELS]
    smoothers = splines.fit_levels(train.where(F.col("k").isin(enough))) if enough else {}
    plain = rising(indexed(train, smoothers, "k", "x", "g"), "g")
    models = _steps(plain)
    if n.get(-1, 0) < LEAST_LABELS and (-1,) in plain:
        models[(-1,)] = plain[(-1,)]
    two = Calibration("two_stage", models, smoothers)
    return two if mode == "two_stage" else choose(levels, monotone, two)


def choose(levels: DataFrame, monotone: Calibration, two: Calibration) -> Calibration:
    """The two-stage form where its error out of fold is less by over one standard error, or less in two of three thirds of the scores.

    Thirds are by position (n // 3 rows, twice, and the rest); of a score whose rows lie in two thirds each takes its share.
    """
    own = isotonic.predict(levels, monotone.models, ["fold"], "x", "p1", 0.0, 1.0)
    own = isotonic.predict(indexed(own, two.smoothers, "fold", "x", "g"), two.models, ["fold"], "g", "p2", 0.0, 1.0)
    square = lambda p: F.col("ss") - 2 * F.col(p) * F.col("s") + F.col("c") * F.col(p) * F.col(p)
    p = F.col("p1")
    fourth = F.col("s4") - 4 * p * F.col("s3") + 6 * p * p * F.col("ss") - 4 * p * p * p * F.col("s") + F.col("c") * p * p * p * p
    by_x = running(own.groupBy("x").agg(F.sum("c").alias("c"), F.sum(square("p1")).alias("e1"), F.sum(square("p2")).alias("e2"), F.sum(fourth).alias("f1")), [], "x", {"upto": "c"})
    by_x = written(by_x, "thirds")
    n = by_x.agg(F.sum("c")).first()[0] or 0.0
    third, below = n // 3, F.col("upto") - F.col("c")
    edges = [(0.0, third), (third, 2 * third), (2 * third, n)]
    share = [F.greatest(F.lit(0.0), F.least("upto", F.lit(hi)) - F.greatest(below, F.lit(lo))) / F.col("c") for lo, hi in edges]
    r = by_x.agg(F.sum("e1").alias("e1"), F.sum("e2").alias("e2"), F.sum("f1").alias("f1"), *[F.sum(s * F.col(e)).alias(f"{e}_{i}") for i, s in enumerate(share) for e in ("e1", "e2")]).first()
    if not n:
        return monotone
    rmse_1, rmse_2 = max(r["e1"], 0.0) ** 0.5 / n**0.5, max(r["e2"], 0.0) ** 0.5 / n**0.5
    spread = max(0.0, (r["f1"] - r["e1"] ** 2 / n) / (n - 1)) ** 0.5 if n > 1 else 0.0
    se = spread / n**0.5 / (2 * max(rmse_1, 1e-12))
    better = sum(r[f"e2_{i}"] < r[f"e1_{i}"] for i in range(3))
    won = two if rmse_2 < rmse_1 - se or better >= 2 else monotone
    won.choice = {"rmse_monotone": rmse_1, "rmse_two_stage": rmse_2, "se": se, "better_thirds": float(better)}
    return won


def index(rows: DataFrame, calibration: Calibration, fold: str | None = None, name: str = "index") -> DataFrame:
    """Adds what the rising fit is on, by the model of all labels or by those of the folds: the score, or the smoother at it (whose
    ranks among the labelled rows the fit is on; ranks(), where they are asked for as such)."""
    if calibration.mode == "monotone":
        return rows.withColumn(name, F.col("judge_score").cast("double"))
    return indexed(rows.withColumn("__k", F.col(fold) if fold else F.lit(-1)), calibration.smoothers, "__k", "judge_score", name).drop("__k")


def ranks(rows: DataFrame, labelled: DataFrame, calibration: Calibration) -> DataFrame:
    """(judge_score, index, rank): at every score of rows the share of labelled rows whose index is no larger, less half a row."""
    asked = index(rows.where("judge_score is not null").select("judge_score").distinct(), calibration)
    known = index(labelled.where("judge_score is not null and oracle_label is not null").groupBy("judge_score").agg(F.count(F.lit(1)).alias("c")), calibration)
    every = known.select("index", "c").unionByName(asked.select("index", F.lit(0).cast("long").alias("c"))).groupBy("index").agg(F.sum("c").alias("c"))
    n = known.agg(F.sum("c").alias("n"))
    upto = running(every, [], "index", {"upto": "c"}).crossJoin(F.broadcast(n)).select("index", ((F.col("upto") - 0.5) / F.col("n")).alias("rank"))  # n: one row
    return asked.join(upto, "index").select("judge_score", "index", "rank")


def apply(rows: DataFrame, calibration: Calibration) -> DataFrame:
    """Adds reward (the model of all labels) and reward_oof (the fold's), both in [0, 1]; null where the score is."""
    return calibration.at(calibration.at(rows, None, "reward"), "fold", "reward_oof")
