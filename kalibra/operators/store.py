"""Calibration models as tables: fitted once, applied to other data and in other sessions.

A model is a folder of three small tables: about (its version, mode, folds and the figures that chose the mode), blocks (of the rising
fits, a row a block and fold; fold -1 has seen all labels) and smoothers (of the two-stage form, a row a fold).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import calibration, isotonic, splines

#: Fixed value: the layout's version; others are refused.
VERSION = 1
#: Blocks up to this number come to the driver and are broadcast (24 bytes each); beyond it data are joined to them.
MOST_BLOCKS = 1_000_000
ABOUT = "version int, mode string, folds array<int>, choice map<string,double>"
BLOCKS = "fold int, place int, x_lo double, x_hi double, y double"
SMOOTHERS = "fold int, low double, high double, n_knots int, weights array<double>"


def save(spark: SparkSession, fitted: calibration.Calibration, path: str) -> None:
    """Writes a model to a new folder; one that is there already is an error."""
    folds = sorted(k[0] for k in fitted.models)
    blocks = [(int(k[0]), i, float(lo), float(hi), float(v)) for k, (x, y) in fitted.models.items() for i, (lo, hi, v) in enumerate(zip(x[0::2], x[1::2], y[0::2], strict=True))]
    smoothers = [(int(k), float(s.low), float(s.high), int(s.n_knots), [float(w) for w in s.weights]) for k, s in fitted.smoothers.items()]
    spark.createDataFrame([(VERSION, fitted.mode, [int(f) for f in folds], {k: float(v) for k, v in fitted.choice.items()})], ABOUT).coalesce(1).write.parquet(f"{path}/about")
    spark.createDataFrame(blocks, BLOCKS).repartitionByRange("fold", "x_lo").write.parquet(f"{path}/blocks")
    spark.createDataFrame(smoothers, SMOOTHERS).coalesce(1).write.parquet(f"{path}/smoothers")


def _about(spark: SparkSession, path: str):
    about = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
    if about is None or about["version"] != VERSION:
        raise ValueError(f"{path}: not a calibration model of version {VERSION}")
    return about


def _smoothers(spark: SparkSession, path: str) -> dict[int, splines.Smoother]:
    rows = spark.read.schema(SMOOTHERS).parquet(f"{path}/smoothers").collect()  # a row a fold
    return {r["fold"]: splines.Smoother(r["low"], r["high"], r["n_knots"], np.array(r["weights"])) for r in rows}


def load(spark: SparkSession, path: str) -> calibration.Calibration:
    """The model of a folder, at the driver; models of more than MOST_BLOCKS blocks are only applied as tables, by apply()."""
    about, blocks = _about(spark, path), spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if blocks.count() > MOST_BLOCKS:
        raise ValueError(f"{path}: the model has over {MOST_BLOCKS} blocks; apply() joins it")
    models = {(f,): (np.zeros(0), np.zeros(0)) for f in about["folds"]} | isotonic.knots(blocks, ["fold"])
    return calibration.Calibration(about["mode"], models, _smoothers(spark, path), dict(about["choice"]))


def apply(rows: DataFrame, path: str, fold: str | None = None, score: str = "judge_score", name: str = "reward") -> DataFrame:
    """rows with name, the reward in [0, 1] by the saved model: that of all labels, or of the row's fold (column fold).

    Every column of rows passes; one called as name is replaced. A null score gets null. A fold that the model hasn't is an error
    when the result is computed. Large models are joined as a table, others broadcast.
    """
    spark = rows.sparkSession
    about, blocks = _about(spark, path), spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if fold:
        known = F.col(fold).isNull() | F.col(fold).isin([f for f in about["folds"] if f >= 0])
        rows = rows.withColumn(fold, F.when(known, F.col(fold)).otherwise(F.raise_error(F.concat(F.lit("the saved model has no fold "), F.col(fold).cast("string"))).cast(rows.schema[fold].dataType)))
    if blocks.count() <= MOST_BLOCKS:
        return load(spark, path).at(rows, fold, name, score)
    own = rows.withColumn("__k", F.col(fold).cast("int") if fold else F.lit(-1))
    own = own.withColumn("__x", F.col(score).cast("double")) if about["mode"] == "monotone" else calibration.indexed(own, _smoothers(spark, path), "__k", score, "__x")
    return isotonic.predict_levels(own, blocks.withColumnRenamed("fold", "__k"), ["__k"], "__x", name, 0.0, 1.0).drop("__k", "__x")
