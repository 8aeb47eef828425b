"""Partial labels: a seeded share of the labels stays, the others can be brought back; folds by blake2b; prompts from conversations."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order_stats import kth_largest
from .tables import written

LEAST_KEPT = 2


def _place(row: Column, seed: int) -> Column:
    """48 bits of md5, which a double holds exactly."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), row.cast("string"))), 1, 12), 16, 10).cast("double")


def masked(rows: DataFrame, share: float, seed: int = 0, row: str = "row_id", label: str = "oracle_label", kept: str = "all_labels") -> DataFrame:
    """rows with all labels in the column kept and only a share of them in label: of m labels the floor of share * m (2 at least, m at most)
    whose rows' hashes are least, ties to the smaller row. All rows stay. row tells rows apart; rows are written once.

    The last hash to stay is found by refined histograms (order_stats), so nothing is sorted and no label comes to the driver.
    """
    if not 0 <= share <= 1:
        raise ValueError("share is from 0 to 1")
    own = written(rows.withColumns({kept: F.col(label), "__place": F.when(F.col(label).isNotNull(), _place(F.col(row), seed))}), "labels")
    m = own.agg(F.count("__place")).first()[0]
    k = min(m, max(LEAST_KEPT, int(m * share)))
    if not k:
        return own.drop("__place")
    least = own.select(F.lit("").alias("policy"), (-F.col("__place")).alias("w"))
    edge = kth_largest(least, rows.sparkSession.range(1).select(F.lit("").alias("policy"), F.lit(k).cast("long").alias("k"))).first()
    # rows of one 48-bit hash: few, and usually one
    last = own.where(F.col("__place") == -edge["edge"]).orderBy(row).limit(k - edge["over"]).select(F.col(row).alias("__row"))
    stays = (F.col("__place") < -edge["edge"]) | F.col("__row").isNotNull()
    return own.join(F.broadcast(last), F.col(row) == F.col("__row"), "left").withColumn(label, F.when(stays, F.col(label))).drop("__place", "__row")


def restored(rows: DataFrame, label: str = "oracle_label", kept: str = "all_labels") -> DataFrame:
    """masked() undone."""
    return rows.withColumn(label, F.col(kept)).drop(kept)


def blake2b_fold(prompt_id: Column, folds: int = 5, seed: int = 42) -> Column:
    """The fold by the first eight bytes of blake2b of id, seed and number of folds, for logs whose folds were drawn so elsewhere; Spark
    has no blake2b, so it goes through Arrow (estimators.fold_of stays in the JVM). Fewer than two folds, or an empty or missing id, are errors."""
    if folds < 2:
        raise ValueError("two folds at least")

    @F.pandas_udf("int")
    def fold(ids: pd.Series) -> pd.Series:
        if (ids.isna() | (ids == "")).any():
            raise ValueError("a row without a prompt id has no fold")
        return ids.map(lambda v: int.from_bytes(hashlib.blake2b(f"{v}-{seed}-{folds}".encode(), digest_size=8).digest(), "big") % folds).astype("int32")

    return fold(prompt_id.cast("string"))


def first_prompts(turns: DataFrame, n: int | None = None, languages: tuple[str, ...] | None = None) -> DataFrame:
    """(conv_id, text) from (conv_id, turn, role, text[, lang]): each conversation's first user turn that isn't blank, trimmed; of equal texts the
    smallest conv_id; then the n smallest conv_ids. With languages only turns in them count."""
    own = turns.where((F.col("role") == "user") & (F.trim("text") != ""))
    if languages is not None:
        own = own.where(F.col("lang").isin(*languages))
    first = own.groupBy("conv_id").agg(F.min_by(F.trim("text"), "turn").alias("text"))
    alone = first.groupBy("text").agg(F.min("conv_id").alias("conv_id")).select("conv_id", "text")
    return alone if n is None else alone.orderBy("conv_id").limit(n)
