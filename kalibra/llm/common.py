"""What the operators of this subpackage share: scratch tables, word splitting, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space, the only white space that splits words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_fallback: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and its master is local (tests on one machine), a temporary folder is taken: on a cluster
    each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            base = held
        else:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            if not _fallback:
                _fallback.append("file://" + tempfile.mkdtemp(prefix="spark-scratch-"))
            base = _fallback[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared scratch folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df doesn't have, so that no column of the user's is hidden or lost."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Where bytes and characters are as many, lower() does the same and is faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def spread(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def first_by_hash(rows: DataFrame, order: str, limit: int, of: str | None = None) -> DataFrame:
    """The rows with the limit least values of order (a hash of all that tells rows apart), of each value of `of` where it is
    named; one row of a value, however often it is repeated. Only values are ranked, so no task hands on whole rows that are
    then left out."""
    by = [of] if of else []
    values = rows.where(F.col(order).isNotNull()).select(*by, order).distinct()
    if of:
        values = values.withColumn("__rank", F.row_number().over(W.partitionBy(of).orderBy(order))).where(F.col("__rank") <= limit).drop("__rank")
    else:
        values = values.orderBy(order).limit(limit)
    return rows.join(F.broadcast(values), [*by, order], "left_semi").dropDuplicates([*by, order])
