"""Tables written once where several later steps read them, and running sums over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_fallback: list[str] = []
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end, also after an error; what is to last is written elsewhere before. Scopes nest."""
    made: list[str] = []
    before = _owner.set(made)
    try:
        yield
    finally:
        _owner.reset(before)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Without that setting only a local master may go on, in a temporary folder; elsewhere each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="spark-tables-"))
        base = _fallback[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _owner.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet at a scratch() path, read again: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's as a local relation: it is broadcast without a job of its own."""
    want = StructType.fromDDL(schema)
    columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in want]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(want), strict=True)], names=want.names), want)


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """Adds for each (name, column) of sums the column's sum over rows of equal keys up to this one, in the order (without ties).

    Ranges of (keys, order) are summed where they lie. Only keys that go on from an earlier range need the totals before it, one of each
    range at most, so what is broadcast is a row a range however many keys there are, and no key is one task. Ranges are written first:
    a second reading would draw them anew.
    """
    dealt = written(df.repartitionByRange(*keys, order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("__range", *keys).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    ahead = totals.select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)], F.count(F.lit(1)).over(before).alias("__earlier"), *[F.sum(f"__t_{n}").over(before).alias(f"__a_{n}") for n in sums])
    within = W.partitionBy("__range", *keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    own = dealt.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()]).join(F.broadcast(ahead.where("__earlier > 0").drop("__earlier")), same, "left")
    return own.withColumns({n: F.col(n) + F.coalesce(F.col(f"__a_{n}"), F.lit(0)) for n in sums}).select(*df.columns, *sums)
