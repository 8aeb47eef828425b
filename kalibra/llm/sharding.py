"""Shards in random order by a two-pass external shuffle (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

#: Up to so many buckets their starts are broadcast (16 bytes each); beyond it they are joined.
BROADCAST_BUCKETS = 100_000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A random order of range(n), decided by seed and bucket alone."""
    order = np.arange(n)
    draws = (np.random.default_rng([seed, bucket]).random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 17, bucket_bytes: int = 16 << 20, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes docs to path/shard=0.. in random order; each row also gets its slot in its shard.

    Pass 1 scatters rows uniformly, by a seeded hash of id and text, into as many buckets as make bucket_bytes
    each. Pass 2 takes a bucket at a time, brings it into a fixed order (by id, then text), shuffles it by
    Fisher-Yates and writes it. The buckets one after the other are the random order of all; a shard is an
    equal share of it, so the shards' counts differ by one at most and slots have no gaps. A lost task
    makes the same rows again.

    Null ids and texts are rows like others, rows that repeat (all columns equal) are kept as often as they
    are; a bucket holds all rows of one id and text. Columns named shard or slot are
    replaced. An empty table writes no shard.
    """
    spark = docs.sparkSession
    if n_shards < 1 or bucket_bytes < 1:
        raise ValueError("n_shards and bucket_bytes must be positive")
    total, n = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)), F.count(F.lit(1))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    rows = docs.drop("shard", "slot")
    bucket, start, place = unused(rows, "__bucket", "__start", "__place")
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text)), F.lit(buckets)))
    starts = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).select(bucket, F.coalesce(F.sum("n").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(start))

    def shuffled(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([(doc_id, "ascending"), (text, "ascending")])
        order = fisher_yates(table.num_rows, seed, key[0].as_py())
        return table.take(pa.array(order)).append_column(place, pa.array(np.arange(table.num_rows, dtype=np.int64)))

    out = rows.groupBy(bucket).applyInArrow(shuffled, T.StructType([*rows.schema.fields, T.StructField(place, T.LongType())]))
    at = F.col(start) + F.col(place)
    dealt = out.join(F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts, bucket).withColumn("shard", F.expr(f"int((({n_shards}L * ({start} + {place}) + {n_shards - 1}) div {max(n, 1)}L))"))
    placed = dealt.withColumn("slot", at - F.expr(f"(shard * {n}L) div {n_shards}L")).drop(bucket, start, place)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all shards; schema: that of the documents written."""
    fields = [f for f in schema.fields if f.name not in ("shard", "slot")]
    return spark.read.schema(T.StructType([*fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(path)
