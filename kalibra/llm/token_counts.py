"""Token counts through a digest cache (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import SPACE, SPACE_CLASS, saved

CACHE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])

#: A content that makes up more than one in so many rows is broadcast with its count.
HOT_SHARE = 1000


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; none where nothing has been written yet. A count written twice (a repeated job) counts once."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, digest, n_bytes, n_tokens) for each row of docs.

    Content is normalised in a way that leaves the ids alone (runs of ASCII white space become one
    space, none at the ends; only for tokenizers that drop white space) and digested. Counts stored for
    the digest and the tokenizer's own digest are joined; of contents without one, a single copy is
    encoded and its count appended to the cache, so a second run encodes nothing.

    A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat come out as often as they are;
    null ids stay null. Other columns of docs are not read.
    """
    spark, version = docs.sparkSession, tokens.version(tokenizer_path)
    body = F.coalesce(F.col(text), F.lit(""))
    if tokens.encoder(tokenizer_path).by_chunk:
        body = F.trim(F.regexp_replace(body, SPACE_CLASS + "+", " "), F.lit(SPACE))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    seen = saved(keyed.select("doc_id", "n_bytes", "digest"), "token-digests")
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    # of each new content one document is encoded; rows that repeat its id and content come to one task, which encodes the first
    fresh = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(known, "digest", "left_anti")
    due = keyed.alias("k").join(fresh.hint("shuffle_hash").alias("f"), (F.col("k.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("k.digest") == F.col("f.digest")), "left_semi").select("digest", "body")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, done = tokens.encoder(tokenizer_path), set()
        for b in batches:
            new = [(d, len(e.encode(x)) // 4) for d, x in zip(b.column(0).to_pylist(), tokens.utf8(b.column(1)), strict=True) if not (d in done or done.add(d))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in new], pa.string()), pa.array([version] * len(new), pa.string()), pa.array([n for _, n in new], pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    due.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    # rows of a very common content would meet in one task of a shuffle; those contents, HOT_SHARE at most, are broadcast
    hot = seen.groupBy("digest").count().where(F.col("count") > max(1, seen.count() // HOT_SHARE)).select("digest")
    hot = saved(known.join(F.broadcast(hot), "digest"), "hot-counts")
    found = seen.join(F.broadcast(hot), "digest").unionByName(seen.join(F.broadcast(hot), "digest", "left_anti").join(known, "digest"), allowMissingColumns=True)
    return found.select("doc_id", "digest", "n_bytes", "n_tokens")
