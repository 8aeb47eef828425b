"""Documents drawn towards a target corpus by hashed n-gram features and Gumbel keys (operator 11)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crc
from .common import saved, spread, unused

#: Bytes of a batch that are worked on at a time; only a word longer than that takes more.
WINDOW = 4 << 20
#: A-Z as a-z, and which bytes make words: 0-9, a-z and all of characters beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
SCORES = T.StructType([T.StructField(c, T.LongType(), False) for c in ("n_words", "n_features", "weight")])


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; a null has no bytes."""
    column = pa.concat_arrays([column.cast(pa.large_string()).fill_null("")])
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def _words(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, CRC, length) of the words of a batch, by windows that no word crosses. A document's end ends a word."""
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    a, end, size = int(offsets[0]), int(offsets[-1]), window
    while a < end:
        b = min(a + size, end)
        low = _LOWER[data[a:b]]
        inside = _WORD[low]
        if b < end and inside[-1] and not begins[b]:
            breaks = np.flatnonzero(~inside | begins[a:b])
            if not len(breaks) or breaks[-1] == 0 and inside[0]:
                size *= 2  # one word fills the window
                continue
            b = a + int(breaks[-1])
            b += not inside[b - a]
            low, inside = low[: b - a], inside[: b - a]
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | begins[a + 1 : b]]))
        ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | begins[a + 1 : b], [True]])) + 1
        if len(starts):
            yield np.searchsorted(offsets, starts + a, "right") - 1, crc.of_slices(low, starts, ends - starts), ends - starts
        a, size = b, window


def ngram_crcs(column: pa.Array, n: int = 2, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(order, documents, CRC-32) of all runs of 1 to n words (joined by one space) of a column of texts, in portions.

    Each word's CRC is made once; those of longer runs follow from the run before, shifted, and the next word's: no run is ever
    put together as a string.
    """
    space = np.uint32(zlib.crc32(b" "))
    held = (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    for portion in _words(*_utf8(column), window):
        old = len(held[0])
        doc, word, length = (np.concatenate(x) for x in zip(held, portion, strict=True))
        yield 1, doc[old:], word[old:]
        spaced = crc.shifted(np.full(len(word), space), length) ^ word
        run = word
        for m in range(2, n + 1):
            run = crc.shifted(run[:-1], length[m - 1 :] + 1) ^ spaced[m - 1 :]
            own = np.arange(len(run)) + m - 1 >= old
            own &= doc[: len(run)] == doc[m - 1 :]
            yield m, doc[m - 1 :][own], run[own]
        keep = len(doc) - (n - 1)
        held = tuple(x[max(0, keep) :] for x in (doc, word, length))


def bucket_counts(texts: DataFrame, text: str = "text", n: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): features of all texts by their CRC modulo buckets. A task hands on one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, crcs in ngram_crcs(b.column(0), n):
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """1000 times the log of how much likelier a feature of each bucket is in target than in docs, plus-one smoothed, floored.

    Comes to the driver: one integer a bucket, whatever the tables' sizes.
    """
    sizes = [np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)]
    for held, counts in zip(sizes, (bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets)), strict=True):
        for r in counts.collect():
            held[r["bucket"]] = r["n"]
    s_all, t_all = (float(int(x.sum()) + buckets) for x in sizes)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(*(x.tolist() for x in sizes), strict=True)], np.int64)


def with_weights(docs: DataFrame, gains: np.ndarray, text: str = "text", n: int = 2, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (those of keep, where given) and n_words, n_features and weight: the floored mean of the gains of a
    document's features, 0 without any. Columns of docs called so are replaced."""
    carried = [c for c in (keep if keep is not None else docs.columns) if c not in SCORES.fieldNames()]
    (body,) = unused(docs.select(*[F.col(f"`{c}`") for c in carried]), "__text")
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(text).alias(body))
    gains, buckets = np.asarray(gains, np.int64), np.uint32(len(gains))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, features, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for order, doc, crcs in ngram_crcs(b.column(b.num_columns - 1), n):
                here = np.bincount(doc, minlength=b.num_rows)
                features += here
                words += here if order == 1 else 0
                total += np.bincount(doc, weights=gains[crcs % buckets], minlength=b.num_rows).astype(np.int64)  # whole numbers under 2**53
            new = (words, features, np.floor_divide(total, np.maximum(features, 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x) for x in new]], names=[*b.schema.names[:-1], *SCORES.fieldNames()])

    return rows.mapInArrow(weigh, T.StructType([*rows.schema.fields[:-1], *SCORES.fields]))


def ranked(rows: DataFrame, order: list, rank: str) -> DataFrame:
    """rows with their places 1, 2, 3... in the order: each task sorts one range, ranges are told how many rows lie before them."""
    part, place, ahead = unused(rows, "__part", "__place", "__ahead")
    ranges = rows.repartitionByRange(spread(rows.sparkSession), *order).sortWithinPartitions(*order)
    held = saved(ranges.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    before = held.groupBy(part).count().select(part, F.coalesce(F.sum("count").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    return held.join(F.broadcast(before), part).withColumn(rank, F.col(ahead) + F.col(place) + 1).drop(part, place, ahead)  # a row a task


def draw(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, n: int = 2, buckets: int = 10_000, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with n_words, n_features, weight, score and rank; rank is null where a document isn't drawn.

    Features are runs of 1 to n words by the CRC of their text, counted in buckets over all of docs and all of target. A document's
    score is its weight plus Gumbel noise, 1000 times, decided by seed and doc_id. Of the documents with min_words words or more
    the percent with the highest scores are drawn, ties to the smaller id: so many draws without replacement by weight.

    A null or empty text has no words, weight 0 and is never drawn (where min_words is over 0). Rows that repeat are
    documents each, their ranks by text where ids are equal too. A null id counts as an empty one for the noise and comes last among
    ties. An empty table stays empty, an empty target lends every bucket the same count. Columns called as the new ones are
    replaced, all others pass.
    """
    gains = bucket_gains(docs, target, text, target_text, n, buckets)
    columns = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "rank")]
    id_, tie = unused(docs, "__id", "__tie")
    ready = docs.withColumn(id_, F.col(doc_id)).withColumn(tie, F.xxhash64(text))
    scored = with_weights(ready, gains, text, n, [*columns, id_, tie])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = saved(scored.withColumn("score", F.col("weight") + noise), "resampling-scores")
    enough = F.col("n_words") >= min_words
    drawn = scored.where(enough).count() * percent // 100
    placed = ranked(scored.where(enough), [F.col("score").desc(), F.col(id_).asc_nulls_last(), F.col(tie)], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).drop(id_, tie)


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with their columns and weight, score and rank."""
    return draw(docs, target, **options).where(F.col("rank").isNotNull())
