"""Token ids in directly addressable files (operator 8).

A segment holds the ids of some documents, one after the other, as directly addressable codes: an id's
low byte stands in level 0, each further byte in the next level, and a bit beside every byte says
whether the id goes on. The place of an id's next byte is the number of such bits before it, which a
rank directory gives without reading what precedes: any id is reached in as many steps as it has bytes.

Segments are the rows of a Parquet table (Spark's commit protocol makes the writing of files safe
against lost executors), uncompressed, in ascending order of documents.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import spread

#: Fixed values of the format: its name, bits of a block of the rank directory.
MAGIC, BLOCK = b"DAC1", 512
#: Up to so many segments their starts are broadcast.
BROADCAST_SEGMENTS = 200_000
_POPS = np.array([bin(i).count("1") for i in range(256)], np.uint8)

SEGMENTS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
])


def encode_codes(ids: np.ndarray) -> bytes:
    """ids (unsigned 32 bit) as levels. Of each level: bytes, continuation bits, ones before each block of bits."""
    levels, rest = [], np.ascontiguousarray(ids, np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = _POPS[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])[: max(1, len(ones))]
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<QQQ", n, len(b), len(r)) for n, _, b, r in levels)
    return head + b"".join(x + b + r for _, x, b, r in levels)


class Codes:
    """A segment's payload, read in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (n,) = struct.unpack_from("<I", payload, 4)
        at, self.levels = 8 + 24 * n, []
        for k in range(n):
            size, bits, ranks = struct.unpack_from("<QQQ", payload, 8 + 24 * k)
            self.levels.append((np.frombuffer(payload, np.uint8, size, at), np.frombuffer(payload, np.uint8, bits, at + size), np.frombuffer(payload, "<u8", ranks // 8, at + size + bits)))
            at += size + bits + ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Continuation bits before place i: the directory's count and those of one block at most."""
        _, bits, ranks = self.levels[level]
        if not i or not len(bits):
            return 0
        block = min(i // BLOCK, len(ranks) - 1)
        start, whole = block * BLOCK // 8, i // 8
        ones = int(ranks[block]) + int(_POPS[bits[start:whole]].sum())
        return ones + (int(_POPS[bits[whole] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        got = 0
        for k, (values, bits, _) in enumerate(self.levels):
            got |= int(values[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return got

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids in [start, end), without what stands before or behind them."""
        out = np.zeros(max(0, end - start), np.uint32)
        to = np.arange(len(out))
        for k, (values, bits, _) in enumerate(self.levels):
            if end <= start:
                break
            out[to] |= values[start:end].astype(np.uint32) << np.uint32(8 * k)
            first = start >> 3
            more = np.unpackbits(bits[first : (end + 7) >> 3], bitorder="little")[start - 8 * first : end - 8 * first].astype(bool)
            to = to[more]
            start = self._rank(k, start)
            end = start + len(to)
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, segment_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text and writes segments to path in ascending order of doc_id.

    Documents are dealt out by ranges of ids; each task encodes its range and closes a segment after
    the document that reaches segment_tokens (a document is never split). end_id follows each document.
    A null text counts as empty; a null id comes first; rows with the same id stand side by side, by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("tie"))
    ranges = rows.repartitionByRange(spread(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, part, segment = tokens.encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            payload = encode_codes(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_pylist([{"part": part, "segment": segment, "n_tokens": size // 4, "doc_ids": names, "lengths": [len(x) // 4 for x in held], "payload": payload}], schema=schema)

        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), tokens.utf8(b.column(1)), strict=True):
                names.append(name)
                held.append(e.encode(x) + tail)
                size += len(held[-1])
                if size >= 4 * segment_tokens:
                    yield close()
                    names, held, size, segment = [], [], 0, segment + 1
        if names:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
    ranges.select("doc_id", "text").mapInArrow(encode, SEGMENTS).write.option("compression", "none").parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, base): ids of the table before each segment. Sums by part first, so one task sees one row a part."""
    from pyspark.sql import Window as W

    at = spark.read.schema(SEGMENTS).parquet(path).select("part", "segment", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = at.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(W.orderBy("part")).alias("ahead"))
    own = at.select("part", "segment", before(W.partitionBy("part").orderBy("segment")).alias("within"))
    return own.join(parts, "part").select("part", "segment", (F.col("ahead") + F.col("within")).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files: ids as little-endian unsigned 32-bit integers."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                codes, ends = Codes(row["payload"]), np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                n = len(ends)
                ids = [codes.slice(int(s), int(t)).astype("<u4").tobytes() for s, t in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(ids, pa.binary())], names=["part", "segment", "doc_id", "within", "n_tokens", "ids"])

    rows = spark.read.schema(SEGMENTS).parquet(path).select("part", "segment", "doc_ids", "lengths", "payload")
    out = rows.mapInArrow(decode, "part int, segment int, doc_id long, within long, n_tokens long, ids binary")
    starts = segment_starts(spark, path)
    few = spark.read.parquet(path).count() <= BROADCAST_SEGMENTS  # 20 bytes each; beyond it the ids are shuffled to their starts
    return out.join(F.broadcast(starts) if few else starts, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")
