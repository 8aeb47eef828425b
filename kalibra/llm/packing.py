"""Sequences of bounded length from documents by shortest-pack-first over the length histogram (operator 5)."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import spread, unused


def cut(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens) of every whole text's ids and the end id after them.

    A document longer than limit is cut into pieces of limit ids and one of the rest; others stay whole.
    ids: little-endian unsigned 32-bit integers. A null or empty text is the end id alone.
    """
    tail = struct.pack("<I", end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = tokens.encoder(tokenizer_path)
        for b in batches:
            names, starts, ids, totals = [], [], [], []
            for name, x in zip(b.column(0).to_pylist(), tokens.utf8(b.column(1)), strict=True):
                got = e.encode(x) + tail
                for at in range(0, len(got), 4 * limit):
                    names.append(name)
                    starts.append(at // 4)
                    ids.append(got[at : at + 4 * limit])
                    totals.append(len(got) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long")


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (count, lengths) for length counts: the longest lengths first, each into the packs that are
    shortest so far, a whole group of equal packs at once; new packs are opened where the shortest has no room.

    The work depends on the number of different lengths, not on the number of documents.
    """
    rooms: list[int] = []  # a heap of -room
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(room: int, count: int, pattern: tuple[int, ...]) -> None:
        if room not in packs:
            packs[room] = []
            heapq.heappush(rooms, -room)
        packs[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= limit:
            raise ValueError(f"length {length} is not between 1 and {limit}")
        left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room < length:
                put(limit - length, left, (length,))
                break
            count, pattern = packs[room].pop()
            if not packs[room]:
                del packs[room]
                heapq.heappop(rooms)
            take = min(count, left)
            if count > take:
                put(room, count - take, pattern)
            put(room - length, take, (*pattern, length))
            left -= take
    return [x for room in sorted(packs) for x in packs[room]]


def pack(pieces: DataFrame, limit: int = 2048, key: tuple[str, ...] = ("doc_id", "start"), length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to pieces; every other column is kept (columns of these two names are replaced).

    pieces is read three times (counts, ranks, result), so write it out first if it is dear. Only the
    histogram, at most limit rows, comes to the driver, and the intervals of the patterns go back. A
    piece's rank among those of its length is its place in its slice of the length, after the slices
    before: slices are dealt by a hash of the key, so a length that a third of all pieces have is spread
    over as many tasks as there are. Pieces with equal keys and lengths are interchangeable. Lengths must
    be 1 to limit; no pieces give no rows.
    """
    spark, salts = pieces.sparkSession, spread(pieces.sparkSession)
    rows = pieces.drop("sequence_id", "offset")
    slice_, own_, ahead_, place_, length_ = unused(rows, "__slice", "__own", "__ahead", "__place", "__length")
    rows = rows.withColumn(slice_, F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    counts = rows.groupBy(F.col(length).alias(length_), slice_).count()
    histogram = {r[length_]: r["n"] for r in counts.groupBy(length_).agg(F.sum("count").alias("n")).collect()}
    used, first, intervals = dict.fromkeys(histogram, 0), 0, []
    for count, pattern in plan(histogram, limit):
        offset = 0
        for n in pattern:
            intervals.append((n << 44 | used[n], first, offset))
            used[n] += count
            offset += n
        first += count
    table = np.array(sorted(intervals), np.int64).reshape(-1, 3)

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = n.to_numpy(np.int64) << 44 | rank.to_numpy(np.int64)
        own = table[np.searchsorted(table[:, 0], at, side="right") - 1]
        return pd.DataFrame({"sequence_id": own[:, 1] + at - own[:, 0], "offset": own[:, 2]})

    ahead = counts.select(length_, F.col(slice_).alias(f"{slice_}2"), F.coalesce(F.sum("count").over(W.partitionBy(length_).orderBy(slice_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(ahead_))
    rank = F.row_number().over(W.partitionBy(length, slice_).orderBy(*key)) - 1
    ranked = rows.withColumn(own_, rank).join(ahead, (F.col(length) == F.col(length_)) & (F.col(f"{slice_}2") == F.col(slice_))).withColumn(place_, place(F.col(length), F.col(own_) + F.col(ahead_)))
    return ranked.select("*", f"{place_}.*").drop(slice_, f"{slice_}2", length_, own_, ahead_, place_)
