"""Training documents that hold benchmark items, exact or edited (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles, tokens
from .common import unused
from .shingles import bare_words

#: Scores of the alignment: a word that agrees, one that differs, one left out or put in.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Words of benchmark items held at once, by the driver and by each task; a larger benchmark is taken in blocks.
BLOCK_WORDS = 2_000_000


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman: the best local score, and the end (exclusive) of its stretch of the passage.

    A row of the table at a time: a run of gaps along the row is a running maximum of scores rid of their gap cost.
    """
    n = len(passage)
    ramp = -GAP * np.arange(1, n + 1)
    above, best, end = np.zeros(n + 1), 0.0, 0
    for word in item:
        row = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum.accumulate(np.maximum(row, 0) + ramp) - ramp
        above = np.concatenate([[0.0], row])
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top + 1
    return best, end


class Index:
    """n-grams of items and where they stand."""

    def __init__(self, items: list[tuple[int, np.ndarray]], n: int):
        self.items, self.n = items, n
        grams = [shingles.in_order(w, n) for _, w in items]
        self.gram = np.concatenate([*grams, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        self.place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, int)])
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.gram >> np.uint64(44)).astype(np.int64)] = True

    def found(self, words: np.ndarray) -> np.ndarray:
        """Places of words at which a gram of the index begins."""
        if len(words) < self.n or not len(self.gram):
            return np.zeros(0, int)
        g = shingles.in_order(words, self.n)
        at = np.flatnonzero(self.sieve[(g >> np.uint64(44)).astype(np.int64)])
        return at[self.gram[np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)] == g[at]]


def most(item: np.ndarray, passage: np.ndarray) -> float:
    """No alignment of item and passage scores more: each word of the passage that the item has counts as a match, the others
    as MISMATCH or GAP, in the best stretch; and no word matches more often than the item has it."""
    own, times = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(own, passage), len(own) - 1)
    same = own[at] == passage
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, MATCH, max(MISMATCH, GAP)))])
    return min(float((sums - np.minimum.accumulate(sums)).max()), MATCH * float(np.minimum(np.bincount(at[same], minlength=len(own)), times).sum()))


def _matches(index: Index, words: np.ndarray, min_score: float, min_words: int, enough: float = np.inf) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, start, end) of each item in a document: its best stretch, in words."""
    at = index.found(words)
    if not len(at):
        return
    g = shingles.in_order(words, index.n)[at]
    low, high = np.searchsorted(index.gram, g), np.searchsorted(index.gram, g, side="right")
    size = high - low
    entry = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    item, begin = index.item[entry], np.repeat(at, size) - index.place[entry]
    order = np.lexsort((begin, item))
    item, begin = item[order], begin[order]
    cuts = np.flatnonzero(np.diff(item)) + 1
    for k, starts in zip(item[np.concatenate([[0], cuts])], np.split(begin, cuts), strict=True):
        own = index.items[k][1]
        m = len(own)
        slack = m // 2 + 4
        need = max(min(min_score * m, enough), min(min_words, m))
        best, at, n = (0.0, 0, 0), 0, len(starts)
        while at < n:  # windows of the item's length and slack around its seeds, joined where they overlap
            end = at + 1
            while end < n and starts[end] - starts[end - 1] <= m + 2 * slack:
                end += 1
            left, right = max(0, int(starts[at]) - slack), min(len(words), int(starts[end - 1]) + m + slack)
            score, stop = align(own, words[left:right]) if most(own, words[left:right]) >= need else (0.0, 0)
            if score > best[0]:
                best = (score, left, left + stop)
            at = end
        score, left, stop = best
        if score >= need:
            back, length = align(own[::-1], words[left:stop][::-1])
            yield int(k), score / m, stop - length, stop


def contaminated(docs: DataFrame, items: DataFrame, n: int = 3, min_score: float = 0.4, min_words: int = 6, enough: float = 13, short_items: bool = False, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start, end) for each document and item that align; start, end: the words concerned.

    All word n-grams of the items are seeds: a choice by how rare they are in the corpus leaves out the very
    grams that many copies with the same edits share. Each document's grams are joined to the seeds, and an
    item is aligned with the passages around its seeds by Smith-Waterman on whole words, where the words in
    common allow the score at all (most). score is the alignment's score as a share of the item's words; it
    must reach min_score, or as much as enough words that agree (a passage of a long item), and min_words
    words or the whole item.

    The join is done where documents are read: a block of items is small and broadcast (BLOCK_WORDS words;
    an item longer than that is a block of its own), and documents are never shuffled. Items of fewer than n
    words have no grams; with short_items their words in a row are their only gram, otherwise they are never
    found. Null texts hold nothing and are found in nothing; repeated documents and items are reported each time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = F.octet_length(item_text).cast("long") / 2 + 1
    listed = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"), size.alias("size"))
    blocks = max(1, -(-int(listed.agg(F.sum("size")).first()[0] or 0) // BLOCK_WORDS))
    out = None
    for block in range(blocks):
        held = listed.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        split = [(r["item"], w) for r, w in zip(held, bare_words([r["text"].encode() for r in held]), strict=True)]
        indexes = [Index([x for x in split if len(x[1]) >= n], n)]
        if short_items:
            indexes += [Index([x for x in split if len(x[1]) == width], width) for width in range(1, n)]
        found = _scan(spark, rows, indexes, min_score, min_words, enough)
        out = found if out is None else out.union(found)
    return out


def _scan(spark, rows: DataFrame, indexes: list[Index], min_score: float, min_words: int, enough: float) -> DataFrame:
    chosen = spark.sparkContext.broadcast([i for i in indexes if i.items])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple] = []
            for name, words in zip(b.column(0).to_pylist(), bare_words(list(tokens.utf8(b.column(1)))), strict=True):
                got += [(name, own.items[k][0], score, start, end) for own in chosen.value for k, score, start, end in _matches(own, words, min_score, min_words, enough)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], kind) for i, kind in enumerate(kinds)], names=["doc_id", "item_id", "score", "start", "end"])

    return rows.mapInArrow(search, "doc_id long, item_id long, score double, start long, end long")


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The documents that hold no item, with the columns of docs. Rows without an id are judged by a hash of their text."""
    key, gone_ = unused(docs, "__key", "__gone")
    own = docs.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text)))
    gone = contaminated(own, items, doc_id=key, text=text, **parameters).select(F.col("doc_id").alias(gone_)).distinct()
    return own.join(gone.hint("shuffle_hash"), F.col(key) == F.col(gone_), "left_anti").drop(key)
