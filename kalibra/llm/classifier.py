"""Quality and toxicity of documents by hierarchical empirical Bayes (operator 7).

A document's own evidence is a classifier's log-odds beyond the overall rate. What its site says comes from
grouped counts of labels: a host's rate is shrunk toward the overall rate, a path's toward its host's, each by
as much as counts that small deserve; how much is estimated from how far groups differ beyond chance. The
document's posterior adds its evidence to the log-odds of its path's rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles, tokens
from .common import first_by_hash, saved

#: Rows of the word table; bins of each shape feature.
TABLE, BINS = 1 << 18, 12
#: Words count, and so do their first bytes in these numbers: stems.
STEMS = (5, 6, 7, 8)
#: The shares of bytes that make up a text's shape.
_SHAPES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>@^~=+\\/_{}[]", b".,;:!?'\"()-", b"\n")
_SHAPE_OF = np.full(256, len(_SHAPES), np.uint8)
for _i, _s in enumerate(_SHAPES):
    _SHAPE_OF[list(_s)] = _i


def slots_and_shape(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: the table rows of its distinct words and stems, and the bins of its shape."""
    for text, words in zip(texts, shingles.bare_words(texts, STEMS), strict=True):
        data, words, stems = np.frombuffer(text or b"", np.uint8), words[0], words
        distinct = np.unique(words)
        share = sum((np.bincount(_SHAPE_OF[data[i : i + (1 << 20)]], minlength=len(_SHAPES) + 1) for i in range(0, len(data), 1 << 20)), np.zeros(len(_SHAPES) + 1, np.int64))[: len(_SHAPES)] / max(1, len(data))
        variety, length = len(distinct) / max(1, len(words)), np.log2(1 + len(words)) / 20
        shape = np.concatenate([np.sqrt(share), [variety, length]])
        yield np.unique((stems >> np.uint64(46)).astype(np.int64)), np.minimum(BINS - 1, (shape * BINS).astype(np.int64))


class Evidence:
    """A logistic classifier of a label by chosen words and shape."""

    def __init__(self, weights: np.ndarray, shape: np.ndarray, bias: float):
        self.weights, self.shape, self.bias = weights, shape, bias

    def of(self, words: np.ndarray, bins: np.ndarray) -> float:
        return float(self.bias + self.weights[words].sum() + self.shape[np.arange(len(bins)), bins].sum())


def fit_evidence(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, min_docs: int = 8, z: float = 4.0, rounds: int = 300) -> Evidence:
    """Words that stand in min_docs documents and whose odds differ by z standard errors are kept; a ridge logistic fit weighs them.

    The result is centred: its mean over the rows is the log-odds beyond their overall rate.
    """
    rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    blank = Evidence(np.zeros(TABLE, np.float32), np.zeros((len(_SHAPES) + 2, BINS)), 0.0)
    if not len(y) or y.min() == y.max():
        return blank
    doc = np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows])
    word = np.concatenate([w for w, _ in rows])
    n1, n0 = np.bincount(word, y[doc], TABLE), np.bincount(word, 1 - y[doc], TABLE)
    a, b, c, d = n1 + 0.5, n0 + 0.5, y.sum() - n1 + 0.5, (1 - y).sum() - n0 + 0.5
    odds = np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    chosen = np.flatnonzero((n1 + n0 >= min_docs) & (np.abs(odds) >= z))
    place = np.full(TABLE, -1)
    place[chosen] = np.arange(len(chosen))
    held = place[word] >= 0
    doc, col = doc[held], place[word[held]]
    bins = np.stack([s for _, s in rows]) + np.arange(len(_SHAPES) + 2) * BINS
    doc = np.concatenate([doc, np.repeat(np.arange(len(rows)), bins.shape[1])])
    col = np.concatenate([col, len(chosen) + bins.ravel()])
    w, bias, total = np.zeros(len(chosen) + (len(_SHAPES) + 2) * BINS), np.log(rate / (1 - rate)), np.full(len(chosen) + (len(_SHAPES) + 2) * BINS, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, w[col], len(rows)), -30, 30)))
        grad = np.bincount(col, (y - p)[doc], len(w)) - 0.3 * w
        total += grad * grad
        w += 0.5 * grad / np.sqrt(total)
        bias += 0.5 * (y - p).mean() / max(1e-3, (p * (1 - p)).mean())
    blank.weights[chosen] = w[: len(chosen)]
    blank.shape = w[len(chosen) :].reshape(-1, BINS)
    blank.bias = float(bias - np.log(rate / (1 - rate)))
    return blank


def shrunk_rates(counts: DataFrame, host: str = "host", path: str = "path", n: str = "n", k: str = "k") -> tuple[DataFrame, float]:
    """((host, path, host_rate, path_rate), overall rate) from label counts of (host, path): beta posteriors' means.

    The weight of the prior (in labels) comes by moments: the spread of groups' rates about the overall rate,
    less what chance alone makes, over all groups; it lies between 1 and 10,000.
    """
    hosts = counts.groupBy(host).agg(F.sum(n).alias("n"), F.sum(k).alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    if not total["n"]:
        return counts.select(host, path, F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate")), 0.5
    rate = float(np.clip(total["k"] / total["n"], 1e-4, 1 - 1e-4))

    def weight(groups: DataFrame, mean: Column) -> float:
        s = groups.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2)).alias("s"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("n")).first()
        between = max((s["s"] - rate * (1 - rate) * s["g"]) / s["n"], 1e-9)
        return float(np.clip(rate * (1 - rate) / between - 1, 1, 10_000))

    by_host = weight(hosts, F.lit(rate))
    hosts = hosts.select(host, ((F.col("k") + by_host * rate) / (F.col("n") + by_host)).alias("host_rate"))
    paths = counts.select(host, path, F.col(n).alias("n"), F.col(k).alias("k")).join(hosts, host)
    by_path = weight(paths, F.col("host_rate"))
    return paths.select(host, path, "host_rate", ((F.col("k") + by_path * F.col("host_rate")) / (F.col("n") + by_path)).alias("path_rate")), rate


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of lists as arrays, without a Python object for each number."""
    return [x for c in column.chunks for x in np.split(c.flatten().to_numpy(zero_copy_only=False), (c.offsets.to_numpy() - c.offsets[0].as_py())[1:-1])]


def classify(docs: DataFrame, labels: DataFrame, heads: tuple[str, ...] = ("quality", "toxic"), host: str = "host", path: str = "path", sample_rows: int = 8000, sample_chars: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, then of each head {head}_evidence, {head}_host, {head}_path and {head}, its posterior) for each row of docs.

    labels has doc_id and a 0/1 column for each head. The classifier is fitted on sample_rows labelled
    documents (the first by a hash of id, text and labels, repeated rows once, whole texts of up to
    sample_chars characters); rates are counted over all labels; every document is scored, whole.

    Null labels don't count; a document labelled twice counts twice in rates. Null hosts and paths are a
    site of their own; a site without labels has the rate above it. A null text is scored as an empty one.
    Repeated rows come out as often as they are.
    """
    spark = docs.sparkSession
    site = [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path")]
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *site, F.col(text).alias("text"))
    marks = labels.select(F.col(doc_id).cast("long").alias("doc_id"), *[F.col(h).cast("double").alias(f"y_{h}") for h in heads])
    marked = named.join(marks, "doc_id")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(slots_and_shape(list(tokens.utf8(b.column(0)))))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.list_(pa.int64())), pa.array([s for _, s in got], pa.list_(pa.int64())), *b.columns[1:]], names=["words", "shape", *[f"y_{h}" for h in heads]])

    hashed = named.where(F.length("text") <= sample_chars).select("doc_id", "text", F.xxhash64("text").alias("__text"))
    ordered = hashed.drop("text").join(marks, "doc_id").withColumn("__order", F.xxhash64("doc_id", "__text", *[f"y_{h}" for h in heads]))
    chosen = first_by_hash(ordered, "__order", sample_rows)  # texts are fetched for these alone, and never shuffled before
    wanted = hashed.join(F.broadcast(chosen), ["doc_id", "__text"]).dropDuplicates(["__order"]).select("text", *[f"y_{h}" for h in heads])
    learned = wanted.mapInArrow(reduced, "words array<long>, shape array<long>, " + ", ".join(f"y_{h} double" for h in heads)).toArrow()
    words, shapes = (_lists(learned.column(c)) for c in ("words", "shape"))
    fitted = []
    for h in heads:
        y = np.array([np.nan if v is None else v for v in learned.column(f"y_{h}").to_pylist()], float)
        at = np.flatnonzero(~np.isnan(y))
        fitted.append(fit_evidence([(words[i], shapes[i]) for i in at], y[at]))
    models = spark.sparkContext.broadcast(fitted)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[m.of(w, s) for m in models.value] for w, s in slots_and_shape(list(tokens.utf8(b.column(3))))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array([g[i] for g in got], pa.float64()) for i in range(len(heads))]], names=["doc_id", "host", "path", *[f"{h}_evidence" for h in heads]])

    out = named.select("doc_id", "host", "path", "text").mapInArrow(scored, "doc_id long, host string, path string, " + ", ".join(f"{h}_evidence double" for h in heads))
    sums = [f(F.col(f"y_{h}")).alias(f"{a}_{h}") for h in heads for f, a in ((F.count, "n"), (F.sum, "k"))]
    counts = saved(marked.groupBy("host", "path").agg(*sums), "site-labels")
    for h in heads:
        rates, overall = shrunk_rates(counts.select("host", "path", F.col(f"n_{h}").alias("n"), F.coalesce(F.col(f"k_{h}"), F.lit(0.0)).alias("k")))
        by_host = rates.groupBy("host").agg(F.first("host_rate").alias(f"{h}_host"))
        out = out.join(rates.select("host", "path", F.col("path_rate").alias(f"{h}_path")), ["host", "path"], "left").join(by_host, "host", "left")
        out = out.withColumn(f"{h}_host", F.coalesce(f"{h}_host", F.lit(overall))).withColumn(f"{h}_path", F.coalesce(f"{h}_path", f"{h}_host"))
        out = out.withColumn(h, 1 / (1 + F.exp(-(F.log(F.col(f"{h}_path") / (1 - F.col(f"{h}_path"))) + F.col(f"{h}_evidence")))))
    return out.select("doc_id", *[f"{h}{x}" for h in heads for x in ("_evidence", "_host", "_path", "")])
