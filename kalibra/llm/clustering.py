"""Centroid clustering of integer vectors, exact under float32 arithmetic (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: Unit roundoff of float32.
ROUNDOFF = 2.0**-24
#: Vectors of a batch that are compared with all centroids at a time.
ROWS = 8192


def limit(dims: int) -> int:
    """Components are held within so much (2**27 for 64 dimensions), so that squared distances fit in 63 bits."""
    return 1 << ((62 - (dims - 1).bit_length()) // 2 - 1)


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x (as double) of the vectors with dims components, none of them null or not
    finite. Components beyond limit(dims) are cut to it."""
    x, most = F.col(vector), float(limit(dims))
    fit = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = lambda c: F.floor(F.greatest(F.least(F.lit(float(scale)) * c.cast("double"), F.lit(most)), F.lit(-most))).cast("int")
    return vectors.where(x.isNotNull() & fit).select(F.col(vec_id).alias("vec_id"), F.transform(x, whole).alias("v"))


def exact_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of v from those of c, as 64-bit integers."""
    return np.square(v - c).sum(axis=1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row, exactly; ties go to the smaller number.

    A float32 product of v and the centroids gives |c|^2 - 2 v.c (what a distance is beyond |v|^2) to within a bound that holds
    for any order of summation: (m + 2) roundings on m products, each of at most |v||c| together by Cauchy and Schwarz. Only
    centroids whose interval meets the least upper end can be the nearest. Where several are left, they are computed anew in integers.
    """
    m, squares = v.shape[1], np.square(centroids).sum(axis=1)
    products = (v.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    rounding = (m + 2) * ROUNDOFF / (1 - (m + 2) * ROUNDOFF)
    sizes = np.sqrt(np.square(v.astype(np.float64)).sum(axis=1))[:, None] * np.sqrt(squares.astype(np.float64))[None, :]
    middle = squares.astype(np.float64) - 2 * products
    reach = 2 * rounding * sizes * (1 + 1e-9) + np.abs(middle) * 1e-15 + squares * 1e-15  # and the roundings of float64
    open_ = middle - reach <= (middle + reach).min(axis=1)[:, None]
    best = open_.argmax(axis=1)
    several = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(several):
        row, number = np.nonzero(open_[several])
        d = exact_distances(v[several[row]], centroids[number])
        order = np.lexsort((number, d, row))
        first = np.unique(row[order], return_index=True)[1]
        best[several] = number[order][first]
    return best, exact_distances(v, centroids[best])


def _portions(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part, part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def first_centroids(whole: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors with the least sha256 of `seed:vec_id`, fewer where there are no more; rows without an id come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def sums(whole: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, sums of components). A task hands on a row a cluster, the driver gets a row a cluster."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v in _portions(batches, dims):
            at = nearest(v, centroids)[0]
            n += np.bincount(at, minlength=k)
            for c in np.unique(at):
                total[c] += v[at == c].sum(axis=0)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full]), pa.array(list(total[full]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = whole.select("v").mapInArrow(add, "cluster int, n long, total array<long>")
    out = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)])
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(dims)]) for r in out.collect()}


def fit(whole: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """The centroids (k x dims integers) after so many rounds; whole: rows of usable(). A centroid is the exact floor of its vectors'
    mean; one that no vector is nearest to stays. No vectors, no centroids."""
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, total) in sums(whole, centroids).items():
            centroids[c] = [x // n for x in total]
    return centroids


def assign(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The columns of whole but v, and cluster and distance (squared) of the nearest centroid."""
    schema = T.StructType([*[f for f in whole.schema.fields if f.name != "v"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centroids):
        return whole.select(*[c for c in whole.columns if c != "v"], F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).limit(0)
    dims = centroids.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _portions(batches, dims):
            at, distance = nearest(v, centroids)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(at, pa.int32()), pa.array(distance)], names=schema.names)

    return whole.select(*[c for c in whole.columns if c != "v"], "v").mapInArrow(place, schema)


def centroid_digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector; see usable() and fit().

    Vectors that are null, of another length, or hold a null, a NaN or an infinite component are left out; ids may be null or repeat, and each row
    counts. Equal vectors and ties go to the smaller cluster; an empty table gives no rows. Other columns are not read. Sums of
    distances beyond 63 bits are given as the largest 64-bit integer.
    """
    whole = saved(usable(vectors, vec_id, vector, dims, scale), "vectors")  # read once a round, a fraction of the floats' size
    spark, centroids = vectors.sparkSession, fit(whole, k, rounds, seed)
    placed = saved(assign(whole, centroids), "clusters")
    capped = lambda c: F.least(c, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    by = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()  # a row a cluster
    total = sum(int(r["sum"]) for r in by)
    known = [(r["cluster"], r["sum"], centroid_digest(centroids[r["cluster"]])) for r in by]
    facts = spark.createDataFrame(known, "cluster int, sum decimal(38,0), centroid_sha256 string").select("cluster", capped(F.col("sum")).alias("cluster_inertia"), "centroid_sha256")
    out = placed.join(F.broadcast(facts), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(min(total, 2**63 - 1)).cast("long").alias("inertia"), "centroid_sha256")
