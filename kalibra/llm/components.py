"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


#: One in so many of all ends of edges makes a node a hub.
HUBS = 1000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Large star, then small star, by turns: each node's larger neighbours, then its smaller ones, are hung
    on the least of all, which at most halves paths a round. Minima are joined back as rows, so no node's
    neighbours are ever gathered, and those of hubs (nodes with more than one in HUBS of the edges' ends, so HUBS
    at most) by a broadcast, so a hub's edges stay where they are. Minima and edges are written out in turn, which
    ends lineage and keeps each plan at one aggregation or the joins of one star: the plan of a whole round holds its
    tables several times over, and the driver pays for that. When no node has both a smaller neighbour and another one, all are stars.
    """

    def minima(rows: DataFrame) -> DataFrame:
        """(a, low, n): least and number of each node's neighbours in rows (a, b)."""
        return saved(rows.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")), "minima")

    def with_least(own: DataFrame, least: DataFrame) -> DataFrame:
        """own (a, b) with m, the lesser of a and its low in least."""
        few, most, ends = least.agg(F.min("n"), F.max("n"), F.sum("n")).first()
        cut, out = ends // HUBS, []
        hubs, rest = (least.where(x).select("a", F.least("a", "low").alias("m")) for x in (F.col("n") > cut, F.col("n") <= cut))
        if most > cut:
            out.append(own.join(F.broadcast(hubs), "a"))
        if few <= cut:
            out.append((own.join(F.broadcast(hubs.select("a")), "a", "left_anti") if most > cut else own).join(rest, "a"))
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    stars = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        # every edge points from a larger to a smaller node, here and after each star
        back = stars.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = minima(stars.union(back))
        if not least.where("n > 1 and low < a").head(1):
            return least.select(F.col("a").alias("node"), F.least("a", "low").alias("component"))
        large = saved(with_least(back, least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        small = with_least(large, minima(large)).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        stars = saved(small.select("e.*").where("a <> b").distinct(), "stars")
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
