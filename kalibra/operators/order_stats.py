"""Order statistics by policy without a sort: histograms whose bins are refined until each holds one value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: bins of a refinement
BINS = 4096
#: a sixteenth of a factor e a bin at first; beyond any double's logarithm
_PER_E, _FAR = 16, 20_000

_ASK = "policy string, k long"
_STATE = "policy string, k long, rank long, lo double, hi double"


def _first_bin(x: Column) -> Column:
    """A whole number that never falls as x rises: by the logarithm, so that values of any size part at once."""
    size = F.least(F.ln(F.abs(x)) * _PER_E, F.lit(_FAR - 1.0))  # infinity too
    return F.when(x > 0, F.floor(size) + _FAR).when(x < 0, -(F.floor(size) + _FAR)).otherwise(F.lit(0).cast("long"))


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """One of BINS even bins from lo to hi; halves are taken, so that no width overflows."""
    width = hi / 2 - lo / 2
    return F.when(width > 0, F.least(F.lit(BINS - 1).cast("long"), F.floor((x / 2 - lo / 2) / width * BINS))).otherwise((x > lo).cast("long"))


def _found(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Of each (policy, k) the bin from above that holds the rank, the rank inside it, and its least and largest value. A window here
    sees the bins of one policy, BINS or about 46,000 at most, however many rows there are."""
    above = F.coalesce(F.sum("c").over(W.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return bins.withColumn("above", above)


def kth_largest(rows: DataFrame, asked: DataFrame, value: str = "w") -> DataFrame:
    """(policy, k, edge, over, sum_over, ln_over): for each asked (policy, k) the k-th largest value of the policy (ties count each), the
    number of larger ones, their sum and the sum of their logarithms (null where one isn't positive). Nulls and NaN are no values; where a
    policy has fewer than k values, or k < 1, there is no row.

    A first pass counts values by logarithm, the next ones split the bin that holds the rank into BINS parts. Bins keep their own least
    and largest value, so after two to five passes both are the same; rows that are out of reach leave each pass at the scan. asked has a
    few rows a policy and comes to the driver, as do their bins: one a row. rows are read once a pass: have them written.
    """
    spark, x = rows.sparkSession, F.col(value)
    own = rows.select(F.col("policy").cast("string").alias("policy"), x.cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    wanted = {(r.policy, r.k) for r in asked.select("policy", F.col("k").cast("long").alias("k")).distinct().collect() if r.k is not None and r.k > 0}
    edges, open_ = {}, _start(spark, own, wanted)
    while open_:
        edges.update({s[:2]: s[3] for s in open_ if s[3] == s[4]})
        open_ = _refined(spark, own, [s for s in open_ if s[3] != s[4]])
    at = spark.createDataFrame([(p, k, e) for (p, k), e in edges.items()], "policy string, k long, edge double")
    more = F.col("x") > F.col("edge")
    return own.join(F.broadcast(at), "policy").groupBy("policy", "k", "edge").agg(  # a row an asked rank
        F.count_if(more).alias("over"), F.coalesce(F.sum(F.when(more, F.col("x"))), F.lit(0.0)).alias("sum_over"), F.coalesce(F.sum(F.when(more & (F.col("x") > 0), F.ln("x"))), F.lit(0.0)).alias("__ln"),
        F.count_if(more & (F.col("x") <= 0)).alias("__low"),
    ).withColumn("ln_over", F.when(F.col("__low") == 0, F.col("__ln"))).drop("__ln", "__low")


def _start(spark: SparkSession, own: DataFrame, wanted: set) -> list[tuple]:
    bins = own.groupBy("policy", _first_bin(F.col("x")).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    ask = spark.createDataFrame(sorted(wanted, key=str), _ASK)
    held = _found(bins, ["policy"]).join(F.broadcast(ask), "policy")
    return _taken(held, F.col("k"))


def _refined(spark: SparkSession, own: DataFrame, states: list[tuple]) -> list[tuple]:
    if not states:
        return []
    state = F.broadcast(spark.createDataFrame(states, _STATE))
    near = own.join(state, "policy").where(F.col("x").between(F.col("lo"), F.col("hi")))
    bins = near.groupBy("policy", "k", "rank", _bin(F.col("x"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return _taken(_found(bins, ["policy", "k"]), F.col("rank"))


def _taken(held: DataFrame, rank: Column) -> list[tuple]:
    inside = held.where((F.col("above") < rank) & (rank <= F.col("above") + F.col("c")))
    return [tuple(r) for r in inside.select("policy", "k", (rank - F.col("above")).alias("rank"), "lo", "hi").collect()]


def quantiles(rows: DataFrame, probabilities: Sequence[float], value: str = "w") -> DataFrame:
    """(policy, p, q): quantiles between two neighbours in the order, in proportion. Policies without a value have no row."""
    n = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy("policy").agg(F.count(F.lit(1)).alias("n"))
    place = n.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))).withColumn("at", F.col("p") * (F.col("n") - 1))
    # the (i + 1)-th smallest of n values is the (n - i)-th largest
    place = place.select("policy", "p", F.col("at") - F.floor("at"), (F.col("n") - F.floor("at")).alias("down"), (F.col("n") - F.ceil("at")).alias("up")).toDF("policy", "p", "part", "down", "up")
    edge = kth_largest(rows, place.select("policy", F.explode(F.array("down", "up")).alias("k")), value).select("policy", "k", "edge")
    of = lambda name: edge.select("policy", F.col("k").alias(name), F.col("edge").alias(f"{name}_edge"))
    both = place.join(F.broadcast(of("down")), ["policy", "down"]).join(F.broadcast(of("up")), ["policy", "up"])
    return both.select("policy", "p", (F.col("down_edge") * (1 - F.col("part")) + F.col("up_edge") * F.col("part")).alias("q"))


def top_sums(rows: DataFrame, asked: DataFrame, value: str = "w") -> DataFrame:
    """(policy, k, edge, sum, ln_sum): the k-th largest value, the sum of the k largest and of their logarithms. Which of tied rows are
    among them makes no difference."""
    left = F.col("k") - F.col("over")
    return kth_largest(rows, asked, value).select("policy", "k", "edge", (F.col("sum_over") + left * F.col("edge")).alias("sum"), (F.col("ln_over") + left * F.when(F.col("edge") > 0, F.ln("edge"))).alias("ln_sum"))
