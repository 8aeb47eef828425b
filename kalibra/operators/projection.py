"""The fast projection of weights on rising ones of mean one: the falling fit of their cumulated excess over one, taken apart again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import running, written
from .weights import mean_one


def _turn(r) -> tuple[int, float]:
    """(offset of the first pooled row in its level, from 1; value of that row)."""
    w, start, left, rows = r["x"] - 1, r["begin"], r["total"] - r["before"], r["n"] - r["upto"] + r["c"]
    z = lambda k: start + (k - 1) * w  # noqa: E731  the sum before the level's k-th row
    mean = lambda k: (left - (k - 1) * start - w * (k - 1) * k / 2) / (rows - k + 1)
    low, high = 1, int(r["c"])
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if z(mid) >= mean(mid) else (low, mid - 1)
    return low, mean(low) - z(low) + 1


def fast(rows: DataFrame, w: str = "w", name: str = "w_fast") -> DataFrame:
    """Adds name: weights that rise with w, of mean one in each policy.

    Sorted weights of mean one less one, added up, first fall and then rise, so their falling fit leaves the first ones as they are and
    pools the rest into one block: weights keep their value up to a row, that row takes what is left over, all after it are equal. The row is
    found from sums by level of w; only levels are sorted. Negative or missing weights count as zero; equal ones are ordered by row_id. A
    policy whose weights are all zero gets ones.
    """
    own = mean_one(rows.withColumn("__x", F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0))), w="__x")
    own = written(own, "mean-one")
    levels = own.groupBy("policy", F.col("__x").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("c")).withColumn("s", F.col("x") * F.col("c"))
    levels = running(levels, ["policy"], "x", {"upto": "c", "mass": "s"})
    levels = levels.withColumn("begin", F.expr("(mass - s) - (upto - c)")).withColumn("z", F.expr("c * begin + (x - 1) * c * (c + 1) / 2"))
    levels = written(running(levels, ["policy"], "x", {"zs": "z"}).withColumn("before", F.col("zs") - F.col("z")), "levels")
    whole = levels.groupBy("policy").agg(F.sum("z").alias("total"), F.sum("c").alias("n"), F.sum("s").alias("sum"))
    # the last level whose first row may start the block: what was added up before it is no less than the mean of all after
    fits = F.col("begin") >= (F.col("total") - F.col("before")) / (F.col("n") - F.col("upto") + F.col("c"))
    last = levels.join(F.broadcast(whole), "policy").where(fits).groupBy("policy").agg(F.max_by(F.struct("x", "c", "upto", "begin", "before", "total", "n", "sum"), "x").alias("r"))
    plan = [(r["policy"], r["r"]["x"], *_turn(r["r"]), r["r"]["sum"] > 0) for r in last.collect()]  # a row a policy
    turns = rows.sparkSession.createDataFrame([(p, x, k, float(v), bool(some)) for p, x, k, v, some in plan], "policy string, __turn double, __k long, __v double, __some boolean")
    own = own.join(F.broadcast(turns), "policy")
    at = running(own.where(F.col("__x") == F.col("__turn")).select("policy", "row_id", F.lit(1).alias("one")), ["policy"], "row_id", {"__place": "one"}).drop("one")
    own = own.join(at, ["policy", "row_id"], "left")
    before = levels.join(F.broadcast(turns), "policy").where(F.col("x") < F.col("__turn")).groupBy("policy").agg(F.max("x").alias("__least"))
    own = own.join(F.broadcast(before), "policy", "left")
    least = F.when(F.col("__k") > 1, F.col("__turn")).otherwise(F.coalesce("__least", F.lit(0.0)))  # running maximum before the turn
    turn = F.greatest(F.col("__v"), F.lit(0.0), least)
    value = F.when((F.col("__x") < F.col("__turn")) | (F.col("__place") < F.col("__k")), F.col("__x")).when(F.col("__place") == F.col("__k"), turn).otherwise(F.greatest(F.lit(1.0), turn))
    own = own.withColumn(name, F.when(F.col("__some"), value).otherwise(1.0))
    return mean_one(own, w=name).drop("__x", "__turn", "__k", "__v", "__some", "__place", "__least")
