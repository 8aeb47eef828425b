"""Datasets from passes of log-probabilities and from scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reporting import pass_values


def assemble(passes: DataFrame, base: str, scores: DataFrame | None = None, method: str = "mean") -> DataFrame:
    """(prompt_id, base_lp, target_lps and the columns of scores) from passes (policy, prompt_id, logprob): passes of a prompt are
    averaged (or their median taken); a prompt without a value of the base policy, or without one of any other, is left out.
    scores: a row a prompt at most."""
    one = pass_values(passes).select("policy", "prompt_id", F.col(method).alias("lp"))
    others = F.collect_list(F.when((F.col("policy") != base) & F.col("lp").isNotNull(), F.struct("policy", "lp")))
    wide = one.groupBy("prompt_id").agg(F.max(F.when(F.col("policy") == base, F.col("lp"))).alias("base_lp"), F.map_from_entries(others).alias("target_lps"))
    wide = wide.where(F.col("base_lp").isNotNull() & (F.size("target_lps") > 0))
    return wide if scores is None else wide.join(scores, "prompt_id", "left")
