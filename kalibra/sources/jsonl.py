"""Logged rows and fresh draws from JSON lines; results to JSON and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw columns; scores may be numbers or objects with mean or value, so they are read as text.
RAW_LOGGED = "prompt_id string, prompt string, response string, reward string, base_policy_logprob double, target_policy_logprobs map<string,double>, judge_score string, oracle_label string, metadata string"
RAW_FRESH = "prompt_id string, target_policy string, policy string, judge_score double, draw_idx int, response string, fold_id int, metadata struct<judge_score:double>, _corrupt_record string"


def number(c: Column) -> Column:
    """A number, or the mean or value of an object; null for anything else."""
    return F.coalesce(F.get_json_object(c, "$.mean").try_cast("double"), F.get_json_object(c, "$.value").try_cast("double"), c.try_cast("double"))


def read_logged(spark: SparkSession, path: str, judge_field: str = "judge_score", oracle_field: str = "oracle_label") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of a log. A broken line is an error; a row without prompt or response, with a positive
    log-probability or a reward outside [0, 1] is rejected.

    A row's key is prompt_id, else that of its metadata, else a digest of the prompt. A row_id tells rows apart.
    """
    raw = spark.read.schema(RAW_LOGGED).option("mode", "FAILFAST").json(path)
    inside = lambda name: F.get_json_object("metadata", f"$.{name}")
    top = lambda name: F.col(name) if name in raw.columns else F.lit(None).cast("string")
    rows = raw.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.coalesce(F.nullif("prompt_id", F.lit("")), inside("prompt_id"), F.concat(F.lit("prompt_"), F.substring(F.sha2("prompt", 256), 1, 12))).alias("prompt_id"),
        "prompt", "response", number(F.col("reward")).alias("reward"), F.col("base_policy_logprob").alias("base_lp"), F.col("target_policy_logprobs").alias("target_lps"),
        F.coalesce(number(top(judge_field)), number(inside(judge_field))).alias("judge_score"), F.coalesce(number(top(oracle_field)), number(inside(oracle_field))).alias("oracle_label"), F.col("metadata").alias("metadata_json"),
    )
    lp_fine = (F.coalesce(F.col("base_lp"), F.lit(0.0)) <= 0) & F.forall(F.coalesce(F.map_values("target_lps"), F.array().cast("array<double>")), lambda v: F.coalesce(v, F.lit(0.0)) <= 0)
    fine = F.col("prompt").isNotNull() & F.col("response").isNotNull() & lp_fine & F.coalesce(F.col("reward").between(0, 1), F.col("reward").isNull())
    return rows.where(fine), rows.where(~fine)


def policies_of(logged: DataFrame) -> list[str]:
    """The policies that rows name, sorted."""
    return sorted(r[0] for r in logged.select(F.explode(F.map_keys("target_lps"))).distinct().collect())


def read_fresh(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_id, policy, draw_idx, judge_score, response): broken lines and rows without a score in [0, 1] are skipped."""
    raw = spark.read.schema(RAW_FRESH).option("mode", "PERMISSIVE").json(path)
    rows = raw.where("_corrupt_record is null").select("prompt_id", F.coalesce("target_policy", "policy").alias("policy"), F.coalesce("draw_idx", F.lit(0)).alias("draw_idx"), F.coalesce("judge_score", F.col("metadata.judge_score")).alias("judge_score"), "response")
    return rows.where(F.col("prompt_id").isNotNull() & F.col("policy").isNotNull() & F.col("judge_score").between(0, 1))


def draw_report(fresh: DataFrame, draws_per_prompt: int | None = None) -> DataFrame:
    """(policy, n_prompts, n_draws, least, most, expected, n_unequal): how many draws prompts have, and how many prompts have another number
    than draws_per_prompt, or than most prompts of the policy have (of numbers as frequent the smaller)."""
    counts = fresh.groupBy("policy", "prompt_id").agg(F.count(F.lit(1)).alias("d")).groupBy("policy", "d").agg(F.count(F.lit(1)).alias("c"))
    usual = F.max_by("d", F.struct("c", -F.col("d"))) if draws_per_prompt is None else F.lit(draws_per_prompt).cast("long")
    # numbers of draws are few: a row a policy and number
    a = counts.groupBy("policy").agg(F.sum("c").alias("n_prompts"), F.sum(F.col("c") * F.col("d")).alias("n_draws"), F.min("d").alias("least"), F.max("d").alias("most"), usual.alias("expected"), F.collect_list(F.struct("d", "c")).alias("__all"))
    other = F.aggregate("__all", F.lit(0).cast("long"), lambda s, x: s + F.when(x["d"] != F.col("expected"), x["c"]).otherwise(0))
    return a.withColumn("n_unequal", other).drop("__all")


def due(work: DataFrame, done: DataFrame, key: str = "prompt_id") -> DataFrame:
    """What is still to do: rows whose key has no finished record."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def join_passes(first: DataFrame, later: dict[int, DataFrame], key: str = "prompt_id", value: str = "logprob") -> DataFrame:
    """The first pass's rows with a column for each later pass, null where it lacks the key."""
    out = first.withColumnRenamed(value, f"{value}_1")
    for n in sorted(later):
        out = out.join(later[n].select(key, F.col(value).alias(f"{value}_{n}")), key, "left")
    return out


def write_results(estimates: DataFrame, path: str, kind: str = "json") -> None:
    """A row a policy, as JSON lines (not-a-number becomes null) or as CSV with a header."""
    clean = estimates.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in estimates.dtypes])
    if kind == "json":
        clean.write.json(path)
    else:
        clean.write.option("header", True).csv(path)
