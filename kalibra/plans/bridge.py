"""Logged rows and fresh draws made from the events table, for queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICIES = ["policy_a", "policy_b"]

#: The columns as SQL that Spark and DuckDB read alike.
LOGGED_COLUMNS = """event_id as row_id,
 concat('u', cast(user_id as varchar(20)), '_', cast(event_id as varchar(20))) as prompt_id,
 round(value / (value + 50.0), 2) as judge_score,
 case when event_id % 4 = 0 then greatest(0.0, least(1.0, round(0.1 + 0.8 * value / (value + 50.0) + ((event_id * 31) % 101 - 50) / 500.0, 4))) end as oracle_label,
 case when event_id % 97 = 0 then null else -20.0 - ((event_id * 17) % 400) / 20.0 end as base_lp,
 case when event_id % 53 = 0 then null else -20.0 - ((event_id * 17) % 400) / 20.0 + least(1.9, (value / (value + 50.0) - 0.5) * 2 + ((event_id * 13) % 101 - 50) / 100.0) end as lp_a,
 -20.0 - ((event_id * 17) % 400) / 20.0 - ((event_id * 29) % 200) / 50.0 as lp_b"""

#: CTEs for DuckDB: logged; rows (a row a policy, incomplete rows left out); fresh; w (weights of mean 1).
SQL = f"""with logged as (select {LOGGED_COLUMNS} from events),
complete as (select * from logged where base_lp is not null and lp_a is not null and lp_b is not null),
rows_ as (select row_id, prompt_id, judge_score, oracle_label, 'policy_a' as policy, lp_a - base_lp as lr from complete
 union all select row_id, prompt_id, judge_score, oracle_label, 'policy_b', lp_b - base_lp from complete),
w as (select *, exp(lr - max(lr) over (partition by policy)) / avg(exp(lr - mx)) over (partition by policy) as w from (select *, max(lr) over (partition by policy) as mx from rows_)),
fresh as (select prompt_id, row_id, 'policy_a' as policy, d as draw_idx, round(greatest(0.0, least(1.0, judge_score + 0.05 + ((row_id * 7 + d * 37) % 41 - 20) / 200.0)), 3) as judge_score from logged cross join (select unnest([0, 1, 2]) as d) where d < 1 + row_id % 3
 union all select prompt_id, row_id, 'policy_b', d, round(greatest(0.0, least(1.0, judge_score - 0.1 + ((row_id * 11 + d * 23) % 41 - 20) / 200.0)), 3) from logged cross join (select unnest([0, 1, 2]) as d) where d < 1 + row_id % 3)"""


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[x.strip() for x in _parts(LOGGED_COLUMNS)])
    return rows.withColumn("target_lps", F.create_map(F.lit("policy_a"), "lp_a", F.lit("policy_b"), "lp_b")).drop("lp_a", "lp_b")


def _parts(text: str) -> list[str]:
    """Top-level commas part columns."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = logged(spark, sf_dir).select("prompt_id", "row_id", "judge_score", F.explode(F.sequence(F.lit(0), (F.col("row_id") % 3).cast("int"))).alias("draw_idx"))
    one = lambda policy, shift, a, b: base.select("prompt_id", "row_id", F.lit(policy).alias("policy"), "draw_idx", F.expr(f"round(greatest(0.0, least(1.0, judge_score + {shift} + ((row_id * {a} + draw_idx * {b}) % 41 - 20) / 200.0)), 3)").alias("judge_score"))
    return one("policy_a", "0.05", 7, 37).union(one("policy_b", "(-0.1)", 11, 23))
