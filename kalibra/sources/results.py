"""Results of experiments and analyses: scans of JSON lines, folders of JSON files and CSV; fresh draws where they are usually put; sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import normal_ppf
from . import jsonl

_BY_POLICY = ("estimates", "oracle_truths", "standard_errors", "robust_standard_errors", "ess_relative", "hill_alpha", "bhattacharyya")
RAW_EXPERIMENT = (
    "run_id string, success boolean, seed long, runtime_s double, use_weight_calibration boolean, rho double, n_oracle long, "
    "spec struct<seed_base:long,sample_size:long,oracle_coverage:double,estimator:string,extra:struct<use_weight_calibration:boolean,rho:double,outer_cv:boolean>>, "
    + "".join(f"{c} map<string,double>, " for c in _BY_POLICY)
    + "confidence_intervals map<string,array<double>>, robust_confidence_intervals map<string,array<double>>, mc_diagnostics map<string,struct<mc_var_fraction:double>>, n_oracle_per_policy map<string,long>, "
    "diagnostics map<string,struct<hill_alpha:double,kendall_tau:double,orthogonality_ci:array<double>,cap_activity_rate:double>>"
)
RAW_ANALYSIS = (
    "timestamp string, method string, target_policies array<string>, per_policy_results map<string,struct<estimate:double,standard_error:double,ci_lower:double,ci_upper:double,n_samples:long>>, "
    "metadata struct<calibration_info:struct<f_min:double,f_max:double,n_oracle:long,rmse:double,low_s_label_coverage_bottom10:double,low_s_label_coverage_bottom20:double>,"
    "calibration_floor:map<string,struct<floor_mass_logged:double,floor_mass_fresh:double>>,oua:struct<var_oracle_per_policy:map<string,double>>>, "
    "diagnostics struct<ess_per_policy:map<string,double>,tail_indices:map<string,double>,hellinger_per_policy:map<string,double>,hellinger_affinity:double>"
)
#: Fixed value: labels behind a true value where a record doesn't say.
ORACLE_ROWS = 4989


def read_experiments(spark: SparkSession, path: str, policies: list[str] | None = None) -> DataFrame:
    """A row a run and policy from JSON lines: (run_id, seed, n, coverage, estimator, toggle, rho, outer_cv, runtime, policy, est, truth,
    se, se_robust, lo, hi, lo_robust, hi_robust, n_oracle, ess, alpha, affinity, mc_share, gates, refused, oracle_var).

    Broken lines and runs without success are left out. policies: these only. A run without an id is called by a digest of its line.
    Ends of intervals are put in order. Of dr-cpo the calibrated form has a name of its own. A gate whose figures are missing passes.
    """
    raw = spark.read.text(path).select("value", F.from_json("value", RAW_EXPERIMENT).alias("r")).select("value", "r.*").where(F.coalesce("success", F.lit(False)))
    extra = F.col("spec.extra")
    toggle = F.coalesce(extra["use_weight_calibration"], F.col("use_weight_calibration"), F.lit(False))
    one = raw.select(
        F.coalesce(F.nullif("run_id", F.lit("")), F.concat(F.lit("run_"), F.substring(F.sha2("value", 256), 1, 12))).alias("run_id"), F.coalesce("spec.seed_base", "seed").alias("seed"), F.col("spec.sample_size").alias("n"),
        F.col("spec.oracle_coverage").alias("coverage"), F.when((F.col("spec.estimator") == "dr-cpo") & toggle, "calibrated-dr-cpo").otherwise(F.col("spec.estimator")).alias("estimator"), toggle.alias("toggle"),
        F.coalesce(extra["rho"], F.col("rho"), F.lit(1.0)).alias("rho"), F.coalesce(extra["outer_cv"], F.lit(False)).alias("outer_cv"), F.col("runtime_s").alias("runtime"), F.explode("estimates").alias("policy", "est"),
        *_BY_POLICY[1:], "confidence_intervals", "robust_confidence_intervals", "mc_diagnostics", "n_oracle_per_policy", "n_oracle", "diagnostics",
    )
    if policies is not None:
        one = one.where(F.col("policy").isin(policies))
    of = lambda c: F.try_element_at(F.col(c), F.col("policy"))
    end = lambda c, i: F.when(F.size(of(c)) == 2, F.try_element_at(F.sort_array(of(c)), F.lit(i)))
    robust, d = F.coalesce(F.size("robust_standard_errors"), F.lit(0)) > 0, of("diagnostics")
    fine = lambda bad: ~F.coalesce(bad, F.lit(False))
    out = one.select(
        "run_id", "seed", "n", "coverage", "estimator", "toggle", "rho", "outer_cv", "runtime", "policy", "est", of("oracle_truths").alias("truth"), of("standard_errors").alias("se"),
        F.when(robust, of("robust_standard_errors")).otherwise(of("standard_errors")).alias("se_robust"), end("confidence_intervals", 1).alias("lo"), end("confidence_intervals", 2).alias("hi"),
        end("robust_confidence_intervals", 1).alias("lo_robust"), end("robust_confidence_intervals", 2).alias("hi_robust"), F.coalesce(of("n_oracle_per_policy"), F.col("n_oracle"), F.lit(ORACLE_ROWS)).alias("n_oracle"),
        of("ess_relative").alias("ess"), of("hill_alpha").alias("alpha"), of("bhattacharyya").alias("affinity"), of("mc_diagnostics")["mc_var_fraction"].alias("mc_share"),
        (fine(of("ess_relative") < 0.1) & fine(d["hill_alpha"] < 2)).alias("gate_overlap"), fine(d["kendall_tau"] < 0.3).alias("gate_judge"),
        fine((F.get(d["orthogonality_ci"], 0) > 0) | (F.get(d["orthogonality_ci"], 1) < 0)).alias("gate_dr"), fine(d["cap_activity_rate"] > 0.5).alias("gate_cap"), (F.col("est").isNull() | F.isnan("est")).alias("refused"),
    )
    var = F.when((F.col("n_oracle") > 0) & ~F.isnan("truth"), F.least(F.col("truth") * (1 - F.col("truth")), F.lit(0.25)) / F.col("n_oracle"))
    return out.withColumn("oracle_var", var)


#: The columns of an aggregate of analyses, in order.
AGGREGATE = (
    "file", "timestamp", "method", "policy", "estimate", "standard_error", "ci_lower", "ci_upper", "n_samples", "ess_fraction", "tail_index", "hellinger_affinity",
    "f_min", "f_max", "n_oracle", "cal_rmse", "low_s_cov_b10", "low_s_cov_b20", "floor_mass_logged", "floor_mass_fresh", "var_oracle",
)


def read_analyses(spark: SparkSession, folder: str, one_a_file: bool = True) -> DataFrame:
    """The columns of AGGREGATE, a row a file and policy, from all .json files under the folder; files that are no such records are passed over.
    one_a_file: a file is one record; else each of its lines is. Policies are those the record names, else those with results; affinity is the policy's, else that of all."""
    raw = spark.read.schema(RAW_ANALYSIS).option("multiLine", one_a_file).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    named = F.when(F.size("target_policies") > 0, F.col("target_policies")).otherwise(F.map_keys("per_policy_results"))
    own = raw.select("*", F.col("_metadata.file_path").alias("file"), F.explode(named).alias("policy"))
    of = lambda c: F.try_element_at(F.col(c), F.col("policy"))
    p, cal, floor = of("per_policy_results"), F.col("metadata.calibration_info"), of("metadata.calibration_floor")
    return own.select(
        "file", "timestamp", "method", "policy", *[p[c].alias(c) for c in ("estimate", "standard_error", "ci_lower", "ci_upper", "n_samples")], of("diagnostics.ess_per_policy").alias("ess_fraction"),
        of("diagnostics.tail_indices").alias("tail_index"), F.coalesce(of("diagnostics.hellinger_per_policy"), F.col("diagnostics.hellinger_affinity")).alias("hellinger_affinity"), cal["f_min"].alias("f_min"), cal["f_max"].alias("f_max"),
        cal["n_oracle"].alias("n_oracle"), cal["rmse"].alias("cal_rmse"), cal["low_s_label_coverage_bottom10"].alias("low_s_cov_b10"), cal["low_s_label_coverage_bottom20"].alias("low_s_cov_b20"),
        floor["floor_mass_logged"].alias("floor_mass_logged"), floor["floor_mass_fresh"].alias("floor_mass_fresh"), of("metadata.oua.var_oracle_per_policy").alias("var_oracle"),
    )


def to_number(c: Column) -> Column:
    """The number a text says; not-a-number where it says none."""
    return F.coalesce(c.try_cast("double"), F.lit(float("nan")))


def read_csv(spark: SparkSession, path: str, numbers: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header, all columns text but numbers; of these, one that the file lacks is not-a-number throughout."""
    raw = spark.read.option("header", True).csv(path)
    return raw.withColumns({c: to_number(F.col(c)) if c in raw.columns else F.lit(float("nan")) for c in numbers})


#: Where fresh draws of a policy are looked for, in this order.
DRAW_PLACES = ("{policy}_responses.jsonl", "responses/{policy}_responses.jsonl", "{policy}_fresh.jsonl", "fresh_draws/{policy}.jsonl")


def find_fresh(spark: SparkSession, folder: str, policy: str) -> DataFrame:
    """(prompt_id, policy, draw_idx, judge_score, response) from the first of DRAW_PLACES that can be read. A file with a broken line or
    a draw without a score can't: scores are never made up. The draws are the policy's, whatever they say."""
    wrong = []
    for place in DRAW_PLACES:
        path = f"{folder.rstrip('/')}/{place.format(policy=policy)}"
        try:
            raw = spark.read.schema(jsonl.RAW_FRESH).option("mode", "PERMISSIVE").json(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        score = F.coalesce("judge_score", "metadata.judge_score")
        if raw.where(F.col("_corrupt_record").isNotNull() | score.isNull()).limit(1).count():
            wrong.append(path)
            continue
        return raw.select("prompt_id", F.lit(policy).alias("policy"), F.coalesce("draw_idx", F.lit(0)).alias("draw_idx"), score.alias("judge_score"), "response")
    raise FileNotFoundError(f"no fresh draws of {policy} in {folder}" + (f"; broken or without scores: {', '.join(wrong)}" if wrong else ""))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines; fields that are null are left out."""
    rows.write.json(path)


def append_progress(rows: DataFrame, path: str) -> None:
    """Further records of a run beside those that are there; a job's files appear together when it commits, or not at all."""
    rows.write.mode("append").json(path)


def write_aggregate(rows: DataFrame, path: str) -> None:
    """read_analyses() as CSV with a header, columns in the order of AGGREGATE; those that rows lack are empty."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in AGGREGATE]).write.option("header", True).csv(path)


def exported(estimates: DataFrame, rewards: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """(policy, estimate, standard_error, ci_lower, ci_upper, is_best): the base policy, from the mean of logged rewards, and the targets
    (policy, estimate, se, lo, hi); the best is a target of the largest estimate, of equal ones the first by name."""
    n = F.sqrt(F.count("reward"))
    base = rewards.agg(F.avg("reward").alias("estimate"), (F.stddev_samp("reward") / n).alias("standard_error"))
    base = base.select(F.lit("base").alias("policy"), "estimate", "standard_error", (F.col("estimate") - z * F.col("standard_error")).alias("ci_lower"), (F.col("estimate") + z * F.col("standard_error")).alias("ci_upper"), F.lit(False).alias("is_best"))
    best = estimates.agg(F.min_by("policy", F.struct(-F.col("estimate"), "policy")).alias("__best"))
    targets = estimates.crossJoin(F.broadcast(best)).select("policy", "estimate", F.col("se").alias("standard_error"), F.col("lo").alias("ci_lower"), F.col("hi").alias("ci_upper"), (F.col("policy") == F.col("__best")).alias("is_best"))  # one row
    return base.unionByName(targets)


def write_document(estimates: DataFrame, path: str, method: str, metadata: dict[str, str] | None = None) -> None:
    """One JSON document at path from (policy, estimate, se, n): method, metadata and a block a policy with its normal 95 % interval.

    Not-a-number becomes null. A row a policy is all there is, so the document is one row of one task.
    """
    fine = lambda c: F.when(~F.isnan(c), c)
    half = normal_ppf(0.975) * F.col("se")
    block = F.struct(fine(F.col("estimate")).alias("estimate"), fine(F.col("se")).alias("standard_error"), fine(F.col("estimate") - half).alias("ci_lower"), fine(F.col("estimate") + half).alias("ci_upper"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_samples"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("policy").cast("string").alias("policy"), block.alias("block"))))
    facts = F.map_from_arrays(F.array(*[F.lit(k) for k in metadata]), F.array(*[F.lit(str(v)) for v in metadata.values()])) if metadata else F.lit(None).cast("map<string,string>")
    one = estimates.agg(entries.alias("e")).select(F.lit(method).alias("method"), F.lit(0.05).alias("alpha"), F.transform("e", lambda x: x["policy"]).alias("target_policies"), facts.alias("metadata"), F.map_from_entries("e").alias("per_policy_results"))
    one.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


DOCUMENT = "method string, alpha double, target_policies array<string>, metadata map<string,string>, per_policy_results map<string,struct<estimate:double,standard_error:double,ci_lower:double,ci_upper:double,n_samples:bigint>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(method, metadata, policy, estimate, standard_error, ci_lower, ci_upper, n_samples) of the documents at path (a glob may name many)."""
    own = spark.read.text(path, wholetext=True).select(F.from_json("value", DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    return own.select("d.method", "d.metadata", F.explode("d.per_policy_results").alias("policy", "r")).select("method", "metadata", "policy", "r.*")
