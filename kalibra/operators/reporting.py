"""Experiment results, a row a run and policy, brought down to tables.

runs: (run_id, estimator, seed, n, coverage, toggle, policy, est, truth, se, lo, hi, oracle_var, runtime, gate).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf

REGIME = ("n", "coverage")


def metrics() -> dict[str, Column]:
    """Aggregates over rows: debiased RMSE, absolute error, interval score, coverage, calibration, standard errors."""
    err, width = F.col("est") - F.col("truth"), F.col("hi") - F.col("lo")
    miss = F.greatest(F.col("lo") - F.col("truth"), F.lit(0.0)) + F.greatest(F.col("truth") - F.col("hi"), F.lit(0.0))
    score, inside = width + 40 * miss, F.avg((F.col("truth").between(F.col("lo"), F.col("hi"))).cast("double"))
    return {
        "rmse_d": F.sqrt(F.avg(F.greatest(F.lit(0.0), err * err - F.col("oracle_var")))), "mae": F.avg(F.abs(err)),
        "interval_score": F.exp(F.avg(F.when(score > 0, F.ln(score + 1e-12)))), "coverage_rate": inside, "calibration": F.abs(inside - 0.95) * 100,
        "se_geomean": F.exp(F.avg(F.when(F.col("se") > 0, F.ln("se")))), "mean_width": F.avg(width), "median_width": F.percentile(width, 0.5),
    }


def table(runs: DataFrame, *keys: str) -> DataFrame:
    """All metrics by keys in one pass over the rows."""
    return runs.groupBy(*keys).agg(*[c.alias(n) for n, c in metrics().items()])


#: Groupings of reports: by regime, by estimator, by estimator and seed.
GROUPINGS = (("estimator", "n", "coverage"), ("estimator",), ("estimator", "seed"))


def tables(runs: DataFrame, groupings: tuple[tuple[str, ...], ...] = GROUPINGS) -> DataFrame:
    """(grouping, keys, metrics): table() of each grouping, by one scan of the rows. grouping names the keys of a row, joined by +; the others are null."""
    keys = list(dict.fromkeys(k for g in groupings for k in g))
    named = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys]).alias("grouping")
    return runs.groupingSets([list(g) for g in groupings], *keys).agg(named, *[c.alias(n) for n, c in metrics().items()]).select("grouping", *keys, *metrics())


def first_runs(runs: DataFrame, keys: tuple[str, ...] = ("estimator", "seed", "n", "coverage", "toggle", "policy")) -> DataFrame:
    """Of rows equal in keys the one with the least run_id: the least is a sum of parts, so a hot key is none."""
    rest = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.min_by(F.struct(*rest), "run_id").alias("__r")).select(*keys, *[f"__r.{c}" for c in rest]).select(runs.columns)


def paired_delta(runs: DataFrame, match: tuple[str, ...] = ("estimator", "seed", "n", "coverage", "policy"), value: str = "se") -> DataFrame:
    """Rows with the toggle on beside equal ones with it off, and on - off."""
    on, off = (runs.where(F.col("toggle") == flag).select(*match, F.col(value).alias(name)) for flag, name in ((True, "on"), (False, "off")))
    return on.join(off, [*match]).withColumn("delta", F.col("on") - F.col("off"))


def ranking(runs: DataFrame, run: tuple[str, ...] = ("estimator", "seed", "n", "coverage", "toggle")) -> DataFrame:
    """By run: pairwise accuracy of the policies' order, whether the best is found, and what is lost if not. A run has few policies."""
    a, b = runs.alias("a"), runs.alias("b")
    same = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.policy") < F.col("b.policy"))
    agree = F.signum(F.col("a.est") - F.col("b.est")) == F.signum(F.col("a.truth") - F.col("b.truth"))
    pairs = a.join(b, same).groupBy(F.col("a.run_id").alias("run_id")).agg(F.avg(agree.cast("double")).alias("pairwise"))
    top = runs.groupBy("run_id", *run).agg((F.max("truth") - F.max_by("truth", F.struct("est", "policy"))).alias("regret"), F.count(F.lit(1)).alias("policies"))
    return top.join(pairs, "run_id").withColumn("top1", (F.col("regret") <= 0).cast("double"))


def across_seeds(runs: DataFrame, value: str = "est") -> DataFrame:
    """(estimator, n, coverage, policy, mean, error, seeds): the combined error adds the spread over seeds to the mean square of errors."""
    return runs.groupBy("estimator", *REGIME, "policy").agg(F.avg(value).alias("mean"), F.sqrt(F.avg(F.col("se") * F.col("se")) + F.coalesce(F.var_samp(value), F.lit(0.0))).alias("error"), F.countDistinct("seed").alias("seeds"))


def outlier_bounds(runs: DataFrame, value: str = "se") -> DataFrame:
    """(estimator, lo, hi): the fences 1.5 quartile ranges beyond the quartiles."""
    q = runs.groupBy("estimator").agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    return q.select("estimator", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi"))


def detectable(runs: DataFrame) -> DataFrame:
    """(n, coverage, mean_se, mde): the least effect found with power 0.8 at level 0.05."""
    return runs.groupBy(*REGIME).agg(F.avg("se").alias("mean_se")).withColumn("mde", (1.96 + 0.84) * math.sqrt(2) * F.col("mean_se"))


def scenario_ranks(runs: DataFrame) -> DataFrame:
    """(n, coverage, estimator, median_se, rank): average ranks of ties, by the median error over policies and runs."""
    m = runs.groupBy(*REGIME, "estimator").agg(F.percentile("se", 0.5).alias("median_se"))
    at, peers = W.partitionBy(*REGIME).orderBy("median_se"), W.partitionBy(*REGIME, "median_se")
    return m.withColumn("rank", F.rank().over(at) + (F.count(F.lit(1)).over(peers) - 1) / 2)


def toggle_sensitivity(runs: DataFrame, value: str = "est") -> DataFrame:
    """(estimator, largest): the largest difference the toggle makes, by a pivot on it."""
    wide = runs.groupBy("estimator", "seed", *REGIME, "policy").pivot("toggle", [False, True]).agg(F.first(value))
    return wide.groupBy("estimator").agg(F.max(F.abs(F.col("true") - F.col("false"))).alias("largest"))


def level_sensitivity(runs: DataFrame, column: str, levels: tuple[float, float], names: tuple[str, ...] = ("rmse_d", "se_geomean", "coverage_rate"), keys: tuple[str, ...] = ("n", "coverage", "seed")) -> DataFrame:
    """(estimator, then of each metric of names the largest change between two levels of a column, such as the cap on weights' variance),
    over groups equal in keys that have both; null where none has."""
    own = table(runs.where(F.col(column).isin(*levels)), "estimator", *keys, column)
    wide = own.groupBy("estimator", *keys).agg(*[F.max(F.when(F.col(column) == v, F.col(m))).alias(f"{m}_{i}") for m in names for i, v in enumerate(levels)])
    return wide.groupBy("estimator").agg(*[F.max(F.abs(F.col(f"{m}_1") - F.col(f"{m}_0"))).alias(m) for m in names])


#: fixed values: bounds of metrics that have their own; names ending in _rate are per cent as well
FIXED_BOUNDS = {"kendall_tau": (-1.0, 1.0), "coverage": (0.0, 100.0), "coverage_robust": (0.0, 100.0)}


def metric_bounds(rows: DataFrame, values: list[str], how: str = "iqr", reach: float = 1.5) -> DataFrame:
    """(metric, lo, hi) of each metric of values over the rows of a report, nulls and NaN left out.

    iqr: least and largest value once cut to reach quartile ranges beyond the quartiles (of fewer than four values plainly the least and
    largest); percentile: the 5th and 95th; range: least and largest. A metric without values has 0 and 1, one with fixed bounds those.
    """
    if how not in ("iqr", "percentile", "range"):
        raise ValueError(f"no bounds by {how}")
    own = rows.select(*[F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")).alias(v) for v in values]).unpivot([], values, "metric", "v")
    q = own.groupBy("metric").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), *[F.percentile("v", p).alias(a) for a, p in (("q1", 0.25), ("q3", 0.75), ("p5", 0.05), ("p95", 0.95))])
    reach_ = reach * (F.col("q3") - F.col("q1"))
    lo, hi = F.col("least"), F.col("most")
    if how == "percentile":
        lo, hi = F.col("p5"), F.col("p95")
    elif how == "iqr":
        lo = F.when(F.col("n") < 4, lo).otherwise(F.greatest("least", F.col("q1") - reach_))
        hi = F.when(F.col("n") < 4, hi).otherwise(F.least("most", F.col("q3") + reach_))
    fixed = FIXED_BOUNDS | {v: (0.0, 100.0) for v in values if v.endswith("_rate")}
    for name, (a, b) in fixed.items():
        lo, hi = F.when(F.col("metric") == name, a).otherwise(lo), F.when(F.col("metric") == name, b).otherwise(hi)
    return q.select("metric", F.coalesce(lo, F.lit(0.0)).alias("lo"), F.coalesce(hi, F.lit(1.0)).alias("hi"))


def on_bounds(rows: DataFrame, bounds: DataFrame, values: list[str]) -> DataFrame:
    """rows with each metric cut to its bounds and put on [0, 1] between them; a half where they meet. bounds is a row a metric."""
    at = {r["metric"]: (r["lo"], r["hi"]) for r in bounds.collect()}
    scaled = {v: F.when(F.col(v).isNotNull(), (F.least(F.greatest(F.col(v), F.lit(a)), F.lit(b)) - a) / (b - a) if b > a else F.lit(0.5)) for v, (a, b) in ((v, at[v]) for v in values)}
    return rows.withColumns(scaled)


def gate_rates(runs: DataFrame) -> DataFrame:
    """(estimator, rate): per cent of rows that pass; a missing gate is a failure."""
    return runs.groupBy("estimator").agg((F.avg(F.coalesce(F.col("gate"), F.lit(False)).cast("double")) * 100).alias("rate"))


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds rank, adjusted p and whether it is significant; tests are the results of policies, a small table."""
    by_p = W.orderBy("p", "label")
    n = tests.count()
    ranked = tests.withColumn("rank", F.row_number().over(by_p))
    adjusted = F.min(F.least(F.lit(1.0), F.col("p") * n / F.col("rank"))).over(by_p.rowsBetween(W.currentRow, W.unboundedFollowing))
    return ranked.withColumn("adjusted", adjusted).withColumn("significant", F.col("adjusted") <= alpha)


def wilcoxon(deltas: DataFrame, key: str = "estimator", value: str = "delta") -> DataFrame:
    """(key, n, w_plus, z, p): signed ranks with average ties, by counts of levels of |delta|; zeros don't count.

    p is two-sided: exact for up to 50 differences without ties, else by the normal distribution with the variance that ties leave;
    null for fewer than 6.
    """
    own = deltas.where(F.col(value) != 0).select(key, F.abs(value).alias("a"), (F.col(value) > 0).cast("long").alias("up"))
    levels = own.groupBy(key, "a").agg(F.count(F.lit(1)).alias("c"), F.sum("up").alias("up"))
    rank = F.sum("c").over(W.partitionBy(key).orderBy("a")) - (F.col("c") - 1) / 2
    s = levels.withColumn("r", rank).groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum(F.pow("c", 3) - F.col("c")).alias("ties"))
    mean, var = F.col("n") * (F.col("n") + 1) / 4, F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("ties") / 48
    s = s.withColumn("z", F.when(var > 0, (F.col("w_plus") - mean) / F.sqrt(var)))

    @F.pandas_udf("double")
    def p_value(n: pd.Series, w: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([None if m < 6 else signed_rank_p(int(m), float(v)) if m <= 50 and not t else None if pd.isna(d) else 2 * (1 - normal_cdf(abs(d))) for m, v, t, d in zip(n, w, ties, z, strict=True)], dtype="float64")

    return s.select(key, "n", "w_plus", "z", p_value("n", "w_plus", "ties", "z").alias("p"))


def signed_rank_p(n: int, w: float) -> float:
    """The two-sided exact p of a sum w of positive ranks of 1 to n: how many of the 2^n signs give a sum as far from the middle."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] += ways[:-r].copy()
    low = min(w, n * (n + 1) / 2 - w)
    return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))


def run_level(runs: DataFrame, *keys: str, value: str = "runtime") -> DataFrame:
    """(keys, median, mean, std) of a value that a run has once: a run's rows count once."""
    one = runs.groupBy("run_id", *keys).agg(F.min(value).alias("v"))
    return one.groupBy(*keys).agg(F.percentile("v", 0.5).alias("median"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def spread_of(runs: DataFrame, values: dict[str, float], *keys: str) -> DataFrame:
    """(keys, then of each value its mean, median, least and most), each times its scale (100 for per cent); nulls don't count."""
    return runs.groupBy(*keys).agg(*[(f * scale).alias(f"{v}_{n}") for v, scale in values.items() for n, f in (("mean", F.avg(v)), ("median", F.percentile(v, 0.5)), ("min", F.min(v)), ("max", F.max(v)))])


def seed_summary(by_seed: DataFrame, values: list[str], *keys: str) -> DataFrame:
    """(keys, metric, mean, se, n): each metric over seeds, with the standard error of its mean."""
    long = by_seed.unpivot([*keys, "seed"], values, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"), F.count("value").alias("n"))


def truth_comparison(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, mae, relative, coverage, n): estimates held against true values: errors, relative errors, per cent inside intervals."""
    err = F.col("est") - F.col("truth")
    return runs.groupBy(*keys).agg(F.avg(F.abs(err)).alias("mae"), F.avg(F.try_divide(F.abs(err), F.abs("truth"))).alias("relative"), (F.avg(F.col("truth").between(F.col("lo"), F.col("hi")).cast("double")) * 100).alias("coverage"), F.count(F.lit(1)).alias("n"))


def correlations(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(a, b, r): Pearson's correlation of each pair of fields over the rows that have both; null for fewer than three. One pass."""
    made, has = [], lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    for a in fields:
        for b in fields:
            r = F.when(F.count_if(has(a, b)) >= 3, F.corr(F.when(has(a, b), F.col(a)), F.when(has(a, b), F.col(b))))
            made.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    return rows.agg(F.array(*made).alias("m")).select(F.inline("m"))


def ship_gates(rows: DataFrame) -> DataFrame:
    """One row: how many policies (affinity, ess_fraction, alpha, floor_logged, floor_fresh) have too little overlap (a missing or
    zero value counts), a heavy tail, or rewards at the floor."""
    poor = lambda c, least: F.coalesce((F.col(c) == 0) | (F.col(c) < least), F.lit(True))
    over = lambda c: F.coalesce(F.col(c) >= 0.25, F.lit(False))
    return rows.agg(F.count_if(poor("affinity", 0.2) | poor("ess_fraction", 0.05)).alias("low_overlap"), F.count_if((F.col("alpha") != 0) & (F.col("alpha") < 1)).alias("heavy_tail"), F.count_if(over("floor_logged") | over("floor_fresh")).alias("cal_floor"))


def sweet_spots(runs: DataFrame, label_cost: float = 16.0, top: int = 5) -> DataFrame:
    """(n, coverage, mean_se, mde, cost): the regimes of least detectable effect times the root of the cost, a top-k report."""
    cost = F.col("n") * (1 + label_cost * F.col("coverage"))
    return detectable(runs).withColumn("cost", cost).withColumn("__v", F.col("mde") * F.sqrt("cost")).orderBy("__v", "n", "coverage").limit(top).drop("__v")


def kendall_of_runs(runs: DataFrame) -> DataFrame:
    """(run_id, tau): Kendall's tau-b of estimates and true values over a run's policies, which are few."""
    a, b = runs.alias("a"), runs.alias("b")
    sign = lambda c: F.signum(F.col(f"a.{c}") - F.col(f"b.{c}"))
    pairs = a.join(b, (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.policy") < F.col("b.policy")))
    s = pairs.groupBy(F.col("a.run_id").alias("run_id")).agg(F.sum(sign("est") * sign("truth")).alias("s"), F.sum(F.abs(sign("est"))).alias("x"), F.sum(F.abs(sign("truth"))).alias("y"))
    return s.select("run_id", F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("s") / F.sqrt(F.col("x") * F.col("y"))).alias("tau"))


def joined_metrics(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Two tables of metrics side by side, rows that only one has kept."""
    return left.join(right, [*keys], "full_outer")


def _report(rows: DataFrame, columns: list[str], best: dict[str, str], digits: int, limit: int) -> list[list[tuple[str, int | None]]]:
    """Each cell's text and, in the columns of best, its place: 0 for the best value, 1 for the second, ties alike."""
    held = rows.select(*columns).limit(limit + 1).collect()
    if len(held) > limit:
        raise ValueError(f"a table of more than {limit} rows is no report")
    order = {c: sorted({round(r[c], digits) for r in held if r[c] is not None}, reverse=how == "max") for c, how in best.items()}

    def cell(c: str, v: object) -> tuple[str, int | None]:
        text = "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
        return text, order[c].index(round(v, digits)) if v is not None and c in order else None

    return [[cell(c, r[c]) for c in columns] for r in held]


def markdown(rows: DataFrame, columns: list[str], best: dict[str, str], digits: int = 4, limit: int = 1000) -> str:
    """A report table as Markdown: of each column in best ("min" or "max") the best value is bold, the second underlined.
    A report has limit rows at most; more are an error."""
    marks = {0: "**{}**", 1: "<u>{}</u>"}
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(marks.get(place, "{}").format(text.replace("|", "\\|")) for text, place in r) + " |" for r in _report(rows, columns, best, digits, limit)])


#: fixed values: how LaTeX writes its own signs
LATEX_SIGNS = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_text(text: str) -> str:
    return "".join(LATEX_SIGNS.get(c, c) for c in text)


def latex(rows: DataFrame, columns: list[str], best: dict[str, str], caption: str = "", label: str = "", heads: dict[str, str] | None = None, groups: str | None = None, digits: int = 4, limit: int = 1000) -> str:
    """A report table as LaTeX with booktabs rules: as markdown(), bold and underlined. Columns of best stand to the right; heads names columns
    otherwise; a rule parts rows where the column groups changes (the caller orders rows). Texts are escaped."""
    marks = {0: r"\textbf{%s}", 1: r"\underline{%s}"}
    lines = [r"\begin{table}[t]", r"\centering"]
    lines += [rf"\caption{{{latex_text(caption)}}}"] if caption else []
    lines += [rf"\label{{{label}}}"] if label else []
    lines += [r"\begin{tabular}{" + "".join("r" if c in best else "l" for c in columns) + "}", r"\toprule"]
    lines += [" & ".join(latex_text((heads or {}).get(c, c)) for c in columns) + r" \\", r"\midrule"]
    before = None
    for r in _report(rows, columns, best, digits, limit):
        group = r[columns.index(groups)][0] if groups else None
        lines += [r"\midrule"] if before is not None and group != before else []
        lines.append(" & ".join(marks.get(place, "%s") % latex_text(text) for text, place in r) + r" \\")
        before = group
    return "\n".join([*lines, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def variance_decomposition(passes: DataFrame, n_passes: int) -> DataFrame:
    """(policy, between, within, share) of prompts with all their passes: population variances of means, mean of variances."""
    by_prompt = passes.groupBy("policy", "prompt_id").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("value").alias("c")).where(F.col("c") == n_passes)
    out = by_prompt.groupBy("policy").agg(F.var_pop("m").alias("between"), F.avg("v").alias("within"))
    return out.withColumn("share", F.col("between") / (F.col("between") + F.col("within")))


def pass_values(passes: DataFrame, value: str = "logprob") -> DataFrame:
    """(policy, prompt_id, mean, median, n) of each prompt's passes; missing and positive log-probabilities don't count, and a prompt without any has nulls."""
    fine = F.when(F.col(value) <= 0, F.col(value))
    return passes.groupBy("policy", "prompt_id").agg(F.avg(fine).alias("mean"), F.percentile(fine, 0.5).alias("median"), F.count(fine).alias("n"))


def accuracy_table(runs: DataFrame, *keys: str, regimes: list[tuple[int, float]] | None = None) -> DataFrame:
    """(keys, the metrics of accuracy, pairwise and top1 in per cent, tau, regret, runtime) of runs, or of those of the regimes: the
    leaderboard, to be sorted by regret."""
    if regimes is not None:
        keep = F.lit(False)
        for n, coverage in regimes:
            keep |= (F.col("n") == n) & (F.round("coverage", 6) == round(coverage, 6))
        runs = runs.where(keep)
    order = ranking(runs, keys).join(kendall_of_runs(runs), "run_id", "left").groupBy(*keys).agg((F.avg("pairwise") * 100).alias("pairwise"), (F.avg("top1") * 100).alias("top1"), F.avg("tau").alias("tau"), F.avg("regret").alias("regret"))
    out = table(runs, *keys).select(*keys, "rmse_d", "interval_score", "calibration", "se_geomean").join(order, [*keys], "left")
    return out.join(run_level(runs, *keys).select(*keys, F.col("median").alias("runtime")), [*keys], "left") if "runtime" in runs.columns else out


def gates_table(runs: DataFrame, gates: list[str], refused: str, *keys: str) -> DataFrame:
    """(keys, per cent of rows that pass each gate, per cent refused): a missing gate is a failure."""
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")) * 100
    return runs.groupBy(*keys).agg(*[rate(c).alias(f"{c}_rate") for c in gates], rate(refused).alias("refuse_rate"))


def coverage_and_width(runs: DataFrame) -> DataFrame:
    """(estimator, n, coverage, seed, covered, width): per cent of policies inside their intervals and the mean width, rows without interval or truth left out."""
    own = runs.where(F.col("lo").isNotNull() & F.col("hi").isNotNull() & F.col("truth").isNotNull())
    return own.groupBy("estimator", *REGIME, "seed").agg((F.avg(F.col("truth").between(F.col("lo"), F.col("hi")).cast("double")) * 100).alias("covered"), F.avg(F.col("hi") - F.col("lo")).alias("width"))


def quadrant_table(runs: DataFrame, quadrants: dict[str, tuple[list[int], list[float]]]) -> DataFrame:
    """accuracy_table() by quadrant (sample sizes and label shares by name) and estimator; rows of no quadrant are left out."""
    name = F.coalesce(*[F.when(F.col("n").isin(ns) & F.round("coverage", 6).isin([round(c, 6) for c in cs]), F.lit(q)) for q, (ns, cs) in quadrants.items()])
    return accuracy_table(runs.withColumn("quadrant", name).where("quadrant is not null"), "quadrant", "estimator")


def ess_comparison(runs: DataFrame, value: str = "ess") -> DataFrame:
    """(estimator, n, coverage, without, with_, ratio): the median effective share without and with weight calibration (the toggle)."""
    wide = runs.groupBy("estimator", *REGIME).agg(F.percentile(F.when(~F.col("toggle"), F.col(value)), 0.5).alias("without"), F.percentile(F.when(F.col("toggle"), F.col(value)), 0.5).alias("with_"))
    return wide.withColumn("ratio", F.try_divide("with_", "without"))


def forest(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """(policy, estimate, lo, hi, truth, inside, rmse): estimates beside true values (policy, truth), where known, and the root mean
    square error over the policies that have one: one number, in each row."""
    own = estimates.select("policy", "estimate", "lo", "hi").join(truth.select("policy", "truth"), "policy", "left")
    rmse = own.agg(F.sqrt(F.avg(F.pow(F.col("estimate") - F.col("truth"), 2))).alias("rmse"))
    return own.withColumn("inside", F.col("truth").between(F.col("lo"), F.col("hi"))).crossJoin(F.broadcast(rmse))  # one row


def text_table(rows: DataFrame, columns: list[str], digits: int = 4, limit: int = 1000) -> str:
    """A report table in columns of fixed width, numbers to the right. A report has limit rows at most; more are an error."""
    held = rows.select(*columns).limit(limit + 1).collect()
    if len(held) > limit:
        raise ValueError(f"a table of more than {limit} rows is no report")
    cells = [["" if r[c] is None else f"{r[c]:.{digits}f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in held]
    number = [any(isinstance(r[c], (int, float)) for r in held) for c in columns]
    width = [max([len(c), *[len(line[i]) for line in cells]]) for i, c in enumerate(columns)]
    place = lambda line: "  ".join(v.rjust(w) if right else v.ljust(w) for v, w, right in zip(line, width, number, strict=True)).rstrip()
    return "\n".join([place(columns), "-" * (sum(width) + 2 * len(width) - 2), *map(place, cells)])
