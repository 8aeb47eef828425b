"""Whether a log can be analysed: rules over all of its rows, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.jsonl import number

#: fixed values: fields each record has; labels needed, and advised
FIELDS, LEAST_LABELS, ADVISED_LABELS = ("prompt_id", "prompt", "response", "base_policy_logprob", "target_policy_logprobs"), 10, 50


def raw_log(spark: SparkSession, path: str | list[str], *fields: str) -> DataFrame:
    """Records of a JSON-lines log with each field as text (objects as JSON), and __broken lines."""
    names = dict.fromkeys([*FIELDS, "metadata", *fields, "__broken"])
    lines = spark.read.text(path).where(F.trim("value") != "")
    schema = ", ".join(f"`{n}` string" for n in names)
    read = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}).alias("r"))
    return read.select("r.*", F.when(F.col("r").isNull(), F.col("value")).alias("__gone")).withColumn("__broken", F.coalesce("__broken", "__gone")).drop("__gone")


def _field(raw: DataFrame, name: str | None) -> Column:
    """A field as text: the record's own, else that of its metadata."""
    if name is None:
        return F.lit(None).cast("string")
    inside = F.get_json_object("metadata", f"$['{name}']")
    return F.coalesce(F.col(f"`{name}`"), inside) if name in raw.columns else inside


def validate(raw: DataFrame, judge_field: str | None = "judge_score", oracle_field: str | None = "oracle_label", reward_field: str | None = "reward") -> DataFrame:
    """(rule, level, n, of): the rules that rows of raw_log() break: on how many rows (n) of how many (of). No row: the log is valid.

    Errors: empty log; broken lines; a record without one of FIELDS (base_policy_logprob null counts as without); policies that are no
    object, or none; policies other than those most records name (of sets as frequent, the first in the order of names); judge scores or labels that are no
    number nor an object with mean or value; neither rewards nor judge scores; scores without rewards and no label, or fewer than
    LEAST_LABELS. A warning: fewer labels than ADVISED_LABELS. Broken lines count for the first two rules only.
    """
    policies, judge, oracle, reward = F.col("target_policy_logprobs"), _field(raw, judge_field), _field(raw, oracle_field), _field(raw, reward_field)
    named = F.array_sort(F.map_keys(F.from_json(policies, "map<string,string>")))
    is_map = F.ltrim(policies).startswith("{")
    rows = raw.select("__broken", *FIELDS, judge.alias("__judge"), oracle.alias("__oracle"), reward.alias("__reward"), is_map.alias("__map"), F.when(is_map, named).alias("__named"))
    whole = F.col("__broken").isNull()
    have = lambda c: F.count_if(whole & F.col(c).isNotNull())
    odd = lambda c: F.count_if(whole & F.col(c).isNotNull() & number(F.col(c)).isNull())
    counts = {
        "lines": F.count(F.lit(1)), "n": F.count_if(whole), **{f"with {f}": have(f) for f in FIELDS},
        "no map": F.count_if(whole & policies.isNotNull() & ~F.col("__map")), "empty map": F.count_if(whole & F.col("__map") & (F.coalesce(F.size("__named"), F.lit(0)) < 1)),
        "judged": F.count_if(whole & number(F.col("__judge")).isNotNull()), "odd judge": odd("__judge"), "labelled": F.count_if(whole & number(F.col("__oracle")).isNotNull()), "odd label": odd("__oracle"), "rewarded": have("__reward"),
    }
    # sets of policies are few: partial sums by set, then one row
    sets = rows.groupBy(F.when(whole, F.col("__named")).alias("set")).agg(*[c.alias(k) for k, c in counts.items()])
    named_rows = F.when(F.size("set") > 0, F.col("n")).otherwise(0)
    one = sets.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counts], F.coalesce(F.sum(named_rows), F.lit(0)).alias("in sets"), F.coalesce(F.max(named_rows), F.lit(0)).alias("in most"))
    c, n = F.col, F.col("n")
    unrewarded = c("rewarded") == 0
    lacking = unrewarded & (c("judged") > 0)
    few = F.lit(oracle_field is not None) & lacking & (c("labelled") > 0)
    rules = [
        ("empty log", "error", c("lines"), c("lines") == 0), ("broken line", "error", c("lines") - n, c("lines") > n),
        *[(f"no {f}", "error", n - c(f"with {f}"), c(f"with {f}") < n) for f in FIELDS],
        ("policies are no object", "error", c("no map"), c("no map") > 0), ("no policies", "error", c("empty map"), c("empty map") > 0), ("other policies", "error", c("in sets") - c("in most"), c("in sets") > c("in most")),
        ("judge score is no number", "error", c("odd judge"), c("odd judge") > 0), ("label is no number", "error", c("odd label"), c("odd label") > 0),
        ("neither rewards nor judge scores", "error", n, (n > 0) & unrewarded & (c("judged") == 0)), ("no labels", "error", n, lacking & (c("labelled") == 0)),
        ("too few labels", "error", c("labelled"), few & (c("labelled") < LEAST_LABELS)), ("few labels", "warning", c("labelled"), few & (c("labelled") >= LEAST_LABELS) & (c("labelled") < ADVISED_LABELS)),
    ]
    found = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), k.cast("long").alias("n"))) for rule, level, k, broken in rules]))
    return one.select(F.explode(found).alias("f"), c("lines").alias("of")).select("f.*", "of")


def is_valid(found: DataFrame) -> bool:
    return found.where("level = 'error'").limit(1).count() == 0


def flagged(scores: Column, most: float = 0.3) -> Column:
    """Whether any of a map's moderation scores is over most; no map, no flag."""
    return F.coalesce(F.exists(F.map_values(scores), lambda v: F.coalesce(v > most, F.lit(False))), F.lit(False))


def without_blocked(rows: DataFrame, text: str, blocked: DataFrame, gram: int = 1) -> DataFrame:
    """Rows whose text has none of the blocked phrases (phrase), in any case, at word bounds; phrases have gram words, others never match.
    Words are runs of characters other than white space and ASCII punctuation. Rows without a text stay.

    The caller's list may be long: phrases of texts are joined to it, and what is blocked comes back by the text's digest, so equal texts
    have one verdict and no row ids are needed.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[\s!-/:-@\[-`{-~]+"), lambda w: w != "")
    # the outer transform binds the words, so that they are split once a text
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - gram + 1), lambda i: F.array_join(F.slice(ws, i, gram), " "))
    grams = F.transform(F.array(words(F.col(text))), lambda ws: F.when(F.size(ws) >= gram, ws if gram == 1 else runs(ws)))[0]
    own = rows.withColumn("__digest", F.sha2(text, 256))
    listed = blocked.select(F.array_join(words(F.col("phrase")), " ").alias("__phrase")).where("__phrase <> ''").distinct()
    have = own.select("__digest", F.explode(F.array_distinct(grams)).alias("__phrase"))
    return own.join(have.join(listed, "__phrase", "left_semi").select("__digest").distinct(), "__digest", "left_anti").select(*rows.columns)
