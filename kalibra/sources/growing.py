"""Logs that are appended to: passes by file name, last records, quarantined lines, and a stream that goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.tables import written
from .jsonl import due

#: fixed values: how files of passes are named (a file, or a folder of parts under that name); a match begins where a part of the path
#: does, else each letter of a long path would be tried
PASS_NAME = r"(?<![^/])([^/]+?)_logprobs(?:_pass(\d+))?\.jsonl(?:/[^/]*)?$"

#: what tells two records' order: the batch that brought them, the file, the block of the file, the row in the block
PLACE = ["log_batch", "log_file", "log_block", "log_row"]

#: what monotonically_increasing_id() counts rows of a task with
_ROW_BITS = 33


def _once(c: Column) -> Column:
    """c as a generated column: it is worked out once a row, however many filters and columns use it."""
    return F.explode(F.array(c))


def _lines(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_metadata.file_path").alias("log_file"), F.col("_metadata.file_block_start").alias("log_block"), F.col("value").alias("line"))


def parse(lines: DataFrame, schema: str, batch: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, broken) of lines (log_file, log_block, line): records have the schema's columns and those of PLACE, broken ones PLACE
    and the line. Blank lines are neither. A line that is no object, or has a value of another type, is broken.

    A block of a file is read by one task in order, so row numbers that rise within tasks order its lines; blocks are ordered by where
    they start. Nothing is shuffled.
    """
    whole = lines.where(F.trim("line") != "").withColumn("log_row", F.monotonically_increasing_id()).withColumn("log_batch", F.lit(batch).cast("long"))
    read = whole.withColumn("__r", _once(F.from_json("line", f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})))
    fails = F.col("__r").isNull() | F.col("__r.__broken").isNotNull()
    return read.where(~fails).select("__r.*", *PLACE).drop("__broken"), read.where(fails).select(*PLACE, "line")


def read_log(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, broken) of JSON-lines files; see parse()."""
    return parse(_lines(spark.read.text(paths)), schema)


def last_wins(records: DataFrame, keys: list[str]) -> DataFrame:
    """The last record of each key, by PLACE. Rows of a key meet as partial maxima, so a key of many records is no hot task. Records
    without a key are left out."""
    named = records.dropna(subset=keys)
    rest = [c for c in records.columns if c not in keys and c not in PLACE]
    last = F.max_by(F.struct(*rest, *PLACE), F.struct(*PLACE)).alias("__last")
    return named.groupBy(*keys).agg(last).select(*keys, "__last.*").select(*[c for c in records.columns if c not in PLACE], *PLACE)


def with_pass(records: DataFrame, name: str = PASS_NAME) -> DataFrame:
    """Adds policy and pass (1 where the name has none) from the names of files; rows of files named otherwise are left out."""
    path = F.substring_index("log_file", "/", -2) if name == PASS_NAME else F.col("log_file")  # all that this pattern can match
    found = F.struct(F.regexp_extract(path, name, 1).alias("policy"), F.regexp_extract(path, name, 2).alias("number"))
    out = records.withColumn("__name", _once(found)).withColumn("policy", F.col("__name.policy")).where(F.col("policy") != "")
    return out.withColumn("pass", F.when(F.col("__name.number") == "", 1).otherwise(F.col("__name.number").try_cast("int"))).drop("__name")


def pass_table(records: DataFrame, key: str = "prompt_id", value: str = "logprob") -> DataFrame:
    """(policy, key, pass, value): a row for each key of a policy's first pass and each pass the policy has, null where that pass has
    no record or none with a value. The last record of (policy, pass, key) counts.

    Records are parsed once and written. Blocks of files are ranked (a row a block, broadcast), so a record's place is one number and
    last records need no sort. A key's passes come together in one shuffle; the list of a policy's passes is a row a policy, broadcast.
    """
    held = written(records.select("policy", "pass", key, value, *PLACE), "passes")
    blocks = held.select(*PLACE[:3]).distinct().withColumn("__block", F.row_number().over(W.orderBy(*PLACE[:3])).cast("long"))
    place = F.shiftleft("__block", _ROW_BITS) + F.col("log_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    named = held.dropna(subset=["policy", "pass", key]).join(F.broadcast(blocks), PLACE[:3])
    last = named.groupBy("policy", "pass", key).agg(F.max_by(value, place).alias(value))
    known = F.broadcast(held.groupBy("policy").agg(F.sort_array(F.collect_set("pass")).alias("__passes")))
    own = last.groupBy("policy", key).agg(F.map_from_entries(F.collect_list(F.struct("pass", value))).alias("__v")).where(F.map_contains_key("__v", F.lit(1)))
    return own.join(known, "policy").select("policy", key, "__v", F.explode("__passes").alias("pass")).select("policy", key, "pass", F.try_element_at("__v", F.col("pass")).alias(value))


def still_due(work: DataFrame, records: DataFrame, key: str = "prompt_id", finished: Column | None = None) -> DataFrame:
    """Rows of work whose key has no finished record; a later record that isn't finished opens its key again."""
    last = last_wins(records, [key])
    return due(work, last if finished is None else last.where(finished), key)


def follow(spark: SparkSession, source: str, schema: str, table: str, quarantine: str, checkpoint: str, files_a_batch: int = 1000) -> None:
    """Takes all files of a folder that have not been taken yet into table and quarantine, then stops.

    What was taken is in the checkpoint. A batch writes its own folder anew, so one that was cut off and runs again leaves nothing twice:
    neither a lost executor nor a killed driver loses or repeats a record. The three places must be on storage that all executors share.
    """

    def take(batch: DataFrame, number: int) -> None:
        records, broken = parse(batch, schema, number)
        records.write.mode("overwrite").parquet(f"{table}/batch={number}")
        broken.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    stream = _lines(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(source))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def taken(spark: SparkSession, table: str) -> DataFrame:
    """The records (or broken lines) that follow() took, in all batches."""
    return spark.read.parquet(table).drop("batch")
