"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.llm import decontaminate, jaccard, line_dedup, packing, quality
from kalibra.llm.common import saved, unused

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: a null or empty text among them. Rows are judged one by one, repeated ones alike; an empty table stays empty."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them; n_chars follows the text. Rows of one id are one document, a null
    text stays null, and every column of docs passes, whatever its name."""
    before, gone = unused(docs, "__lines_before", "__lines_gone")
    out = line_dedup.drop_shared_lines(docs, n_lines=before, n_dropped=gone).drop(before, gone)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id: shingles of five words, similarity of 0.8 or more.
    Texts without words and rows without an id stay; rows of one id go or stay together."""
    return jaccard.keep_one(docs, k=5, t=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none, and rows without an id are judged by their text."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in sequences of 2048: a row a piece. A null or empty text is its end token; repeated rows are packed as often as they are."""
    pieces = packing.cut(docs, public_tokenizers.path(TOKENIZER), limit=2048, end_id=1)
    pieces = saved(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pipeline-pieces")
    return packing.pack(pieces, limit=2048).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination), ("packing", pack_sequences),
]

#: Packing's order of patterns and the distances of histograms are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
