"""Lines that many documents share are kept in one of them (operator 9). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, saved, unused


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, shared): every line long enough as (doc_id, tie, pos, h1, h2), and the hashes found in min_docs documents or more.

    h1, h2: two 64-bit hashes of the key, 128 bits together. shared has the largest doc_id of each and its number of lines.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("tie"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("lines"))
    at = rows.select("doc_id", "tie", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key("line")).where(F.length("key") >= min_chars)
    lines = saved(at.select("doc_id", "tie", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2")), "lines")
    counted = lines.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n_rows"))
    return lines, counted.where(F.col("n_docs") >= min_docs)


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with text reassembled from the lines that stay, plus n_lines (before) and n_dropped.

    Lines are exploded, normalised and hashed; distinct documents are counted by hash (Spark counts by
    (hash, document) first, so a line that all documents have is no hot key); lines whose key has
    min_chars code points or more and stands in min_docs documents or more go, except all of those in the
    largest doc_id that has it. The others stay in their order, joined by \\n.

    A null or empty text is one empty line; a null text stays null. Rows with the same id are one document
    in counts, and each keeps its own lines. A null id doesn't count as a document, and its shared lines go.
    Other columns pass; columns called as n_lines or n_dropped are replaced.
    """
    lines, shared = shared_lines(docs, min_chars, min_docs, doc_id, text)
    own = docs.drop(*{n_lines, n_dropped} - {doc_id, text})
    id_, tie, gone_, parts_ = unused(own, "__id", "__tie", "__gone", "__lines")
    gone = dropped(lines, shared).groupBy("doc_id", "tie").agg(F.collect_set("pos").alias("gone")).select(F.col("doc_id").alias(id_), F.col("tie").alias(tie), F.col("gone").alias(gone_))
    joined = own.join(gone.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(tie)), "left")
    parts = joined.withColumn(parts_, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts_) - 1), F.col(gone_))
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts_, i)), "\n")
    out = parts.withColumn(text, F.when(F.col(gone_).isNull(), F.col(text)).otherwise(kept))
    out = out.withColumn(n_lines, F.size(parts_).cast("long")).withColumn(n_dropped, F.coalesce(F.size(gone_), F.lit(0)).cast("long"))
    return out.drop(id_, tie, gone_, parts_)


#: A hash that makes up more than one in so many lines is broadcast, so at most so many hashes are.
HOT_SHARE = 1000


def dropped(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """The lines of shared hashes, but for those of the document that keeps them.

    A very common line would bring its rows to one task of a shuffle; such hashes, HOT_SHARE at most, are looked up by a broadcast
    where the lines lie, and only the others are shuffled.
    """
    shared, least = saved(shared, "shared-lines"), lines.count() // HOT_SHARE
    hot, rare = shared.where(F.col("n_rows") > least), shared.where(F.col("n_rows") <= least)
    found = lines.join(F.broadcast(hot), ["h1", "h2"]).unionByName(lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(rare, ["h1", "h2"]))
    return found.where(~F.col("doc_id").eqNullSafe(F.col("last")))
