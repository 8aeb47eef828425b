"""The opN queries: each operator with production parameters on its whole table."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, clustering, crf, decontaminate, jaccard, line_dedup, packing, quality, resampling, sharding, token_counts, token_files, warc
from .common import saved, scratch

TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), scratch(spark, "shards")
    sharding.write_shards(docs, path, n_shards=8)
    rows, text = sharding.read_shards(spark, path, docs.schema), F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), limit=2048, end_id=1)
    pieces = saved(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(pieces, limit=2048).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), scratch(spark, "token-cache"), public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    prefix = quality.result_prefix(docs)
    return quality.judge(docs).select("doc_id", *[F.col(f"{prefix}{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_shared_lines(documents(spark, sf_dir))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), k=3, t=90)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))  # a document without an id isn't held out
    tagged = crf.tag_languages(docs, docs.where(~held_out))
    return tagged.select("doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score", "n_words", "n_switched")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources, and a host's paths its languages: documents have no finer address."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = classifier.classify(documents(spark, sf_dir), labels, host="source", path="lang")
    return out.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.draw(documents(spark, sf_dir), target, keep=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, path = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    warc.convert(spark, arc, path)
    return warc.read_warc(spark, path, blocks=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """op12 in plain integers: each round compares every vector with every centroid."""
    near = """{a} as (select vec_id, any_value(v) as v, arg_min(c, (d, c)) as c, min(d) as d from (select w.vec_id, w.v, x.c, list_sum(list_transform(list_zip(w.v, x.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from whole w cross join {c} x) group by vec_id)"""
    mean = """{m} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from (select c, i, sum(v[i]) as s, count(*) as n from {a}, range(1, 65) t(i) group by c, i) group by c),
{to} as (select o.c, coalesce(m.v, o.v) as v from {c} o left join {m} m on m.c = o.c)"""
    steps = ["whole as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64)"]
    steps.append(f"c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as c, v from whole qualify c < {k})")
    for i in range(rounds + 1):
        steps.append(near.format(a=f"a{i}", c=f"c{i}"))
        if i < rounds:
            steps.append(mean.format(m=f"m{i}", a=f"a{i}", c=f"c{i}", to=f"c{i + 1}"))
    last = f"select a.vec_id, a.c::int as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(x.v, ',')) as centroid_sha256 from a{rounds} a join c{rounds} x on x.c = a.c"
    return "with " + ",\n".join(steps) + "\n" + last


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {5 * g + 1}, 5))::int >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_shards, op3_language_id, op4_jaccard_join, op5_packing, op6_quality_rules, op7_quality_classifier, op8_token_files, op9_line_dedup, op10_token_counts, op11_resampling, op12_clustering, op13_warc)
}
#: The others need a tokenizer, a hash or a model that SQL lacks; tests hold them against brute force.
ORACLE_SQL = {
    "op9_line_dedup": """with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.doc_id, k.line, k.pos, s.key is not null and k.doc_id <> s.last as gone from keyed k left join shared s on s.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from marked group by doc_id""",
    "op12_clustering": _clustering_sql(),
    "op13_warc": f"""with held as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex, max(page_id) over (partition by coalesce(html, '')) as last from pages)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from held""",
}
