"""Quality rules: counts of a text, and its distance from its language's usual histograms (operator 6).

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, saved

#: Characters that count as symbols; characters of sentences.
SYMBOLS, STOPS = r"[#*$%&|<>]", r"[.,;:!?'\"()-]"


def split_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_CLASS + "+"))


def repeated_words(words: Column, windows: Column) -> Column:
    """Words in windows of five that stand twice or more in the text. windows: a hash of each window, by its first word.

    Where all hashes differ there is none. Otherwise windows are sorted by hash, those with an equal
    neighbour repeat, and each covers what lies before the next one's first word, five words at most.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
        return F.get(F.transform(F.array(at), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b)), F.lit(0))

    found = F.get(F.transform(F.array(placed), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(found).cast("long")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """The counts of each document: those of the base rules, its class histogram and its words, in columns beginning with __q_."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__q_words", split_words(F.col(text)))
    n = F.size("__q_words")
    df = df.withColumn("__q_windows", F.when(n < 5, F.array().cast("array<bigint>")).otherwise(F.slice(F.transform("__q_words", lambda _, i: F.xxhash64(F.slice(F.col("__q_words"), i + 1, 5))), F.lit(1), n - 4)))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "")
    df = df.withColumn("__q_lines", lines)
    count = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("long")
    df = df.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("__q_words"), n.cast("long").alias("__q_n_words"),
        F.length(F.array_join("__q_words", "")).cast("long").alias("__q_word_chars"), count(SYMBOLS).alias("__q_n_symbols"),
        (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("__q_n_dup_lines"),
        repeated_words(F.col("__q_words"), F.col("__q_windows")).alias("__q_n_repeat_words"),
        F.length(body).cast("long").alias("__q_chars"), count(r"\p{Lu}").alias("__q_upper"), count("[0-9]").alias("__q_digits"), count(STOPS).alias("__q_stops"),
        count(r"[^\p{Ll}\x20\x09-\x0D]").alias("__q_others"),
    )
    c = {k: F.col(f"__q_{k}") for k in ("chars", "word_chars", "upper", "digits", "stops", "others")}
    classes = F.array(c["chars"] - c["word_chars"], c["word_chars"] - c["others"], c["upper"], c["digits"], c["stops"], c["others"] - c["upper"] - c["digits"] - c["stops"])
    language = F.coalesce(F.col(lang), F.lit("")) if lang else F.lit("")
    base = (F.col("__q_n_words") < 10) | (100 * F.col("__q_n_repeat_words") > 20 * F.col("__q_n_words"))
    return df.withColumn("__q_classes", classes).withColumn("__q_lang", language).withColumn("__q_base_failed", base).drop("__q_chars", "__q_upper", "__q_digits", "__q_stops", "__q_others")


def references(docs: DataFrame, n_common: int = 16, common_chars: int = 5, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """One row a language: shares of the six character classes, its n_common commonest words and their shares.

    Counted over all documents, in two readings; words of up to common_chars letters compete (function words are short).
    Counts are added up before anything is shuffled. A null language is a language of its own.
    """
    language = F.coalesce(F.col(lang), F.lit("")) if lang else F.lit("")
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(body, F.lit(pattern))
    # classes and words apart: after an explode Spark would count a text's classes anew for each of its words
    chars = docs.select(language.alias("__q_lang"), F.length(body).alias("n"), count(SPACE_CLASS).alias("space"), count(r"\p{Lu}").alias("upper"), count("[0-9]").alias("digits"), count(STOPS).alias("stops"), count(r"[^\p{Ll}\x20\x09-\x0D]").alias("others"))
    s = chars.groupBy("__q_lang").agg(*[F.sum(F.col(k).cast("double")).alias(k) for k in ("n", "space", "upper", "digits", "stops", "others")])
    s = s.where(F.col("n") > 0).select("__q_lang", F.transform(F.array(F.col("space"), F.col("n") - F.col("space") - F.col("others"), F.col("upper"), F.col("digits"), F.col("stops"), F.col("others") - F.col("upper") - F.col("digits") - F.col("stops")), lambda x: x / F.col("n")).alias("__q_ref_classes"))
    words = docs.select(language.alias("__q_lang"), F.explode(split_words(F.col(text))).alias("word"))
    own = words.select("__q_lang", F.when(F.octet_length("word") <= 4 * common_chars, F.when((F.length("word") <= common_chars) & F.col("word").rlike(r"^\p{L}+$"), F.col("word"))).alias("word"))
    counts = saved(own.groupBy("__q_lang", "word").count(), "word-counts")  # two steps read it
    totals = counts.groupBy("__q_lang").agg(F.sum("count").alias("total"))
    top = counts.where(F.col("word").isNotNull()).withColumn("rank", F.row_number().over(W.partitionBy("__q_lang").orderBy(F.desc("count"), "word"))).where(F.col("rank") <= n_common)
    top = top.join(totals, "__q_lang").groupBy("__q_lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", (F.col("count") / F.col("total")).alias("share")))).alias("top"))
    return s.join(top, "__q_lang", "left").select("__q_lang", "__q_ref_classes", F.col("top.word").alias("__q_ref_words"), F.col("top.share").alias("__q_ref_shares"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / F.when(m > 0, m).otherwise(1.0))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))


#: What judge() adds, after its prefix.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def result_prefix(docs: DataFrame) -> str:
    """What the columns that judge() adds begin with: __q_, with more underscores before it where docs has columns that begin so."""
    prefix = "__q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns that begin with __q_ under other names, and all names now by names before."""
    held, names = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        new = c
        while new.lower().startswith("__q_") or (new != c and new.lower() in held):
            new = f"q{new}"
        held.add(new.lower())
        names[c] = new
    return docs.select(*[F.col(f"`{c}`").alias(new) for c, new in names.items()]), names


#: Up to so many languages their references are broadcast (some hundred bytes each); beyond it they are joined.
BROADCAST_LANGUAGES = 10_000


def judge(docs: DataFrame, class_limit: float = 0.22, word_limit: float = 0.25, min_chars: int = 100, min_words: int = 60, n_common: int = 16, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """docs and, after result_prefix(docs), the columns RESULTS: __q_n_words, __q_word_chars, __q_n_symbols, __q_n_dup_lines, __q_n_repeat_words,
    __q_base_failed, __q_class_distance, __q_word_distance and __q_kept.

    Base rules: fewer than 10 words, or more than a fifth of the words in repeated windows of five, fail.
    Then a document's histogram of character classes, and that of its language's common words, are held
    against the language's own (references) by Jensen-Shannon distance; over class_limit or word_limit the
    document is rejected. A distance is judged only from min_chars characters or min_words words on, and
    the word limit is wider for short texts, whose counts scatter: by 0.15 over the root of n_words.

    A null text is empty and fails. A text in a language without references (no row has one) passes the
    distances. Each row is judged alone, repeated or not; all columns of docs pass, whatever their names.
    """
    prefix, (docs, names) = result_prefix(docs), _aside(docs)
    text, lang = names.get(text, text), names.get(lang, lang)
    refs = saved(references(docs, n_common, text=text, lang=lang), "references")  # a row a language
    own = measured(docs, doc_id, text, lang)
    own = own.join(F.broadcast(refs) if refs.count() <= BROADCAST_LANGUAGES else refs, "__q_lang", "left")
    total = F.aggregate("__q_classes", F.lit(0).cast("long"), lambda a, b: a + b)
    own = own.withColumn("__q_shares", F.transform("__q_classes", lambda x: x / F.greatest(total, F.lit(1))))
    n_words = F.greatest(F.col("__q_n_words"), F.lit(1))  # divisions by zero raise errors
    common = F.filter("__q_words", lambda w: F.array_contains(F.col("__q_ref_words"), w))
    own = own.withColumn("__q_common", common)
    found = F.transform("__q_ref_words", lambda r: F.size(F.filter("__q_common", lambda w: w == r)) / n_words)
    with_rest = lambda a, rest: F.concat(a, F.array(rest))
    rest = lambda a: F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda x, y: x + y))
    own = own.withColumn("__q_found", found)
    own = own.withColumn("__q_class_distance", F.when(total >= min_chars, js_distance(F.col("__q_shares"), F.col("__q_ref_classes"))))
    words = js_distance(with_rest(F.col("__q_found"), F.lit(1.0) - F.size("__q_common") / n_words), with_rest(F.col("__q_ref_shares"), rest(F.col("__q_ref_shares"))))
    own = own.withColumn("__q_word_distance", F.when(F.col("__q_n_words") >= min_words, words))
    far = (F.coalesce(F.col("__q_class_distance"), F.lit(0.0)) > class_limit) | (F.coalesce(F.col("__q_word_distance"), F.lit(0.0)) > word_limit + 0.15 / F.sqrt(n_words))
    own = own.withColumn("__q_kept", ~F.col("__q_base_failed") & ~far)
    return own.select(*[F.col(f"`{new}`").alias(c) for c, new in names.items()], *[F.col(f"__q_{c}").alias(f"{prefix}{c}") for c in RESULTS])


def keep_good(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that judge() keeps, with the columns of docs."""
    prefix = result_prefix(docs)
    # the filter looks at a column that depends on the row's place, so it is not moved below the counts, which it would repeat
    judged = judge(docs, **parameters).withColumn(f"{prefix}row", F.monotonically_increasing_id())
    return judged.where(F.col(f"{prefix}kept") & (F.col(f"{prefix}row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
