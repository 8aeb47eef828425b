"""Operators on a small table with nulls, empty and long texts, copies, ties and clashing columns, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kalibra.llm import classifier, crf, decontaminate, jaccard, line_dedup, packing, quality, sharding, token_counts, token_files
from kalibra.llm.common import saved, scratch
from kalibra.llm.components import components

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, __key int, __id int, __tie string, __slice int, __bucket string, __gone int, __q_words string, __q_lang int, __q_row string, __q_kept int"
VOCABULARY = ["the", "and", "of", "to", "in", "that", "house", "river", "walked", "slowly", "Morning", "light,", "over", "hills.", "café", "naïve", "stone", "garden", "winter", "sea"]


def _texts():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    shared = "This very line is shared by many documents."
    base = prose(90)
    near = base.split()
    near[40] = "changed"
    out = [None, "", "  \n\t ", "a", "one two", base, base, base.upper(), " ".join(near), prose(3000), "x" * 70_000 + " " + prose(5)]
    out += [f"{prose(30)}\n{shared}\n{prose(20)}" for _ in range(4)] + [f"  {shared.upper()} \nonly here {i}" for i in range(2)]
    out += ["same same same same same same same same same same same same", "!!! ### $$$ %%% &&& *** ||| <<< >>> ### ### ### $$$ %%%" * 3, "\n\n" + shared + "\n"]
    return out + [prose(rng.randint(5, 200)) for _ in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "src0" if i % 3 else None, None if t is None else len(t), "clash", i, i, "clash", i, "clash", i, "clash", i, "clash", i) for i, t in enumerate(_texts())]
    return saved(spark.createDataFrame(rows, SCHEMA).repartition(3), "fixture")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _ids(text):
    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards(spark, docs, empty):
    path = scratch(spark, "t")
    sharding.write_shards(docs, path, 8, bucket_bytes=20_000)
    rows = sharding.read_shards(spark, path, docs.schema).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in rows) == [(i, t or "") for i, t in enumerate(_texts())]
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = scratch(spark, "t")
    sharding.write_shards(docs.repartition(5), again, 8, bucket_bytes=20_000)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.read_shards(spark, again, docs.schema).collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    none = scratch(spark, "t")
    sharding.write_shards(empty, none)
    assert sharding.read_shards(spark, none, empty.schema).count() == 0


def test_packing(docs, empty):
    pieces = saved(packing.cut(docs.union(docs.where("doc_id = 5")), BPE, limit=64, end_id=1), "t")
    rows = packing.pack(pieces.withColumn("offset", F.lit("clash")), limit=64).collect()
    want = collections.Counter((i, s, _crc(x[s : s + 64])) for i, t in [*enumerate(_texts()), (5, _texts()[5])] for x in [[*_ids(t), 1]] for s in range(0, len(x), 64))
    assert collections.Counter((r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in rows) == want
    at = collections.defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in at.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 64
    assert sorted(at) == list(range(len(at)))
    assert packing.pack(packing.cut(empty, BPE)).count() == 0


def test_token_files(spark, docs, empty):
    path = scratch(spark, "t")
    token_files.write_tokens(docs, path, BPE, end_id=2, segment_tokens=500)
    start = 0
    rows = token_files.read_documents(spark, path).orderBy("doc_id").collect()
    assert len(rows) == len(_texts())
    for r, t in zip(rows, _texts(), strict=True):
        ids = [*_ids(t), 2]
        assert (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (start, len(ids), _crc(ids))
        start += len(ids)
    none = scratch(spark, "t")
    token_files.write_tokens(empty, none, BPE)
    assert token_files.read_documents(spark, none).count() == 0


def test_token_counts_fill_and_use_the_cache(spark, docs, empty, monkeypatch):
    path = scratch(spark, "t")
    want = {i: (len((t or "").encode()), len(_ids(t))) for i, t in enumerate(_texts())}
    for _ in range(2):
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, path, BPE).collect()} == want
        held = spark.read.parquet(path)
        assert held.count() == held.select("digest").distinct().count()  # the second run has added nothing
    assert token_counts.count_tokens(docs.union(docs), path, BPE).count() == 2 * len(want)
    assert token_counts.count_tokens(empty, scratch(spark, "t"), BPE).count() == 0
    monkeypatch.setattr(token_counts, "HOT_SHARE", 10)
    many = docs.where("doc_id in (1, 5)").crossJoin(spark.range(20)).drop("id").unionByName(docs)
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(many, path, BPE).collect()) == collections.Counter({(i, n): 21 if i in (1, 5) else 1 for i, (_, n) in want.items()})


def _key(line):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def test_line_dedup(docs, empty):
    lines = {i: (t or "").split("\n") for i, t in enumerate(_texts())}
    held = collections.defaultdict(set)
    for i, own in lines.items():
        for x in own:
            held[_key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    assert gone
    out = line_dedup.drop_shared_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    for r in out.collect():
        kept = [x for x in lines[r["doc_id"]] if gone.get(_key(x), r["doc_id"]) == r["doc_id"]]
        assert (r["text"] or "") == "\n".join(kept) and (r["n_lines"], r["n_dropped"]) == (len(lines[r["doc_id"]]), len(lines[r["doc_id"]]) - len(kept))
        assert (r["text"] is None) == (_texts()[r["doc_id"]] is None)
    assert line_dedup.drop_shared_lines(empty).count() == 0


def _counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered |= set(range(i, i + 5))
    worded = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(worded) - len(set(worded)), len(covered)


def _distance(p, q):
    part = lambda x, m: x * math.log2(x / m) if x else 0.0
    return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q, strict=True)) / 2))


def _classes(t):
    upper, (digits, stops) = sum(c.isupper() for c in t), (len(re.findall(p, t)) for p in ("[0-9]", r"[.,;:!?'\"()-]"))
    space, others = len(re.findall(r"[\x20\x09-\x0D]", t)), sum(not (c.islower() or c in " \t\n\x0b\x0c\r") for c in t)
    return [space, len(t) - space - others, upper, digits, stops, others - upper - digits - stops]


def test_quality_rules(docs, empty):
    texts, langs = _texts(), [["en", "fr", ""][i % 3] for i in range(len(_texts()))]
    classes, words = collections.defaultdict(lambda: [0] * 6), collections.defaultdict(collections.Counter)
    for t, lang in zip(texts, langs, strict=True):
        classes[lang] = [a + b for a, b in zip(classes[lang], _classes(t or ""), strict=True)]
        words[lang].update(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    top = {k: sorted(((w, n) for w, n in c.items() if len(w) <= 5 and w.isalpha()), key=lambda x: (-x[1], x[0]))[:16] for k, c in words.items()}
    judged, columns = quality.judge(docs), docs.columns
    assert quality.result_prefix(docs) == "___q_" and judged.columns == [*columns, *[f"___q_{c}" for c in quality.RESULTS]]
    assert [tuple(r) for r in judged.select(*columns).orderBy("doc_id").collect()] == [tuple(r) for r in docs.orderBy("doc_id").collect()]
    for r in judged.collect():
        i, lang, t = r["doc_id"], langs[r["doc_id"]], texts[r["doc_id"]] or ""
        got = _counts(t)
        assert tuple(r[f"___q_{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == got, i
        base = got[0] < 10 or 100 * got[4] > 20 * got[0]
        total, own = sum(words[lang].values()), collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", t))
        far = False
        if len(t) >= 100:
            d = _distance([x / len(t) for x in _classes(t)], [x / sum(classes[lang]) for x in classes[lang]])
            assert math.isclose(r["___q_class_distance"], d, abs_tol=1e-9)
            far |= d > 0.22
        if got[0] >= 60:
            p, q = [own[w] / got[0] for w, _ in top[lang]], [n / total for _, n in top[lang]]
            d = _distance([*p, 1 - sum(p)], [*q, 1 - sum(q)])
            assert math.isclose(r["___q_word_distance"], d, abs_tol=1e-6)
            far |= d > 0.25 + 0.15 / math.sqrt(got[0])
        assert r["___q_base_failed"] == base and r["___q_kept"] == (not base and not far)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in judged.collect() if r["___q_kept"]}
    moved = docs.withColumnRenamed("text", "__q_text").withColumnRenamed("lang", "__Q_mine")
    assert quality.keep_good(moved, text="__q_text", lang="__Q_mine").count() == kept.count()
    assert quality.judge(empty).count() == 0


def _components(texts, k, t):
    def shingles(x):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

    sets = [shingles(x) for x in texts]
    least = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= t * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    return sets, least


@pytest.mark.parametrize(("k", "t", "sizes"), [(3, 90, {"task_shingles": 300, "region_sets": 2}), (5, 80, {})])
def test_jaccard_join(docs, empty, k, t, sizes):
    sets, least = _components(_texts(), k, t)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, k, t, **sizes).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in range(len(sets))}
    if k == 5:
        kept = jaccard.keep_one(docs, k, t)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(len(sets)) if least[i] == i}
        assert jaccard.near_duplicates(empty, k, t).count() == 0


@pytest.mark.parametrize(("k", "t", "task_shingles", "region_sets"), [(3, 90, 1_500, 30), (5, 80, 400, 3)])
def test_large_regions_are_parted_exactly(spark, k, t, task_shingles, region_sets):
    """Groups of edited copies, some just within and some just beyond a link, and a passage that half of all share."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage, texts = [word() for _ in range(30)], []
    for group in range(6):
        base = [word() for _ in range(rng.randint(25, 70))] + (passage if group % 2 else [])
        for _ in range(25 if group < 2 else 6):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [" ".join([word() for _ in range(rng.randint(3, 30))] + passage) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    _, least = _components(texts, k, t)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, k, t, task_shingles=task_shingles, region_sets=region_sets).collect()}
    assert got == dict(enumerate(least))


def test_rows_without_id_and_repeated_rows(spark):
    text = "one two three four five six"
    rows = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text), (None, "else entirely")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in jaccard.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(-1, 3), (7, 3), (7, 3), (3, 3), (-1, None)], key=str)
    assert token_counts.count_tokens(rows, scratch(spark, "t"), BPE).count() == 5
    assert line_dedup.drop_shared_lines(rows).count() == 5


def test_components_of_a_path(spark):
    n = 40
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}


def test_decontamination(spark, empty):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(30)] for _ in range(3)] + [["too", "short"]]
    edited = list(items[0])
    for i in (4, 11, 17, 26):
        edited[i] = word()
    del edited[20]
    filler = lambda n: " ".join(word() for _ in range(n))
    texts = [filler(50) + " " + " ".join(items[0]) + " " + filler(9), filler(20) + " " + " ".join(edited).upper() + "! " + filler(70), filler(80), None, "", ", ".join(items[1]), " ".join(items[2][:8]) + filler(30), "É " + " ".join(items[1]) + " " + " ".join(items[2]), "too short"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (5, 1), (7, 1), (7, 2)}
    assert got[0, 0]["score"] == 1 and (got[0, 0]["start"], got[0, 0]["end"]) == (50, 80) and 0.6 < got[1, 0]["score"] < 1
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()) == [2, 3, 4, 6, 8]
    assert decontaminate.contaminated(empty, bench).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()


@pytest.mark.parametrize(("exact", "near"), [(0, 20), (2, 40)])
def test_decontamination_of_an_edited_item_in_many_documents(spark, exact, near):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(42)]
    edited = [word() if i % 7 == 3 else w for i, w in enumerate(item)]
    filler = lambda n: [word() for _ in range(n)]
    texts = [filler(40) + t + filler(12) for t in [item] * exact + [edited] * near] + [filler(90)]
    texts.append(filler(30) + item[7:10] + filler(30))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert sorted(got) == list(range(exact + near))
    assert all(got[i] == 1 for i in range(exact)) and all(0.7 < got[i] < 0.9 for i in range(exact, exact + near))
    assert decontaminate.keep_clean(docs, bench).count() == 2


def test_passages_of_long_items_and_short_items(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    item = words(400)
    texts = [words(30) + item[100:250] + words(30), words(30) + item[200:212] + words(30), words(9) + ["two,", "Words"] + words(9), ["two", "x", "words", "single"], ["single"], []]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "two words"), (2, "Single!"), (3, "...")], "item_id long, text string")
    found = lambda **p: {(r["doc_id"], r["item_id"], r["score"], r["start"], r["end"]) for r in decontaminate.contaminated(docs, bench, **p).collect()}
    assert found() == {(0, 0, 0.375, 30, 180)}
    assert found(short_items=True) == {(0, 0, 0.375, 30, 180), (2, 1, 1.0, 9, 11), (3, 2, 1.0, 3, 4), (4, 2, 1.0, 0, 1)}


def test_language_tags(spark, empty):
    rng = random.Random(13)
    words = {"aa": ["kara", "baka", "maka", "raka"], "oo": ["dolo", "moto", "zovo", "pogo"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang, 20), lang) for i in range(60) for lang in ("aa", "oo")]
    tests = [(100, text("aa", 500), None), (101, text("oo", 3), None), (102, text("aa", 12) + " " + text("oo", 30), None), (103, None, None), (104, "123 !!", None), (105, "", "aa")]
    schema = "doc_id long, text string, lang string"
    learn, ask = spark.createDataFrame(rows, schema), spark.createDataFrame(tests, schema)
    got = {r["doc_id"]: r for r in crf.tag_languages(ask, learn).collect()}
    assert [got[i]["lang"] for i in range(100, 106)] == ["aa", "oo", "oo", "und", "und", "und"]
    assert abs(got[102]["n_switched"] - 12) <= 1 and got[103]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert crf.tag_languages(empty, empty).count() == 0


def test_every_language_is_learned_and_repeats_count_once(spark, monkeypatch):
    rng = random.Random(18)
    words = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3)] for i in range(68)}
    text = lambda name: " ".join(rng.choice(words[name]) for _ in range(12))
    rows = [(k * 100 + i, text(name), name) for i, name in enumerate(words) for k in range(6)]
    schema, fitted, fit = "doc_id long, text string, lang string", [], crf.fit_field
    monkeypatch.setattr(crf, "fit_field", lambda sample: fitted.append(sample) or fit(sample))
    learn = spark.createDataFrame(rows + [(None, rows[0][1], rows[0][2])] * 500, schema)
    ask = spark.createDataFrame([(i, text(name), None) for i, name in enumerate(words)], schema)
    got = {r["doc_id"]: r["lang"] for r in crf.tag_languages(ask, learn).collect()}
    assert got == dict(enumerate(words))
    assert len(fitted[0]) == len(rows) + 1  # the repeated row once


def test_classifier_samples_repeated_rows_once(spark, monkeypatch):
    sizes, fit = [], classifier.fit_evidence
    monkeypatch.setattr(classifier, "fit_evidence", lambda sample, y: sizes.append(len(y)) or fit(sample, y))
    docs = spark.createDataFrame([(i, "h", "p", f"text {i}") for i in range(5)] + [(7, "h", "p", "the same")] * 300, "doc_id long, host string, path string, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (0, 1, 2, 3, 4, 7)], "doc_id long, quality int, toxic int")
    assert classifier.classify(docs, labels, sample_rows=6).count() == 305
    assert sizes == [6, 6]


def test_classifier_shrinks_sparse_sites(spark, empty):
    rng = random.Random(14)
    rows, marks = [], []
    for i in range(600):
        good = i % 4 != 0
        rows.append((i, " ".join(rng.choice(["calm", "clear", "plain"]) for _ in range(20)) + ("" if good else " spam"), f"h{i % 2 if good else 2}", f"p{i % 5}"))
        marks.append((i, int(good), None))
    rows += [(600, "calm clear", "new", "p"), (601, None, None, None), (602, "spam calm", "h0", "p9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in classifier.classify(docs, labels).collect()}
    assert len(got) == 603 and all((got[i]["quality"] >= 0.5) == (i % 4 != 0) for i in range(600))
    assert math.isclose(got[600]["quality_path"], 0.75) and got[1]["quality_host"] > 0.95 and got[0]["quality_host"] < 0.05
    assert math.isclose(got[602]["quality_path"], got[602]["quality_host"]) and got[602]["quality_evidence"] < 0 and got[600]["toxic"] == 0.5
    assert classifier.classify(empty.withColumnRenamed("source", "host").withColumnRenamed("lang", "path"), labels).count() == 0


def test_pipeline_stages_are_their_operators(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(_texts()[-1].split()[:30])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = held.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in held.collect()}
        held = saved(stage(spark, held, str(tmp_path)), "t")
        assert held.columns == columns and {r["doc_id"] for r in held.collect()} <= before
    kept = {r["doc_id"]: r["text"] for r in held.collect()}
    assert len(_texts()) - 1 not in kept and 6 not in kept and 5 in kept
    lengths = collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: len(_ids(t)) + 1 for i, t in kept.items()}
    assert hashlib.sha256(b"").hexdigest()


def test_pipeline_of_no_documents_and_of_rows_without_ids(spark, docs, empty, tmp_path):
    for name, rows in (("none", empty), ("nulls", docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).unionByName(docs.where("doc_id = 5")))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, "two words"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(out) == 0) == (name == "none")
