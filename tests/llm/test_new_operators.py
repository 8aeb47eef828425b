"""Operators 11 to 13 on small tables with nulls, repeats, ties and clashing columns, against brute force."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kalibra.llm import clustering, crc, queries, resampling, warc
from kalibra.llm.common import scratch


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _features(t, n):
    w = _words(t)
    return [zlib.crc32(" ".join(w[i : i + m]).encode()) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def _texts():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["The", "cat's", "été", "on,", "mat", "naïve-ly", "x1", "ß" * 40, "w" * 90]) for _ in range(n))
    return [None, "", " \n\t!", "one", "ABC def", "foo", "bar", "w" * 9000 + " x", prose(3000), "\x00a`b{c", prose(20), prose(19)] + [prose(rng.randint(1, 60)) for _ in range(40)]


@pytest.mark.parametrize("length", [0, 1, 63, 64, 65, 4095, 4096, 70_000])
def test_crcs_of_joined_strings(length):
    rng = random.Random(length)
    a, b = rng.randbytes(7), rng.randbytes(length)
    got = crc.shifted(np.array([zlib.crc32(a), 0], np.uint32), np.array([length, 3]))
    assert int(got[0]) ^ zlib.crc32(b) == zlib.crc32(a + b) and got[1] == 0


def test_crcs_of_slices():
    data, rng = np.frombuffer(random.Random(1).randbytes(5000), np.uint8), random.Random(2)
    starts = np.array([rng.randrange(5000) for _ in range(300)])
    lengths = np.array([rng.choice([0, 1, 5, 63, 64, 65, 300]) for _ in range(300)])
    want = [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]
    lengths = np.minimum(lengths, 5000 - starts)
    assert crc.of_slices(data, starts, lengths).tolist() == want
    assert len(crc.of_slices(data, starts[:0], lengths[:0])) == 0


@pytest.mark.parametrize("n", [1, 2, 4])
@pytest.mark.parametrize("window", [1, 7, 50, 1 << 20])
def test_ngram_crcs_in_windows(n, window):
    got = collections.defaultdict(list)
    for _, doc, values in resampling.ngram_crcs(pa.array(_texts()).slice(1), n, window):
        for d, c in zip(doc.tolist(), values.tolist(), strict=True):
            got[d].append(c)
    for i, t in enumerate(_texts()[1:]):
        assert sorted(got[i]) == sorted(_features(t, n)), i


def _resampled(docs, target, min_words, percent, seed, n, buckets):
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for held, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in _features(x, n):
                held[f % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for i, x in docs:
        g = [gain[f % buckets] for f in _features(x, n)]
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        rows.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(x))))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[0]: k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(r[0])) for r in rows), key=str)


@pytest.mark.parametrize(("percent", "buckets"), [(25, 10_000), (60, 7)])
def test_resampling(spark, percent, buckets):
    docs, target = [(None if i == 20 else i, t) for i, t in enumerate(_texts())], ["the cat's mat", None, "", "x1 on x1"]
    df = spark.createDataFrame([(*d, "clash", 1, "clash", 2, "clash") for d in docs], "doc_id long, text string, rank string, score int, weight string, __text int, __id string").repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.draw(df, bench, percent=percent, buckets=buckets)
    assert set(out.columns) == {*df.columns, "n_words", "n_features"}
    rows = out.collect()
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows), key=str) == _resampled(docs, target, 20, percent, 7, 2, buckets)
    assert {r["text"] for r in rows} == set(_texts()) and {(r["__text"], r["__id"]) for r in rows} == {(2, "clash")}
    drawn = resampling.resampled(df, bench, percent=percent, buckets=buckets)
    assert drawn.count() == sum(r["rank"] is not None for r in rows) > 0
    assert resampling.draw(df.limit(0), bench).count() == 0
    lone = resampling.draw(df, bench.limit(0)).collect()
    assert len(lone) == len(docs)


def test_repeated_rows_are_drawn_as_documents(spark):
    text = " ".join(["the cat"] * 12)
    df = spark.createDataFrame([(7, text)] * 5 + [(8, text + " x")] * 3, "doc_id long, text string")
    rows = resampling.draw(df, df, percent=50, keep=["doc_id"]).collect()
    assert len(rows) == 8 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4]


def _clustered(vectors, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in start[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((gap(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        at = collections.defaultdict(list)
        for _, v in kept:
            at[near(v)[1]].append(v)
        for n, own in at.items():
            centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, c, d in placed:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in placed), key=str)


@pytest.mark.parametrize(("k", "dims", "scale"), [(16, 64, 1.0), (3, 4, 2.0), (16, 5, 90_000.0)])
def test_clustering(spark, k, dims, scale):
    rng = random.Random(k + dims)
    vectors = [(i, [float(np.float32(rng.gauss(0, 0.05) * scale + i % 5)) for _ in range(dims)]) for i in range(120)]
    vectors += [(200 + i, [0.0] * dims) for i in range(9)] + [(300, [1.0] * (dims - 1)), (301, None), (302, []), (303, [None] * dims), (304, [math.nan] * dims), (305, [math.inf] + [0.0] * (dims - 1)), (None, [0.5] * dims), (7, vectors[7][1])]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in vectors], "vec_id long, embedding array<float>, cluster int, v string").repartition(3)
    got = sorted((tuple(r) for r in clustering.cluster(df, k=k, dims=dims).collect()), key=str)
    assert got == _clustered(vectors, k, 3, dims)
    assert clustering.cluster(df.limit(0), k=k, dims=dims).count() == 0


@pytest.mark.parametrize("top", [1, 70, 5000, 1 << 20, 1 << 27])
def test_screening_never_loses_the_nearest(top):
    rng = np.random.default_rng(top)
    v, c = rng.integers(-top, top + 1, (2000, 64)), rng.integers(-top, top + 1, (16, 64))
    c[5] = c[9] = c[2]
    c[9, 0] -= 1
    v[:200], v[200:300], v[300:500] = c[2], c[9], (c[2] + c[7]) // 2
    at, d = clustering.nearest(v, c)
    full = np.square(v[:, None, :] - c[None]).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert clustering.limit(64) == 1 << 27 and 3 * (2 * clustering.limit(3)) ** 2 < 2**63


def test_huge_components_are_cut(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    rows = {r["vec_id"]: r for r in clustering.cluster(df, k=1, dims=2, rounds=0).collect()}
    assert rows[1]["distance"] == 0 or rows[2]["distance"] == 0
    assert max(rows[i]["distance"] for i in (1, 2)) == 2 * clustering.limit(2) ** 2


def _revisits(pages, least=0):
    groups = collections.defaultdict(list)
    for i, _, h in pages:
        groups[(h or "").encode()].append(i)
    out = []
    for body, ids in groups.items():
        last = max(ids) if len(body) >= least else None
        out += [(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *(("response", None) if last in (None, i) else ("revisit", last))) for i in ids]  # noqa: S324
    return sorted(out)


@pytest.mark.parametrize(("file_bytes", "least", "share"), [(64 << 20, 0, 1000), (4000, 2, 2)])
def test_pages_by_arc_to_warc(spark, monkeypatch, file_bytes, least, share):
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    rng = random.Random(3)
    bodies = [None, "", "x", "<p>É</p>", "a\r\n\r\nb\n\nHTTP/1.1 200 OK\r\n", "y" * 100_000, "filedesc://a 1.1.1.1 20000101000000 text/plain 5\n1 0 z\n", "WARC/1.1\r\n\r\n"]
    pages = [(i, rng.choice(["http://a b/ü x", "https://x/1", None, "ftp://z", "\n"]), rng.choice(bodies) if i % 3 else f"own {i}") for i in range(200)]
    df = spark.createDataFrame([(*p, "clash", 5) for p in pages], "page_id long, url string, html string, key string, record int").repartition(4)
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(df, arc, file_bytes=file_bytes)
    warc.convert(spark, arc, out, min_bytes=least, file_bytes=file_bytes)
    rows = warc.read_warc(spark, out).collect()
    assert sorted((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == _revisits(pages, least)
    ids = {r["record_id"]: r for r in rows}
    assert len(ids) == len(pages)
    for r in rows:
        if r["record_type"] == "revisit":
            named = ids[r["refers_to_id"]]
            assert (named["record_type"], named["key"], named["payload_digest"]) == ("response", r["refers_to"], r["payload_digest"])
        else:
            assert r["block"].endswith((pages[r["key"]][2] or "").encode())
    assert all(re.fullmatch(r"https?:\S+", r["url"]) and r["date"] == "2000-01-01T00:00:00Z" for r in rows)


def test_pages_without_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, None, "same"), (None, "http://x/", "same"), (3, "http://x/", "same"), (3, "http://x/", "same"), (4, None, "else")], "page_id long, url string, html string")
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(df, arc)
    warc.convert(spark, arc, out)
    got = collections.Counter((r["key"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, out).collect())
    assert got == {(3, "response", None): 1, (3, "revisit", 3): 1, (None, "revisit", 3): 2, (4, "response", None): 1}
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(df.limit(0), arc)
    warc.convert(spark, arc, out)
    assert warc.read_warc(spark, out).count() == 0


ARC1 = b"""filedesc://IA-1.arc 0.0.0.0 19960923142103 text/plain 76
1 0 Alexa Internet
URL IP-address Archive-date Content-type Archive-length

http://www.example.org:80/a b.html 127.10.100.2 19961104142103 text/html; charset=x 28
HTTP/1.0 200 OK\nA: b\n\n<html>
dns:example.org 127.0.0.1 199611041421 text/dns 11
20000101 IN
stray line
http://x/ 1.2.3.4 19969904142103 text/html 500
HTTP/1.0 200 OK\r\n\r\nshort"""
ARC2 = b"""filedesc://IA-2.arc 0.0.0.0 19960923142103 text/plain 200 - - 0 IA-2.arc 122
2 0 Alexa Internet
URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

http://y/ 1.2.3.4 19961104142103 text/html 404 fac069150613fe55599cc7fa88aa089d - 209 IA-2.arc 27
HTTP/1.0 404 No\r\n\r\n\xff\x00binary
"""


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, lambda x: b"".join(gzip.compress(x[i : i + 100]) for i in range(0, len(x), 100))])
def test_both_versions_of_arc(pack):
    rows = list(warc.arc_records(pack(ARC1), "f"))
    assert [(r["kind"], r["url"], r["date"], r["type"], r["payload"], r["truncated"]) for r in rows[1:]] == [
        ("response", "http://www.example.org:80/a b.html", "1996-11-04T14:21:03Z", "text/html; charset=x", b"<html>", False),
        ("resource", "dns:example.org", "1996-11-04T14:21:00Z", "text/dns", b"20000101 IN", False),
        ("resource", f"f#{ARC1.index(b'stray')}", "1970-01-01T00:00:00Z", "application/octet-stream", b"stray line\n", False),
        ("response", "http://x/", "1970-01-01T00:00:00Z", "text/html", b"short", True),
    ]
    assert rows[0]["kind"] == "warcinfo" and rows[0]["payload"].endswith(b"length\n\n")
    (head, page) = warc.arc_records(pack(ARC2), "g")
    assert (head["kind"], page["kind"], page["payload"], page["payload_bytes"]) == ("warcinfo", "response", b"\xff\x00binary", 8)
    back = list(warc.warc_records(pack(b"".join(warc.warc_record(r) + b"\r\n\r\n" for r in [*rows, head, page])), "h"))
    assert [r["payload_digest"] for r in back] == [r["digest"] for r in [*rows[1:], page]]
    assert [r["record_type"] for r in back] == ["response", "resource", "resource", "response", "response"]


def test_broken_archives_are_told():
    good = warc.warc_record(next(iter(list(warc.arc_records(ARC2, "g"))[1:]))) + b"\r\n\r\n"
    for bad in (good[:-20], b"nothing", good.replace(b"binary", b"BINARY")):
        with pytest.raises(ValueError):
            list(warc.warc_records(bad, "h"))
    half = gzip.compress(ARC1)[:-30]
    assert len(list(warc.arc_records(half, "f"))) >= 1
    assert list(warc.arc_records(b"", "f")) == []


def test_arc_with_other_bytes_through_spark(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(ARC1)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(ARC2))
    out = scratch(spark, "warc")
    warc.convert(spark, f"file://{tmp_path}", out)
    rows = warc.read_warc(spark, out).collect()
    assert sorted(r["record_type"] for r in rows) == ["resource", "resource", "response", "response", "response"]
    assert any(r["block"].endswith(b"\xff\x00binary") for r in rows)


def test_queries_are_their_operators(spark):
    sf = "/root/testdata/sf0.001"
    pages = [(r["page_id"], None, r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_warc(spark, sf).collect()) == _revisits(pages)
    vectors = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op12_clustering(spark, sf).collect()), key=str) == _clustered(vectors, 16, 3, 64)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op11_resampling(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == _resampled(docs, target, 20, 25, 7, 2, 10_000)
    assert queries.op11_resampling(spark, sf).where(F.col("rank").isNotNull()).count() > 0
