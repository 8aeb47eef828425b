"""Parts without Spark, against plain Python."""

import itertools
import math
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kalibra.llm import classifier, crf, decontaminate, jaccard, packing, sharding, shingles, token_files, tokens

BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("text", ["", " ", "It's a test, isn't it?", "<|endoftext|> x<|ENDOFTEXT|>", "ΣΑΣ é É don't!!! 12ab  \x1c y ﬁ ½ª ß ẞ İi", "''s 's' a'll... ́ é", "naïve café x", "数字 123 ٣"])
def test_ids_are_the_library_s(text):
    assert tokens.Encoder(BPE).encode(text.encode()) == np.array(Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_small_memo_gives_the_same_ids():
    rng = random.Random(1)
    small, large = tokens.Encoder(BPE, keep=3), tokens.Encoder(BPE)
    for _ in range(50):
        text = " ".join(rng.choice(["The", "cat,", "sat.", "on", "mats!", "éa"]) for _ in range(20)).encode()
        assert small.encode(text) == large.encode(text)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = tokens.Encoder(path)
    assert not e.by_chunk
    assert e.encode(b"  two  words ") == np.array(Tokenizer.from_file(path).encode("  two  words ", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("top", [1, 255, 256, 65_535, 65_536, 2**32 - 1])
def test_codes_round_trip(top):
    ids = np.random.default_rng(0).integers(0, top, 3000, dtype=np.uint64, endpoint=True).astype(np.uint32)
    c = token_files.Codes(token_files.encode_codes(ids))
    assert len(c) == 3000 and (c.slice(0, 3000) == ids).all()
    for i in (0, 7, 511, 512, 513, 1024, 2999):
        assert c[i] == ids[i]
    for a, b in ((0, 0), (5, 700), (511, 513), (2990, 3000)):
        assert (c.slice(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        c[3000]


def test_no_codes():
    assert len(token_files.Codes(token_files.encode_codes(np.zeros(0, np.uint32)))) == 0
    with pytest.raises(ValueError):
        token_files.Codes(b"XXXX")


def test_plan_places_everything_once_with_little_room():
    rng = random.Random(2)
    histogram = {n: rng.randint(1, 500) for n in rng.sample(range(1, 2049), 900)}
    plans = packing.plan(histogram, 2048)
    placed = {n: 0 for n in histogram}
    for count, pattern in plans:
        assert sum(pattern) <= 2048
        for n in pattern:
            placed[n] += count
    assert placed == histogram
    assert sum(n * c for n, c in histogram.items()) / (2048 * sum(c for c, _ in plans)) > 0.97
    assert packing.plan({}, 8) == []
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_fisher_yates_is_a_seeded_permutation():
    a = sharding.fisher_yates(100, 3, 4)
    assert sorted(a) == list(range(100)) and (a == sharding.fisher_yates(100, 3, 4)).all() and (a != sharding.fisher_yates(100, 3, 5)).any()
    firsts = [int(sharding.fisher_yates(4, s, 0)[0]) for s in range(4000)]
    assert all(abs(firsts.count(i) - 1000) < 120 for i in range(4))


def _plain(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def test_shingles_count_as_sets_do(monkeypatch):
    rng = random.Random(3)
    texts = [b" ".join(rng.choice([b"a", b"B", b"cc", "é".encode(), b"\xc3\x89"]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, b"", b" \n", b"x" * 5000 + b" a b c d"]
    for block in (1 << 20, 64):
        monkeypatch.setattr(shingles, "BLOCK", block)
        sets = [shingles.shingle_set(w, 3) for w in shingles.word_hashes(texts)]
        assert [len(s) for s in sets] == [len(_plain(t or b"", 3)) for t in texts]
        for i, j in itertools.combinations(range(30), 2):
            assert len(np.intersect1d(sets[i], sets[j])) == len(_plain(texts[i], 3) & _plain(texts[j], 3))


@pytest.mark.parametrize("t", [80, 90])
def test_pairs_share_a_cell(t):
    rng = random.Random(4)
    for _ in range(400):
        x = set(rng.sample(range(10**9), rng.randint(3, 300)))
        y = set(x)
        for _ in range(rng.randint(0, (100 - t) * len(x) // 100 + 2)):
            if rng.random() < 0.5 and len(y) > 1:
                y.remove(rng.choice(sorted(y)))
            else:
                y.add(rng.randrange(10**9))
        if x != y and 100 * len(x & y) >= t * len(x | y):
            a, b = (np.unique(shingles.mix(np.array(sorted(s), np.uint64))) for s in (x, y))
            for seed in (0, 3):
                assert set(jaccard.cells(a, t, seed).tolist()) & set(jaccard.cells(b, t, seed).tolist())


@pytest.mark.parametrize("t", [80, 90])
def test_sketches_tie_all_links(t):
    rng = random.Random(24)
    sets = []
    for _ in range(12):
        base = [rng.randrange(10**12) for _ in range(rng.choice([5, 20, 60, 140, 300]))]
        for _ in range(8):
            y = [x for x in base if rng.random() > 0.1]
            sets.append(np.unique(shingles.mix(np.array(y + [rng.randrange(10**12) for _ in range(rng.randint(0, len(base) // 12 + 1))], np.uint64))))
    tied = jaccard.Forest(len(sets))
    for i, j in jaccard.tie(np.array(list(map(len, sets))), [jaccard.sketch(u, t) for u in sets], t):
        tied.link(i, j)
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        linked = 100 * both >= t * (len(sets[i]) + len(sets[j]) - both)
        assert not linked or tied.root(i) == tied.root(j)
    assert len({tied.root(i) for i in range(len(sets))}) >= 12


@pytest.mark.parametrize("t", [80, 90])
def test_regions_give_the_components_of_all_pairs(t):
    rng = random.Random(5)
    sets = []
    for _ in range(15):
        base = [rng.randrange(10**12) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 40)):
            y = list(base)
            for _ in range(rng.randint(0, len(y) // 6)):
                y[rng.randrange(len(y))] = rng.randrange(10**12)
            sets.append(np.unique(np.array(y, np.uint64)))
    rng.shuffle(sets)
    want = jaccard.Forest(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= t * (len(sets[i]) + len(sets[j]) - both):
            want.link(i, j)
    got = jaccard.join_sets(sets, t)
    assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def _smith_waterman(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(0, h[i - 1][j - 1] + (decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH), h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
    return max(map(max, h))


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = (rng.integers(0, 5, rng.integers(1, 25)) for _ in range(2))
        score, end = decontaminate.align(a, b)
        assert math.isclose(score, _smith_waterman(a.tolist(), b.tolist()))
        assert math.isclose(_smith_waterman(a.tolist(), b[:end].tolist()), score)


def test_no_alignment_scores_more_than_its_bound():
    rng = np.random.default_rng(16)
    for words in (5, 40):
        for _ in range(100):
            a, b = (rng.integers(0, words, rng.integers(1, 60)).astype(np.uint64) for _ in range(2))
            assert decontaminate.align(a, b)[0] <= decontaminate.most(a, b) + 1e-9


@pytest.mark.parametrize("segment", [2, 3, 64])
def test_forward_backward_is_the_sum_over_paths(monkeypatch, segment):
    monkeypatch.setattr(crf, "SEGMENT", segment)
    rng = np.random.default_rng(7)
    k, lengths = 3, np.array([1, 7, 3, 4, 6])
    scores, trans, start = rng.normal(size=(lengths.sum(), k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
    probs, moves = crf.forward_backward(scores, lengths, trans, start)
    want, want_moves, at = np.zeros_like(probs), np.zeros((k, k)), 0
    for n in lengths:
        own, pair, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
        for y in itertools.product(range(k), repeat=int(n)):
            w = np.exp(start[y[0]] + sum(scores[at + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            for i in range(n):
                own[i, y[i]] += w
            for i in range(n - 1):
                pair[y[i], y[i + 1]] += w
        want[at : at + n], want_moves, at = own / total, want_moves + pair / total, at + n
    assert np.allclose(probs, want) and np.allclose(moves, want_moves)


def test_evidence_finds_the_word_that_tells():
    rng = random.Random(8)
    texts, y = [], []
    for i in range(400):
        words = [rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = "rotten!"
        texts.append(" ".join(words).encode())
        y.append(float(i % 4 == 0))
    rows = list(classifier.slots_and_shape(texts))
    e = classifier.fit_evidence(rows, np.array(y))
    assert all((e.of(*r) > 0) == (v == 1) for r, v in zip(rows, y, strict=True))
    assert classifier.fit_evidence([], np.zeros(0)).of(*rows[0]) == 0
    assert struct.calcsize("<I") == 4
