"""Components: any graph against a union of nodes, and plans that stay small however many rounds there are."""

from __future__ import annotations

import random
import re

import numpy as np

from kalibra.llm import components as module
from kalibra.llm import jaccard


def _least(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    loose = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    return {x: root(x) for x in up if x not in loose}


def _components(spark, edges):
    return {r["node"]: r["component"] for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_components_of_hubs_paths_and_stars(spark, monkeypatch):
    """Hubs that are joined to one another, a long path, repeated edges both ways, loops, negative nodes."""
    rng = random.Random(5)
    names = rng.sample(range(-5000, 5000), 3000)
    hubs, path, rest = names[:4], names[4:40], names[40:]
    edges = [(h, x) for i, h in enumerate(hubs) for x in rest[i * 300 : (i + 1) * 300 + (i % 2)]]
    edges += list(zip(path, path[1:], strict=False)) + [(b, a) for a, b in zip(path, path[1:], strict=False)]
    edges += [tuple(rng.sample(rest[1300:], 2)) for _ in range(900)] + [(9000, 9000), (names[0], names[0])]
    rng.shuffle(edges)
    for one_in in (5, 100, 1000):  # hubs and others, and none that is a hub or few that are not
        monkeypatch.setattr(module, "HUBS", one_in)
        assert _components(spark, edges) == _least(edges)


def test_no_edges(spark):
    assert _components(spark, []) == {} and _components(spark, [(3, 3)]) == {}


def test_plans_of_stars_stay_small(spark, monkeypatch):
    """What is written in a round is an aggregation or the joins of one star; plans of whole rounds (some twenty joins each) took the driver's memory."""
    plans, saved = [], module.saved

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return saved(df, name)

    monkeypatch.setattr(module, "saved", seen)
    path = list(range(60))
    random.Random(3).shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(100, x) for x in range(101, 2500)]
    assert _components(spark, edges) == _least(edges)
    assert len([name for name, _ in plans if name == "stars"]) > 1
    for name, plan in plans:
        assert len(re.findall(r"\bJoin\b", plan)) <= 3 and len(re.findall(r"\bAggregate\b", plan)) <= 1, (name, plan)


def test_stars_need_no_round(spark, monkeypatch):
    names, saved = [], module.saved
    monkeypatch.setattr(module, "saved", lambda df, name: names.append(name) or saved(df, name))
    edges = [(0, x) for x in range(1, 50)] + [(60, 61)]
    assert _components(spark, edges) == _least(edges)
    assert "stars" not in names


def test_ties_of_a_task_hang_on_their_least(spark):
    """A path of sets over several regions, each like the next only, comes as one star."""
    sizes = [10 + i for i in range(12)]
    sets = [np.arange(n, dtype=np.uint64) << np.uint64(56) for n in sizes]
    drawn = spark.createDataFrame([(100 - i, len(u), bytearray(jaccard.sketch(u, 90).tobytes())) for i, u in enumerate(sets)], "d1 long, n long, sketch binary")
    regions = spark.createDataFrame([(7, 100 - i) for i in range(12)], "head long, d1 long")
    ties = {(r["a"], r["b"]) for r in jaccard.tied_by_sketches(regions, drawn, 90).collect()}
    assert ties and not {a for a, _ in ties} & {b for _, b in ties} and all(b < a for a, b in ties)
    least = {}
    for a, b in ties:
        assert least.setdefault(a, b) == b


def test_plans_of_the_join_stay_small(spark, monkeypatch):
    """A chain of texts, each near to the next only, that pivots part, and copies of one text: all joined, and no plan holds a whole round."""
    rng, plans = random.Random(8), []

    def seen(df, name, saved=module.saved):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return saved(df, name)

    monkeypatch.setattr(module, "saved", seen)
    monkeypatch.setattr(jaccard, "saved", seen)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] * 40
    for i in range(12):  # four of 58 windows go a step: 54 of 62 are shared, after two steps 50 of 66, which is no link
        words = words[4:] + [f"new{i}x{j}" for j in range(4)]
        texts.append(" ".join(words))
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[x]) for i, x in enumerate(order)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, 3, 80, region_sets=4, task_shingles=200).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(58)} for t in texts]
    edges = [(i, j) for i, x in enumerate(order) for j, y in enumerate(order) if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    want = {i: i for i in got} | _least(edges)
    assert got == want and len(set(want.values())) == 1
    for name, plan in plans:
        assert len(re.findall(r"\bJoin\b", plan)) <= 6, (name, plan)
