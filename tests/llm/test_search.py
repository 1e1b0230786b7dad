"""Ranked lexical search: against scores of all pairs, and the trees' bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assayframe.llm import search

SCHEMA = "doc_id long, text string, item_id string, score double, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
r = random.Random(8)
WORDS = ["".join(r.choice("abcdeÉñ漢7") for _ in range(r.randint(1, 5))) for _ in range(150)]


def _say(n):
    return " ".join(WORDS[min(int(r.expovariate(0.05)), 149)] + r.choice(["", ".", "-x", "_"]) for _ in range(n))


DOCS = [(i, _say(r.randint(1, 80)), "x", 0.5, 3) for i in range(400)]
DOCS += [(500, None, None, None, None), (501, "", "x", 0.5, 3), (502, " .,-_\x7f\x00 ", "x", 0.5, 3), (503, _say(20_000), "x", 0.5, 3), (None, DOCS[3][1], "x", 0.5, 3), (None, DOCS[3][1], "x", 0.5, 3)]
DOCS += [(i, DOCS[5][1], "x", 0.5, 3) for i in (600, 590, 610, 610)] + [(700 + i, "ties " * (i % 3 + 1), "x", 0.5, 3) for i in range(60)]
ITEMS = [(i, _say(r.randint(1, 25))) for i in range(50)] + [(50, None), (51, ""), (52, "!!"), (53, "unheard wörds"), (54, DOCS[5][1]), (54, DOCS[5][1]), (55, "TIES ties"), (None, "ties"), (56, DOCS[7][1] + " " + DOCS[9][1])]


def _low(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def _all_pairs(docs, items, top=10):
    told = [(i, Counter(_low(t))) for i, t in docs]
    told = [(i, c, sum(c.values())) for i, c in told if c]
    n_docs, total, df = len(told), sum(x[2] for x in told), Counter(t for _, c, _ in told for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for i, c, n in told:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in _low(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores)[:top], 1):
            out[(item, rank, i, -score)] += 1
    return out


def test_leaves_without_a_score_that_can_enter():
    one = search.Search(search.Items([1], {b"a": 0}, [(np.array([0]), np.array([1]))]), np.array([5]), 10, np.array([1000]))
    one._keep(np.array([0, 0]), np.array([1, 2]), np.array([5, 6]))
    assert one.found[0][0].tolist() == [] and one.floors.tolist() == [1000]


@pytest.mark.parametrize("block_terms, partitions, top", [(10**6, 3, 10), (60, 2, 10), (10**6, 7, 1), (10**6, 1, 500)])
def test_rankings_against_all_pairs(spark, block_terms, partitions, top):
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(partitions)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter(tuple(x) for x in search.search(docs, items, top, block_terms).collect())
    assert got == _all_pairs([x[:2] for x in DOCS], ITEMS, top)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS[:3], SCHEMA), spark.createDataFrame(ITEMS[:3], "item_id long, text string")
    assert search.search(docs.limit(0), items).collect() == [] == search.search(docs, items.limit(0)).collect()
    assert search.search(spark.createDataFrame([(1, None, "", 0.0, 1)], SCHEMA), items).collect() == []


def _vectors(rng, n, terms, most):
    return [tuple(np.unique(rng.integers(0, terms, rng.integers(0, most)), return_counts=True)) for _ in range(n)]


def test_nodes_hold_coordinate_maxima_and_bound_all_products():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 40, 333):
        level = search._level(_vectors(rng, n, 30, 12))
        for size in (1, 4, 16):
            above = level.merged(size)
            assert above.rows == -(-n // size)
            for k in range(above.rows):
                most = {}
                for j in range(k * size, min(n, (k + 1) * size)):
                    for t, v in zip(level.terms[level.starts[j] : level.starts[j + 1]], level.values[level.starts[j] : level.starts[j + 1]]):
                        most[t] = max(most.get(t, 0), v)
                s, e = above.starts[k], above.starts[k + 1]
                assert dict(zip(above.terms[s:e], above.values[s:e])) == most
    docs, items = search._level(_vectors(rng, 40, 30, 12)), search._level(_vectors(rng, 20, 30, 12))
    pair = np.repeat(np.arange(40), 20), np.tile(np.arange(20), 40)
    each = search.Search._products(docs, pair[0], items, pair[1]).reshape(40, 20)
    bound = search.Search._products(docs.merged(4), np.repeat(np.arange(10), 5), items.merged(4), np.tile(np.arange(5), 10)).reshape(10, 5)
    assert (bound >= each.reshape(10, 4, 5, 4).max((1, 3))).all()


def test_most_pairs_of_nodes_are_never_opened(monkeypatch):
    """Clustered documents: what is scored is a small part of all pairs, and the best ones are still exact."""
    rng = np.random.default_rng(2)
    vectors = [(np.sort(rng.choice(np.arange(20 * (i % 50), 20 * (i % 50) + 20), 8, replace=False)), rng.integers(1, 900, 8)) for i in range(4000)]
    items = search.Items(list(range(50)), {b"%d" % t: t for t in range(1000)}, [(np.arange(20 * i, 20 * i + 20), np.ones(20, np.int64)) for i in range(50)])
    weights = np.full(1000, 7, np.int64)
    scored = []
    true = search.Search._scores
    monkeypatch.setattr(search.Search, "_scores", lambda self, docs, leaf, item: scored.append(len(leaf) * docs.leaf) or true(self, docs, leaf, item))
    found = list(search.Search(items, weights, 10, np.zeros(50, np.int64)).batch(search._level(vectors), np.arange(4000)))
    assert sum(scored) < 4000 * 50 / 10
    best = {}
    for i, place, score in found:
        best.setdefault(i, []).append((-score, place))
    for i in range(50):
        all_of = sorted((-7 * int(v.sum()), k) for k, (t, v) in enumerate(vectors) if t[0] // 20 == i)
        assert sorted(best[i]) == all_of[:10]
    floors = np.array([-all_of[9][0]] * 50)
    scored.clear()
    list(search.Search(items, weights, 10, np.full(50, 10**9)).batch(search._level(vectors), np.arange(4000)))
    assert not scored and floors.min() > 0
