"""Deleted interpolation: against counts of plain Python, and the mixture's own properties."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from assayframe.llm import counting, language_model

SCHEMA = "doc_id long, text string, score double, held_out string, slice long"
r = random.Random(11)
WORDS = ["".join(r.choice("abcdéÉñ") for _ in range(r.randint(1, 3))) for _ in range(60)]


def _say(n):
    return " ".join(WORDS[min(int(r.expovariate(0.08)), 59)] for _ in range(n))


ROWS = [(i, _say(r.randint(1, 60)), 0.0, "x", 7) for i in range(120)]
ROWS += [(200, None, None, None, None), (201, "", 0.0, "x", 7), (202, " \t\n\x0b\x0c\r ", 0.0, "x", 7), (203, "A\x1cb a B  İ É", 0.0, "x", 7), (203, "A\x1cb a B  İ É", 0.0, "x", 7)]
ROWS += [(None, "no id at all", 0.0, None, 7), (None, None, None, None, None), (204, ROWS[0][1], 0.0, "x", 7), (205, _say(5000), 0.0, "x", 7)]


def _tokens(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def _grams(rows, order):
    counts = [Counter() for _ in range(order)]
    for _, t in rows:
        told = ["<s>"] * order + _tokens(t)
        for at in range(order, len(told)):
            for n in range(order):
                counts[n][tuple(told[at - n : at + 1])] += 1
    return counts


def _by_hand(rows, order, model):
    train = [x for x in rows if not _held(x[0])]
    counts, docs = _grams(train, order), len(train)
    total, vocabulary = sum(counts[0].values()), len(counts[0])
    assert (model.tokens, model.vocabulary, model.documents) == (total, vocabulary, docs)
    out = []
    for i, t in rows:
        told, base, score, known = ["<s>"] * order + _tokens(t), 0.0, 0.0, 0
        for at in range(order, len(told)):
            c = counts[0][(told[at],)]
            known += c > 0
            base += math.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1)))
            bucket, parts = 64, [1 / (vocabulary + 1), c / total if total else 0.0]
            for n in range(1, order):
                context = tuple(told[at - n : at])
                seen = docs if set(context) == {"<s>"} else counts[n - 1][context]
                if seen:
                    bucket = 64 * (n + 1) + seen.bit_length()
                parts.append(counts[n][tuple(told[at - n : at + 1])] / seen if seen else 0.0)
            score += math.log10(sum(w * p for w, p in zip(model.weights.get(bucket) or model.default(bucket), parts)))
        out.append((i, _held(i), len(told) - order, known, total, round(base, 6), round(score, 6)))
    return Counter(out)


@pytest.mark.parametrize("order, slice_tokens", [(1, 10**6), (2, 10**6), (2, 100), (3, 300)])
def test_scores_against_counts_by_hand(spark, order, slice_tokens):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    slices, model = language_model.resolved(docs, order, slice_tokens=slice_tokens)
    got = Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in language_model.scored(slices, model).collect())
    assert got == _by_hand([x[:2] for x in ROWS], order, model)
    assert model.weights and all(abs(sum(w) - 1) < 1e-9 for w in model.weights.values())


def test_weights_come_from_the_deleted_part(spark):
    """The histogram of held-out events is that of plain counts, and the weights are its likeliest."""
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    slices, model = language_model.resolved(docs, 2, slice_tokens=500)
    part = lambda i: language_model.part_of(i, 5, 1)
    assert {part(i) == language_model.HELD_OUT for i in range(50) if _held(i)} == {True} and part(None) == language_model.KEPT
    kept = [x[:2] for x in ROWS if part(x[0]) == language_model.KEPT]
    one, two = _grams(kept, 2)
    events = Counter()
    for i, t in (x[:2] for x in ROWS if part(x[0]) == language_model.DELETED_PART):
        told = ["<s>", *_tokens(t)]
        for v, w in zip(told, told[1:]):
            seen = len(kept) if v == "<s>" else one[(v,)]
            events[(128 + seen.bit_length() if seen else 64, one[(w,)], two[(v, w)] / seen if seen else 0.0)] += 1
    told = Counter()
    for row in slices.collect():
        for cell, n in zip(row.events, row.n_events):
            told[cell >> 22] += n
    assert told == Counter({b: sum(n for (k, _, _), n in events.items() if k == b) for b in {k[0] for k in events}})
    total, vocabulary = sum(one.values()), len(one)
    for b, weights in model.weights.items():
        own = [(np.array([1 / (vocabulary + 1), c / total, p]), n) for (k, c, p), n in events.items() if k == b]
        likely = lambda w: sum(n * math.log(float(g @ w)) for g, n in own)
        best = likely(np.array(weights))
        usable = b // 64 + 1
        for _ in range(30):
            other = np.zeros(3)
            other[:usable] = np.random.default_rng(_).dirichlet(np.ones(usable))
            assert likely(other) <= best + 0.5 + 0.02 * sum(n for _, n in own)


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(1)
    p = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.2, 0.6, 0.1]])
    n = rng.multinomial(200_000, 0.3 * p[0] + 0.7 * p[1])
    weights = language_model.expectation_maximisation(p.T, n, 1)
    assert abs(weights[0] - 0.3) < 0.02 and abs(weights.sum() - 1) < 1e-9
    assert language_model.expectation_maximisation(np.array([[0.5, 0.0]]), np.array([1000]), 1)[1] > 0  # never zero


def test_probabilities_of_all_words_sum_to_one():
    counts = Counter({"a": 5, "b": 3, None: 2})
    model = language_model.Model(1, 10, 3, 2, {64: [0.2, 0.8]})
    seen = model.probabilities([np.array([5, 3, 2])], np.array([True, False, False])).sum()
    unseen = model.probabilities([np.array([0])], np.array([True])).sum()
    assert sum(counts.values()) == 10 and abs(seen + unseen - 1) < 1e-12


def test_no_training_documents_and_empty_tables(spark):
    held = [i for i in range(40) if _held(i)][:3]
    docs = spark.createDataFrame([(i, "some words here", 0.0, "x", 1) for i in held], SCHEMA)
    for x in language_model.score(docs).collect():
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (4, 0, 0, True) and x.base_score == 0 and x.score == 0
    assert language_model.score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_model.score(docs).filter("held_out").collect()
    assert len(rows) > 100 and sum(x.score for x in rows) > 0.9 * sum(x.base_score for x in rows)
    assert sum(x.score for x in rows) > sum(x.base_score for x in rows)
    assert sum(x.score > x.base_score for x in rows) > 0.9 * len(rows)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for top in (1, 200, 70_000, 2**40, 2**64 - 1):
        keys = np.unique(rng.integers(0, top, 1000, dtype=np.uint64, endpoint=True))
        assert (counting.unpack_sorted(counting.pack_sorted(keys)) == keys).all() and (counting.unpack(counting.pack(keys)) == keys).all()
    assert len(counting.unpack(counting.pack(np.empty(0, np.int64)))) == 0


def test_long_texts_are_split_where_words_end(monkeypatch):
    text = ("Ab c\td  " * 50).encode()
    whole = [w for some in language_model.words(text) for w in some]
    monkeypatch.setattr(language_model, "PIECE_BYTES", 7)
    assert [w for some in language_model.words(text) for w in some] == whole == text.lower().split()
