"""Packing, exact and near duplicates, repeats: against brute-force versions on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayframe.llm import exact_dedup, packing, repeats, simhash
from assayframe.llm.components import components

TOKENIZER = path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, n long, score double"
random.seed(5)
WORDS = ["".join(random.choice("abcdeéñ") for _ in range(random.randint(2, 7))) for _ in range(300)]
LONG = " ".join(random.choice(WORDS) for _ in range(30_000))


def _text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = _text(200, 1)
ROWS = [
    (1, "Hello, World! It's 3,000.5 ### &&&", "en", 1, 0.1),
    (2, None, None, None, None),
    (3, "", "en", 0, None),
    (4, "  \t\n", "en", 3, 0.0),
    (5, BASE, "en", 5, 0.2),
    (6, BASE.upper().replace("É", "é").replace("Ñ", "ñ"), "en", 5, 0.2),
    (7, BASE, None, 5, 0.9),
    (7, BASE, None, 5, 0.9),
    (8, BASE.replace(WORDS[3], "changed"), "en", 5, 0.3),
    (9, LONG, "de", 9, 0.5),
    (10, "ΣΑΣ İstanbul  x\x1cy <|endoftext|> 漢字", "el", 2, 0.5),
    (None, "no id here at all", "en", 2, 0.5),
    (None, "no id here at all", "en", 2, 0.5),
    (11, "one two", "en", 2, 0.5),
    (12, _text(250, 2) + " " + BASE[:600] + " " + _text(50, 3), "en", 2, 0.5),
    (13, "ab" * 400, "en", 2, 0.5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_pieces_hold_every_id_once(docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(packing.tokenise(docs, TOKENIZER), 256).collect()
    expected = Counter()
    for doc_id, text, *_ in ROWS:
        expected[(doc_id, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    got, parts = Counter(), {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert len(p.ids) == 4 * p.length and 0 < p.length <= 256
        key = (p.doc_id, p.sequence_id, p.offset)
        if p.start == 0:
            done = [bytes(p.ids)]
        else:
            done.append(bytes(p.ids))
        parts[key] = 1
        if sum(map(len, done)) == 4 * p.doc_tokens:
            got[(p.doc_id, b"".join(done))] += 1
    assert got == expected
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert sorted(filled) == list(range(len(filled)))
    assert all(filled[s] == 256 for s in list(filled)[:-1])


def test_packed_sequences_are_padded(docs):
    pieces = packing.pack(packing.tokenise(docs.filter("doc_id in (1, 5)"), TOKENIZER), 64)
    rows = packing.sequences(pieces, 64).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 256 or (r.n_tokens & (r.n_tokens - 1)) == 0 for r in rows)
    assert sum(r.n_tokens for r in rows) == pieces.agg(F.sum("length")).first()[0]


def test_packing_an_empty_table(empty):
    assert packing.pack(packing.tokenise(empty, TOKENIZER)).collect() == []


def _lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_against_brute_force(docs):
    rows = exact_dedup.DigestIndex(docs.sparkSession).add(docs).collect()
    groups = {}
    for doc_id, text, *_ in ROWS:
        groups.setdefault(_lowered(text), []).append(doc_id)
    expected = Counter()
    for text, ids in groups.items():
        keep, seen = max((i for i in ids if i is not None), default=None), Counter()
        for i in ids:
            seen[i] += 1
            expected[(i, keep, len(ids), i == keep and seen[i] == 1, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == expected


def test_exact_dedup_keeps_an_index_between_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "A"), (8, "c"), (7, "c")], "doc_id long, text string")
    assert {r.doc_id for r in index.add(first, 0).filter("kept").collect()} == {1, 2}
    decided = {r.doc_id: (r.keep_id, r.kept) for r in index.add(second, 1).collect()}
    assert decided == {9: (1, False), 8: (8, True), 7: (8, False)}
    assert {r.doc_id: (r.keep_id, r.kept) for r in index.add(second, 1).collect()} == decided
    assert index.table().count() == 3


def test_exact_dedup_stage_keeps_columns_and_one_row_each(docs, empty):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    texts = Counter(_lowered(r.text) for r in kept.collect())
    assert set(texts.values()) == {1} and len(texts) == len({_lowered(r[1]) for r in ROWS})
    assert exact_dedup.deduplicate(empty).collect() == []


def _fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", _lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> k & 1 for h in hashes) * 2 > len(hashes)) << k for k in range(64))


def _components(fps, ids, most):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= most and label[a] != label[b]:
                    label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
                    changed = True
    least = {}
    for i, x in zip(ids, label):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [least.get(x) for x in label]


@pytest.mark.parametrize("crowd", [100_000, 1])
def test_simhash_components(spark, crowd):
    r = random.Random(4)
    words = _text(60, 9).split()
    rows = [(None, ""), (100, None), (101, "one two"), (101, "one two")]
    for i in range(60):
        w = list(words)
        for _ in range(i % 4):
            w[r.randrange(60)] = r.choice(WORDS)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, fp string, node long").repartition(3)
    fps = [_fingerprint(t) for _, t in rows]
    expected = Counter(zip([i for i, _ in rows], fps, _components(fps, [i for i, _ in rows], 4)))
    got = Counter((x.doc_id, x.fp & (1 << 64) - 1, x.component_id) for x in simhash.near_duplicates(df, crowd=crowd).collect())
    assert got == expected


def test_similar_texts_are_grouped_and_one_stays(spark):
    r = random.Random(8)
    rows = []
    for g in range(20):
        words = _text(150, 100 + g).split()
        for c in range(3):
            w = list(words)
            for _ in range(2 if c else 0):  # at most 10 of 146 shingles differ
                w[r.randrange(150)] = f"changed{r.random()}"
            rows.append((10 * g + c, " ".join(w), "x"))
    rows += [(1000, None, "x"), (1001, "", "x"), (1001, "", "x"), (None, "lonely words", "x"), (None, "other lonely words", "x"), (None, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    found = {x.doc_id: x.component_id for x in simhash.similar(df).collect()}
    assert all(found[10 * g + c] == 10 * g for g in range(20) for c in range(3))
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == [*[(False, 10 * g) for g in range(20)], (False, 1000), (True, 0), (True, 0)]


def _shingled(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("block", [simhash.BLOCK_WEIGHT, 3000])
def test_similar_texts_link_by_exact_similarity(spark, block):
    """Pairs just above and below 0.8, and a large group whose members are near to its least one or to another."""
    r, rows = random.Random(3), []
    for g in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(120 + g)]
        goal, other, at = r.choice([0.72, 0.76, 0.79, 0.8, 0.82, 0.84]), list(words), 0
        while True:  # whole pieces from the front, until the next word would go below the goal
            changed = [*[f"x{r.randrange(10**6)}" for _ in range(at + 1)], *words[at + 1 :]]
            a, b = _shingled(" ".join(words)), _shingled(" ".join(changed))
            if len(a & b) < goal * len(a | b):
                break
            other, at = changed, at + 1
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    base = [f"b{k}" for k in range(200)]
    for c in range(60):  # words are replaced from the end on, up to a fifth of all
        rows.append((5000 + c, " ".join([*base[: 200 - c], *[f"y{c}_{k}" for k in range(c)]])))
    sets = {d: _shingled(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and abs(a - b) <= 60 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    head = {d: d for d in sets}
    for a, b in sorted(links * 8):
        head[a] = head[b] = min(head[a], head[b])
    assert 40 < sum(head[2 * g] == head[2 * g + 1] for g in range(150)) < 110
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert [d for d in sets if got[d] != head[d]] == []


def test_near_duplicates_of_an_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.deduplicate(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(20)}}


def _repeats(texts, depth):
    count = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - depth + 1):
            if count[t[i : i + depth]] > 1:
                gone[i : i + depth] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        yield len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])


@pytest.mark.parametrize("crowd", [2_000, 2])
def test_repeated_windows(spark, crowd):
    r = random.Random(1)
    core = _text(60, 77)[:230]
    rows = [x[:2] for x in ROWS if x[0] != 9] + [(20 + i, _text(40, i) + core[i % 5 :] + _text(40, 50 + i)) for i in range(20)] + [(90, "a" * 199), (91, "é" * 150)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, key string").repartition(4)
    got = repeats.remove_repeats(df, crowd=crowd).collect()
    expected = Counter((i, *x) for (i, _), x in zip(rows, _repeats([(t or "").encode() for _, t in rows], 200)))
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), bytes(x.kept)) for x in got) == expected
    assert r


def test_repeats_in_an_empty_table(empty):
    assert repeats.remove_repeats(empty).collect() == []


def test_piece_encoder_equals_tokenizer():
    tokenizer, own = Tokenizer.from_file(TOKENIZER), packing.PieceEncoder(TOKENIZER)
    texts = [t or "" for _, t, *_ in ROWS] + ["it's ''s 'RE", "a\x85b\xa0c", "½²٣", "ß ŉ İ ſ ǆ", "é J̌"]
    for t in texts:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.encode([t]) == [ids], t
    assert zlib.crc32(b"") == 0
