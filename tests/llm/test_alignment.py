"""Cross-tokenizer alignment: against a merge of plain lists, one document at a time."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from assayframe.llm import alignment

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, slice string, score double"
r = random.Random(4)
ODD = [None, "", " ", "  a", "a  ", "a b", "é  b c", "▁ x", "x▁y ok", "\x00 a\x00b", " lead", "tail ", "\n a\n b\t c  d", "<|endoftext|> </s> <s> x <0x41>", "12 345 it's  ok 漢字 ☃", "a\x1c b \x1c c", "  x \xa0y", "ab" * 3000, "İ ﬁ é"]
TEXTS = ODD + ["".join(r.choice("ab .,\n\t é漢'1s▁") for _ in range(r.randint(1, 60))) for _ in range(300)] + [" ".join(r.choice(["the", "cat", "Straße", "naïve,", "12"]) for _ in range(4000))]
ROWS = [(i, t, "x", "y", 0.5) for i, t in enumerate(TEXTS)] + [(5, "a b", None, None, None), (5, "a b", None, None, None), (None, "no id", "x", "y", None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def by_hand():
    tokenizer, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in visible)}
    spell = {i: bytes(letters[c] for c in t) for t, i in tokenizer.get_vocab().items() if all(c in letters for c in t)}

    def one(text):
        whole = (" " + (text or "")).encode()
        if not text:
            return 0, 0, "", []
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        a_bytes = [spell[i] for i in a]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return 0, 0, "", []
        ends_a, ends_b = np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()
        cuts, groups, links, x, y = sorted(set(ends_a) & set(ends_b)), [], [], 0, 0
        for c in cuts:
            i, j = ends_a.index(c, x) + 1, ends_b.index(c, y) + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            links.append((a[i - 1], b[j - 1]))
            x, y = i, j
        return len(a), len(b), hashlib.sha256(";".join(groups).encode()).hexdigest(), links

    return one


def _expected(rows, one):
    told = [(i, *one(t)) for i, t, *_ in rows]
    count = Counter(x for row in told for x in row[4])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return Counter((i, a, b, len(k), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), sha) for i, a, b, sha, k in told)


@pytest.mark.parametrize("slice_bytes", [10**7, 2000])
def test_alignment_against_a_merge_by_hand(spark, by_hand, slice_bytes):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = Counter(tuple(x) for x in alignment.align(docs, A, B, slice_bytes).collect())
    assert got == _expected(ROWS, by_hand)


def test_batches_lanes_and_caches_change_nothing(by_hand, monkeypatch):
    whole = alignment.Merger(A, B).merge([t or "" for t in TEXTS])
    monkeypatch.setattr(alignment, "LANE_BYTES", 8)
    monkeypatch.setattr(alignment, "LANE_TOKENS", 5)
    monkeypatch.setattr(alignment, "LOOK_AHEAD", 3)
    monkeypatch.setattr(alignment, "CACHED_WORDS", 20)
    merger, at = alignment.Merger(A, B), 0
    for k, t in enumerate(TEXTS):
        n_a, n_b, links, sha, pairs = merger.merge([t or ""])
        assert (n_a[0], n_b[0], links[0], sha[0]) == (whole[0][k], whole[1][k], whole[2][k], whole[3][k])
        assert (pairs == whole[4][at : at + links[0]]).all()
        at += links[0]
        if n_a[0]:
            assert by_hand(t)[3] == [(int(p) & 0xFFFFFFFF, int(p) >> 32) for p in pairs]


def test_lockstep_of_many_lanes():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        a_all, b_all, a_from, a_to, b_from, base, want = [], [], [], [], [], 0, []
        for _ in range(rng.integers(1, 6)):
            size = int(rng.integers(1, 30))
            a, b = ({*rng.integers(1, size + 1, rng.integers(0, 10)).tolist(), size} for _ in "ab")
            a_from.append(len(a_all)), b_from.append(len(b_all))
            a_all += [base + x for x in sorted(a)]
            b_all += [base + x for x in sorted(b)]
            a_to.append(len(a_all))
            want += [base + x for x in sorted(a & b)]
            base += size
        found, partner = alignment.lockstep(*(np.array(x, np.int64) for x in (a_all, b_all, a_from, a_to, b_from)))
        assert [a_all[i] for i in found] == want == [b_all[j] for j in partner]


def test_a_long_word_is_merged_in_lanes():
    text = "".join(r.choice(["漢字", "ñandú", "x1", "token", "-", "🙂"]) for _ in range(60_000))
    merger = alignment.Merger(A, B)
    whole = merger.merge([text, "a b"])
    a, b, links = alignment.links_of(text, A, B)
    assert (whole[0][0], whole[1][0], whole[2][0]) == (len(a), len(b), len(links)) and len(a) > 100_000
    assert [(int(p) & 0xFFFFFFFF, int(p) >> 32) for p in whole[4][: whole[2][0]]] == [(a[i], b[j]) for i, j in links]
    steps = []
    true = alignment.lockstep
    alignment.lockstep = lambda *x: steps.append(np.diff(np.append(x[2], len(x[0]))).max()) or true(*x)
    try:
        merger.merge([text])
    finally:
        alignment.lockstep = true
    assert max(steps) < 3 * alignment.LANE_TOKENS


def test_links_of_one_text():
    a, b, links = alignment.links_of("unbelievable tokens", A, B)
    assert links[-1] == (len(a) - 1, len(b) - 1) and links == sorted(links)
    assert alignment.links_of("", A, B) == alignment.links_of("x▁y", A, B) == ([], [], [])


def test_empty_tables(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    assert [tuple(x) for x in alignment.align(spark.createDataFrame([(1, None, "", "", 0.0)], SCHEMA), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
