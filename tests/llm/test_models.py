"""Quality, toxicity and decontamination: held-out accuracy and brute-force versions."""

import random
from collections import Counter

import numpy as np
import pytest

from assayframe.llm import decontaminate, quality, toxicity
from assayframe.llm.samples import held_out

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, score double"
ODD = [(1, None, "x", 1.0), (2, "", "x", 1.0), (None, "\n\n\n", "x", None), (3, "ÀÉ ### \x00", None, 1.0), (3, "ÀÉ ### \x00", None, 1.0), (4, "word " * 40_000, "x", 1.0)]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels


def _held(scored, labels, target):
    rows = scored.filter("held_out").join(labels, "doc_id").groupBy(target, "predicted").count().collect()
    return {(r[target], r.predicted): r["count"] for r in rows}


def test_quality_on_held_out_documents(corpus):
    docs, labels = corpus
    n = _held(quality.score(docs, quality.fit(docs, labels)), labels, "quality")
    assert n[(0, 0)] / (n[(0, 0)] + n.get((0, 1), 0)) > 0.97
    assert n[(1, 1)] / (n[(1, 1)] + n.get((1, 0), 0)) > 0.97


def test_toxicity_on_held_out_documents(corpus):
    docs, labels = corpus
    n = _held(toxicity.score(docs, toxicity.fit(docs, labels)), labels, "toxic")
    assert n[(1, 1)] / (n[(1, 1)] + n.get((1, 0), 0)) > 0.55
    assert n[(0, 0)] / (n[(0, 0)] + n.get((0, 1), 0)) > 0.93


SYLLABLES = "ba ke li mo nu ra se ti vo za pe du".split()


def _said(r, n, rude=()):
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for _ in range(n // 20 if rude else 0):
        words[r.randrange(n)] = r.choice(rude)
    return " ".join(words)


def test_toxicity_is_compression_of_running_text():
    """Phrases, not words, tell the classes apart; long clean texts stay clean and a toxic passage in a long text is found."""
    r = random.Random(6)
    rude = ["wxyq jfhg", "gqhw yxxj", "hjjq wfxg"]
    train = [(_said(r, 150, rude if i % 2 else ()), i % 2) for i in range(600)]
    model = toxicity.train(train)
    distance = toxicity.Distance(model)
    near = lambda t: distance.of(t)[0] >= model.threshold
    clean, toxic = [_said(r, 150) for _ in range(60)], [_said(r, 150, rude) for _ in range(60)]
    assert sum(map(near, clean)) <= 3 and sum(map(near, toxic)) >= 57
    assert not near(_said(r, 6000)) and near(_said(r, 2000) + " " + _said(r, 200, rude) + " " + _said(r, 2000))
    window = distance.distances("wxyq jfhg") - distance.distances("bake limo")
    assert window.max() > 0  # what the codec saves decides
    assert toxicity.cuts(toxicity.plain("x" * 300))[-1] == 301 and b"".join(w[:-1] for w in toxicity.windows(b" ab cd ef ")) == b" ab cd ef"


@pytest.mark.parametrize("model", [quality, toxicity])
def test_odd_rows_and_missing_models(spark, model):
    docs = spark.createDataFrame(ODD, SCHEMA)
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert model.fit(docs, none) is None
    rows = model.score(docs, None).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    assert model.score(spark.createDataFrame([], SCHEMA), None).collect() == []


def test_trained_models_score_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    texts = [b"good plain words here.\nand more of them" + bytes([97 + i % 26]) for i in range(30)] + [b"BAD!! WORDS!! HERE!!\n### ### ###" for _ in range(30)]
    x, _, n = quality.line_features(texts)
    field = quality.train(x, n, np.array([1] * 30 + [0] * 30))
    rows = quality.score(docs, field).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    by_hand = quality.scores(field, [texts[0], b"", texts[40]])
    assert by_hand[0] > 0.9 and by_hand[2] < 0.1
    kept = quality.keep_good(docs.withColumnRenamed("score", "other"), field)
    assert kept.columns == ["doc_id", "text", "lang", "other"]


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    field = quality.Field(np.zeros(quality.FEATURES), rng.normal(size=(2, 2)))
    n_lines = np.array([3, 1, 4])
    good = rng.normal(size=8)
    p = quality.marginals(field, good, n_lines)
    at = 0
    for n in n_lines:
        total, mass = 0.0, np.zeros(n)
        for labels in range(2**n):
            y = [labels >> t & 1 for t in range(n)]
            w = np.exp(sum(good[at + t] * y[t] for t in range(n)) + sum(field.step[y[t], y[t + 1]] for t in range(n - 1)))
            total += w
            mass += w * np.array(y)
        assert np.allclose(p[at : at + n], mass / total)
        at += n


def test_folds_are_crc32_of_the_id_as_text(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 7, 123456)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", held_out(df.doc_id, 5, 0).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 if i is not None else False for i in (0, 7, 123456, None)}


def _edits(passage, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8))) for _ in range(200)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.randint(8, 25)).capitalize() + ".") for i in range(8)] + [(50, None), (51, ""), (52, "abc"), (53, "exactly8")]
    docs = [(1, None), (2, ""), (None, say(10)), (3, "EXACTLY8 and more"), (4, say(400) + items[0][1] + say(400))]
    for d in range(40):
        p = bytearray(items[d % 8][1].encode())
        for _ in range(d % 6 * len(p) // 40):
            j = r.randrange(len(p))
            p[j : j + 1] = r.choice([b"", b"x", b"yz"])
        docs.append((10 + d, say(20) + " " + p.decode("utf-8", "ignore") + " " + say(20)))
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, edits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for d, t in docs:
        for i, q in items:
            p = decontaminate.plain((q or "").encode())
            if len(p) >= decontaminate.Q and (e := _edits(p, decontaminate.plain((t or "").encode()))) <= decontaminate.budget(len(p)):
                expected.add((d, i, e))
    for block_bytes in (4_000_000, 150):
        found = decontaminate.find(df, bench, block_bytes=block_bytes).collect()
        assert {(x.doc_id, x.item_id, x.edits) for x in found} == expected and len(found) == len(expected)
    kept = decontaminate.remove(df, bench)
    assert kept.columns == df.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(d for d, _ in docs if d not in {e[0] for e in expected})


def _banded(passage, text, diagonal, most):
    """Least edits along the band, by a full table with cells outside the band left out."""
    low, high = diagonal - most, diagonal + 3 * most + 2
    row = {j: 0 for j in range(len(text) + 1) if low <= j < high}
    for i, a in enumerate(passage, 1):
        new = {}
        for j in range(len(text) + 1):
            if low <= j - i < high:
                ways = [row[j] + 1] if j in row else []
                ways += [new[j - 1] + 1] if j - 1 in new else []
                ways += [row[j - 1] + (a != text[j - 1])] if j and j - 1 in row else []
                new[j] = min(ways, default=10**6)
        row = new
    return min(row.values(), default=10**6)


def test_alignment_along_a_band():
    r = random.Random(2)
    for _ in range(300):
        passage = bytes(r.choice(b"abc") for _ in range(r.randint(8, 20)))
        text = bytes(r.choice(b"abc") for _ in range(r.randint(0, 25))) + passage[: r.randint(5, 20)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 25)))
        diagonal, most = r.randint(-6, 40), r.randint(0, 5)
        got, best = decontaminate.align(passage, text, diagonal, most), _banded(passage, text, diagonal, most)
        assert (got is None) == (best > most)
        if got:
            assert got[0] == best and _edits(passage, text[got[1] : got[2]]) <= best


def test_decontamination_in_pieces(monkeypatch):
    """Texts longer than a piece and q-grams of any number of places give what one look at everything gives."""
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdé") for _ in range(r.randint(2, 6))) for _ in range(n))
    items = [(i, (say(20) + " " + "-" * 60 + " " + say(3)).encode()) for i in range(30)]
    block = decontaminate.Block.build(items)
    text = ("-" * 5000 + say(800) + items[3][1].decode().replace("-" * 60, "#") + say(900) + items[9][1].decode()[3:] + "." * 3000).encode()
    whole = block.matches(text)
    assert {m[0] for m in whole} == {3, 9} and decontaminate.plain(text[whole[0][2] : whole[0][3]]) == block.passages[3]
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 4096)
    monkeypatch.setattr(decontaminate, "EXPANDED", 50)
    assert block.matches(text) == whole


def test_helper_columns_never_clash(spark):
    from assayframe.llm import exact_dedup, simhash

    names = ["__id", "__digest", "__body", "__found", "__quality", "own_id", "own_digest", "own_body", "found", "quality", "one_of_each"]
    df = spark.createDataFrame([(1, "a text", *names), (2, "A text", *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    bench = spark.createDataFrame([(1, "another passage")], "item_id long, text string")
    x, _, n = quality.line_features([b"good plain words", b"### ###"])
    field = quality.train(np.concatenate([x] * 30), np.concatenate([n] * 30), np.array([1, 0] * 30))
    for out in (exact_dedup.deduplicate(df), simhash.deduplicate(df), decontaminate.remove(df, bench), quality.keep_good(df, field, 0.0)):
        assert out.columns == df.columns
        assert {tuple(r)[2:] for r in out.collect()} == {tuple(names)}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(none, bench).collect() == []
    assert decontaminate.remove(spark.createDataFrame([(1, "x")], "doc_id long, text string"), bench).count() == 1


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400")
    extra = docs.filter("doc_id < 3").selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = docs.unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}.parquet".replace(" ", "_"))
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet".replace(" ", "_"))
        now = docs.count()
        assert now < left if name != "packing" else now <= left, name
        left = now
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids
