"""The pipeline's composition against a plain version of its five stages."""

import re

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline
from assayframe.llm import decontaminate, quality

SF = "/root/testdata/sf0.1"


def _lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def _shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", _lower(text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def _by_hand(rows, field, passages):
    """Ids that each stage keeps."""
    good = [r for r in rows if quality.scores(field, [(r.text or "").encode()])[0] >= 0.7]
    exact = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        exact[_lower(r.text)] = r
    exact = sorted(exact.values(), key=lambda r: r.doc_id)
    sets, root = [_shingles(r.text) for r in exact], list(range(len(exact)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    near = [r for i, r in enumerate(exact) if find(i) == i]
    clean = []
    for r in near:
        text = decontaminate.plain((r.text or "").encode())
        if not any(_holds(p, text) for p in passages):
            clean.append(r)
    return [[r.doc_id for r in stage] for stage in (good, exact, near, clean)]


def _holds(passage, text):
    """Whether a part of the text is the passage within its edits; texts without a third of its eight-byte strings aren't aligned."""
    grams = {passage[i : i + 8] for i in range(len(passage) - 7)}
    if sum(g in text for g in grams) < len(grams) / 10:
        return False
    a, row = np.frombuffer(text, np.uint8), np.zeros(len(text) + 1, np.int64)
    at = np.arange(len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = np.minimum(row + 1, np.r_[i, row[:-1] + (a != c)])
        row = np.minimum.accumulate(new - at) + at
    return row.min() <= decontaminate.budget(len(passage))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 260 and n_chars < 20000")
    copies = docs.filter("doc_id % 9 = 0").selectExpr("doc_id + 100000 as doc_id", "upper(text) as text", "lang", "source", "n_chars")
    near = docs.filter("doc_id % 7 = 3").selectExpr("doc_id + 200000 as doc_id", "concat(text, ' and a few more words') as text", "lang", "source", "n_chars")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = docs.filter("doc_id % 11 = 5").crossJoin(bench.filter("item_id = 3").selectExpr("text as passage")).selectExpr("doc_id + 300000 as doc_id", "concat(text, ' ', passage, ' so it goes') as text", "lang", "source", "n_chars")
    docs.unionByName(copies).unionByName(near).unionByName(leaks).repartition(3).write.parquet(f"{place}/documents.parquet")
    bench.write.parquet(f"{place}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{place}/labels.parquet")
    return place


def test_stages_and_pieces_against_plain_versions(spark, corpus):
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    rows = docs.collect()
    field = quality.fit(docs, labels)
    assert field is not None
    items = [decontaminate.plain((r.text or "").encode()).strip() for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    want = _by_hand(rows, field, [p for p in items if len(p) >= decontaminate.Q])
    now = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, now, corpus)
        out.write.parquet(f"{corpus}/{name}.parquet".replace(" ", "_"))
        now = spark.read.parquet(f"{corpus}/{name}.parquet".replace(" ", "_"))
        assert sorted(r.doc_id for r in now.select("doc_id").collect()) == sorted(ids), name
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 0
    tokenizer, texts = Tokenizer.from_file(path("word_bpe_49k.json")), {r.doc_id: r.text for r in rows}
    pieces = {}
    for p in corpus_pipeline.run(spark, corpus).collect():
        pieces.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == {i: np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i in want[3]}


def test_an_empty_corpus(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
