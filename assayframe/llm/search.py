"""Ranked lexical search by a dual-tree: the best documents for each item of a query set.

Items and documents are sparse vectors over the terms of the items: an item has a weight for each of its terms, a
document the term's saturated frequency, and a score is their product. Both sides are put into trees
whose nodes hold coordinate maxima, so the product of two nodes bounds all scores between them.
A pair of nodes is given up, with all its documents and items, where that bound stays below the weakest k-th
score of its items so far; else it is opened on both sides, the most promising pairs first. Nothing that could enter
a ranking is given up, so the result is exact.

The items go to the tasks in blocks of at most ``block_terms`` terms, and documents, written once for each block as vectors over the
block's terms, are searched where they are, in batches of bounded size. A first round looks at each batch's most promising leaf for each item
alone; the k-th best of all scores it finds is where every task of the second round begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import written
from assayframe.llm.packing import slices as text_slices

#: Terms are runs of ASCII letters and digits and of all other characters from U+0080 on; A-Z are lower-cased.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
TOP, BLOCK_TERMS = 10, 200_000
#: Documents in a batch, documents in a leaf, items in a leaf, children of a node, pairs opened and scored at once, bytes of a text looked at at once.
BATCH_DOCS, LEAF_DOCS, LEAF_ITEMS, FAN, PAIRS, PIECE_BYTES = 8192, 16, 4, 4, 4096, 1 << 20
#: A batch also ends after so many terms of its documents.
BATCH_TERMS = 4_000_000
VECTORS = "doc_id long, n long, terms binary, counts binary"
FOUND = "item int, doc_id long, score long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded number at a time."""
    text, at = text.translate(_TERMS), 0
    while at < len(text):
        end = len(text) if at + PIECE_BYTES >= len(text) else text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


@dataclass
class Items:
    """A block of the query set: its terms, and for each item its terms' numbers and repeats."""

    ids: list
    known: dict[bytes, int]
    vectors: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        known: dict[bytes, int] = {}
        vectors = []
        for _, text in rows:
            places = [known.setdefault(t, len(known)) for some in terms(text or b"") for t in some]
            vectors.append(tuple(np.unique(np.array(places, np.int64), return_counts=True)))
        return cls([r[0] for r in rows], known, vectors)


def blocks(items: DataFrame, block_terms: int) -> Iterator[Items]:
    """The query set in blocks; it passes through the driver one row after another."""
    rows, size = [], 0
    own = items.select(F.col("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    for row in own.toLocalIterator():
        n = sum(len(some) for some in terms(bytes(row.text or b"")))
        if rows and size + n > block_terms:
            yield Items.of(rows)
            rows, size = [], 0
        rows.append((row.item_id, bytes(row.text or b"")))
        size += n
    if rows:
        yield Items.of(rows)


def vectors(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """The written ``doc_id, n, terms, counts`` of all documents: n terms in all, and which known ones how often."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.get
        for batch in batches:
            for s, e in text_slices(batch.column(1)):
                n, places, counts = [], [], []
                for text in batch.column(1).slice(s, e - s).to_pylist():
                    total, found = 0, [np.empty(0, np.int64)]
                    for some in terms(text or b""):
                        total += len(some)
                        found.append(np.fromiter((p for p in map(of, some) if p is not None), np.int64))
                    every, k = np.unique(np.concatenate(found), return_counts=True)
                    n.append(total)
                    places.append(every.astype(np.uint32).tobytes())
                    counts.append(k.astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(n, pa.int64()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return written(own.mapInArrow(run, VECTORS), "term-vectors")


def document_frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each known term: one number per term comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for s, e in text_slices(batch.column(0)):
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(s, e - s).to_pylist()), np.uint32), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    if n_terms:
        for row in rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
            out[row.term] = row.n
    return out


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


@dataclass
class Level:
    """Sparse vectors in ascending order of (row, term): where rows begin, the terms and their values."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def merged(self, size: int) -> Level:
        """The coordinate maxima of each run of ``size`` rows."""
        row = np.repeat(np.arange(self.rows) // size, np.diff(self.starts))
        span = int(self.terms.max()) + 1 if len(self.terms) else 1
        key = row * span + self.terms
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        values = np.maximum.reduceat(self.values[order], first) if len(first) else self.values
        n = -(-self.rows // size)
        return Level(np.searchsorted(key[first], np.arange(n + 1) * span), key[first] % span, values)


def _level(vectors: list[tuple[np.ndarray, np.ndarray]]) -> Level:
    sizes = np.array([len(t) for t, _ in vectors], np.int64)
    join = lambda k: np.concatenate([np.empty(0, np.int64), *[v[k] for v in vectors]]).astype(np.int64)
    return Level(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), join(0), join(1))


def _like(level: Level, importance: np.ndarray) -> np.ndarray:
    """An order in which vectors that share their most telling terms are neighbours."""
    told = level.values.astype(float) * importance[level.terms]
    most = np.zeros(level.rows, np.int64)
    for i, (s, e) in enumerate(zip(level.starts[:-1].tolist(), level.starts[1:].tolist(), strict=True)):
        if e > s:
            most[i] = level.terms[s + int(told[s:e].argmax())] + 1
    return np.argsort(most, kind="stable")


def _taken(level: Level, order: np.ndarray) -> Level:
    at, _ = _ranges(level.starts[order], level.starts[order + 1])
    return Level(np.concatenate([[0], np.cumsum(np.diff(level.starts)[order])]).astype(np.int64), level.terms[at], level.values[at])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one range after another, and to which range each belongs."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), of


class Tree:
    """Levels from the vectors themselves (0) to nodes of which no more than FAN are left."""

    def __init__(self, level: Level, leaf: int):
        self.leaf, self.levels = leaf, [level, level.merged(leaf)]
        while self.levels[-1].rows > FAN:
            self.levels.append(self.levels[-1].merged(FAN))

    def children(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes one level below, and of which of ``nodes`` each is a child."""
        fan = self.leaf if depth == 1 else FAN
        return _ranges(nodes * fan, np.minimum((nodes + 1) * fan, self.levels[depth - 1].rows))


class Search:
    """The items of a block as a tree; searches batches of documents and keeps each item's best."""

    def __init__(self, items: Items, weights: np.ndarray, top: int, floors: np.ndarray):
        level = _level([(t, n * weights[t]) for t, n in items.vectors])
        self.order = _like(level, np.ones(max(len(weights), 1)))
        self.tree = Tree(_taken(level, self.order), LEAF_ITEMS)
        self.weights, self.top = weights, top
        #: Below these no score can enter; they rise as documents are found.
        self.floors = floors[self.order].copy()
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items.ids]  # scores, places of documents

    def _least(self) -> list[np.ndarray]:
        """For each level of the items' tree the weakest floor below each node."""
        out = [self.floors]
        for depth in range(1, len(self.tree.levels)):
            size = self.tree.leaf if depth == 1 else FAN
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), size)))
        return out

    @staticmethod
    def _products(docs: Level, doc: np.ndarray, items: Level, item: np.ndarray) -> np.ndarray:
        """The products of pairs of rows: an item's terms are looked up among the document's."""
        span = 1 + max(int(docs.terms.max(initial=0)), int(items.terms.max(initial=0)))
        keys = np.repeat(np.arange(docs.rows), np.diff(docs.starts)) * span + docs.terms
        at, of = _ranges(items.starts[item], items.starts[item + 1])
        wanted = doc[of] * span + items.terms[at]
        place = np.searchsorted(keys, wanted)
        hit = place < len(keys)
        hit[hit] = keys[place[hit]] == wanted[hit]
        out = np.zeros(len(doc), np.int64)
        np.add.at(out, of[hit], docs.values[place[hit]] * items.values[at[hit]])
        return out

    def _scores(self, docs: Tree, leaf: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, documents and scores above 0 of pairs of a leaf and an item."""
        own, items = docs.by_term, self.tree.levels[0]
        at, of = _ranges(items.starts[item], items.starts[item + 1])
        n = docs.levels[0].rows
        low = items.terms[at] * n + leaf[of] * docs.leaf
        s, e = np.searchsorted(own.keys, low), np.searchsorted(own.keys, low + np.minimum(docs.leaf, n - leaf[of] * docs.leaf))
        hits, which = _ranges(s, e)
        doc = own.keys[hits] % n
        cell = of[which] * docs.leaf + doc % docs.leaf
        scores = np.zeros(len(leaf) * docs.leaf, np.int64)
        np.add.at(scores, cell, own.values[hits] * items.values[at[which]])
        told = np.flatnonzero(scores)
        return item[told // docs.leaf], leaf[told // docs.leaf] * docs.leaf + told % docs.leaf, scores[told]

    def _keep(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.floors[item]
        if not good.any():
            return
        item, doc, score = item[good], doc[good], score[good]
        order = np.argsort(item, kind="stable")
        item, doc, score = item[order], doc[order], score[order]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        for i, s, e in zip(item[first].tolist(), first.tolist(), np.append(first[1:], len(item)).tolist(), strict=True):
            scores, docs = np.concatenate([self.found[i][0], score[s:e]]), np.concatenate([self.found[i][1], doc[s:e]])
            if len(scores) > self.top:
                weakest = np.partition(scores, -self.top)[-self.top]
                strong = scores >= weakest  # ties stay until ids decide
                scores, docs = scores[strong], docs[strong]
                self.floors[i] = max(self.floors[i], weakest)
            elif len(scores) == self.top:
                self.floors[i] = max(self.floors[i], scores.min())
            self.found[i] = (scores, docs)

    def batch(self, docs: Level, ids: np.ndarray, probe: bool = False) -> Iterator[tuple[int, int, int]]:
        """``item, place of a document, score`` of those of a batch that may be among the items' best.

        A probe looks at the most promising leaf for each item only.
        """
        if not docs.rows or not self.tree.levels[0].rows:
            return
        order = _like(docs, self.weights.astype(float))
        tree = Tree(_taken(docs, order), LEAF_DOCS)
        tree.by_term = _by_term(tree.levels[0])
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in self.found]
        if probe:
            self._probe(tree)
        else:
            self._descend(tree)
        for i, (scores, places) in enumerate(self.found):
            if len(scores) > self.top:  # by score, then by id
                best = np.lexsort((ids[order[places]], -scores))[: self.top]
                scores, places = scores[best], places[best]
            for score, place in zip(scores.tolist(), order[places].tolist(), strict=True):
                yield int(self.order[i]), place, score

    def _probe(self, tree: Tree) -> None:
        leaves, items = tree.levels[1], self.tree.levels[0]
        best, leaf = np.zeros(items.rows, np.int64), np.zeros(items.rows, np.int64)
        step = max(1, PAIRS // items.rows)
        for s in range(0, leaves.rows, step):
            some = np.arange(s, min(s + step, leaves.rows))
            bound = self._products(leaves, np.repeat(some, items.rows), items, np.tile(np.arange(items.rows), len(some))).reshape(len(some), -1)
            most = bound.max(0)
            leaf = np.where(most > best, some[bound.argmax(0)], leaf)
            best = np.maximum(best, most)
        asked = np.flatnonzero(best)
        for s in range(0, len(asked), PAIRS):
            some = asked[s : s + PAIRS]
            self._keep(*self._scores(tree, leaf[some], some))

    def _descend(self, tree: Tree) -> None:
        d, i = len(tree.levels) - 1, len(self.tree.levels) - 1
        top = (np.repeat(np.arange(tree.levels[d].rows), self.tree.levels[i].rows), np.tile(np.arange(self.tree.levels[i].rows), tree.levels[d].rows))
        heap = [(d, i, *top, self._products(tree.levels[d], top[0], self.tree.levels[i], top[1]))]
        while heap:
            d, i, doc, item, bound = heap.pop()
            alive = (bound > 0) & (bound >= self._least()[i][item])
            doc, item, bound = doc[alive], item[alive], bound[alive]
            if not len(doc):
                continue
            if len(doc) > PAIRS:  # the most promising first; the others wait, and may be given up by then
                order = np.argsort(-bound, kind="stable")
                for s in range(PAIRS * ((len(doc) - 1) // PAIRS), -1, -PAIRS):
                    at = order[s : s + PAIRS]
                    heap.append((d, i, doc[at], item[at], bound[at]))
                continue
            if d == 1 and i == 0:
                self._keep(*self._scores(tree, doc, item))
                continue
            if i > 0:
                item, of = self.tree.children(i, item)
                doc, i = doc[of], i - 1
            if d > 1:
                doc, of = tree.children(d, doc)
                item, d = item[of], d - 1
            for s in range(0, len(doc), PAIRS * FAN):
                at = slice(s, s + PAIRS * FAN)
                heap.append((d, i, doc[at], item[at], self._products(tree.levels[d], doc[at], self.tree.levels[i], item[at])))


@dataclass
class ByTerm:
    """A level's values by term: ascending ``term x rows + row``."""

    keys: np.ndarray
    values: np.ndarray


def _by_term(level: Level) -> ByTerm:
    keys = level.terms * level.rows + np.repeat(np.arange(level.rows), np.diff(level.starts))
    order = np.argsort(keys, kind="stable")
    return ByTerm(keys[order], level.values[order])


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """A term's saturated frequency in a document of so many terms, by whole numbers."""
    m = 25 + (75 * lengths * n_docs) // all_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of a batch's rows, bounded in documents and in terms."""
    for s, e in text_slices(batch.column(2), 4 * BATCH_TERMS):
        for a in range(s, e, BATCH_DOCS):
            yield a, min(a + BATCH_DOCS, e)


def _searched(rows: DataFrame, shared, probe: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, all_terms, top, floors = shared.value
        search = Search(items, weights, top, floors)
        for batch in batches:
            for s, e in _batches(batch):
                own = batch.slice(s, e - s)
                lengths = own.column(1).to_numpy()
                sizes = np.array([len(x) // 4 for x in own.column(2).to_pylist()], np.int64)
                held = np.frombuffer(b"".join(own.column(2).to_pylist()), np.uint32).astype(np.int64)
                counts = np.frombuffer(b"".join(own.column(3).to_pylist()), np.uint32).astype(np.int64)
                level = Level(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), held, impacts(counts, np.repeat(lengths, sizes), n_docs, all_terms))
                ids = own.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()  # a document without an id comes last
                found = list(search.batch(level, ids, probe))
                item, place, score = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), own.column(0).take(pa.array(place, pa.int64())), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """Spark keeps each task's first ones before the shuffle, so that an item's group is bounded by tasks x top."""
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item with a score above 0.

    Scores are whole numbers; of equal scores the least doc_id comes first, and a document without an id last. Items and
    documents without terms have no rows; repeated rows, of items and of documents, are rows of their own; other
    columns are not read; an empty table gives an empty table.
    """
    spark, out = docs.sparkSession, None
    for block in blocks(items, block_terms):
        rows = vectors(docs, block.known)
        n_docs, all_terms = rows.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequencies = document_frequencies(rows, len(block.known))
        weights = np.array([weight(n_docs, f) for f in frequencies.tolist()], np.int64)
        told = lambda floors: spark.sparkContext.broadcast((block, weights, n_docs, max(all_terms, 1), top, floors))  # noqa: B023, E731
        some = rows.filter(F.length("terms") > 0)
        floors = np.zeros(len(block.ids), np.int64)
        first = _ranked(_searched(some, told(floors), True), top).filter(F.col("rank") == top).select("item", "score")
        for row in first.toLocalIterator():
            floors[row.item] = row.score
        best = _ranked(_searched(some, told(floors), False), top)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(block.ids)], f"item int, item_id {dict(items.dtypes)['item_id']}")
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
