"""Language-model scores by deleted interpolation.

The probability of a word is a mixture of the n-gram maximum-likelihood estimates of all orders and of a
uniform one. Mixture weights depend on how often the longest context that was seen occurred (a bucket for
each power of two), and are learned by expectation-maximisation on counts of a part of the training
documents that is deleted from the estimates while learning; scoring uses the estimates of all training documents.

Documents are dealt into slices of about ``SLICE_TOKENS`` tokens, written once. Each slice asks for
the counts of its distinct n-grams (``counting``), so that all that follows is a slice's own work:
no count table is broadcast, no token of a document is shuffled by itself, and a very frequent word or n-gram costs one entry
for each slice. The driver sees the weights' sufficient statistics: a histogram of the held-out
events by rounded estimates, whose number of cells has a bound that doesn't depend on the corpus.

Words are told apart by hashes of 64 bits and longer n-grams by 56: of 10^12 different ones, one in 70,000 would
share another's count. Orders up to 4 are supported.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm import counting
from assayframe.llm.common import written
from assayframe.llm.packing import slices as text_slices

SLICE_TOKENS, PIECE_BYTES, ORDER, FOLDS, FOLD = 1_500_000, 1 << 20, 2, 5, 1
#: Of the training documents one in so many is deleted from the estimates while weights are learned.
DELETED = 5
#: Estimates are rounded to so many steps for each power of two before events are counted.
STEPS, NEVER = 4, 0
#: Words are told apart by 64 bits of hash, longer n-grams by these 56.
TOLD_APART = np.uint64(0xFFFFFFFFFFFFFF00)
ROUNDS, SETTLED = 200, 1e-7
#: White space ends words; A-Z are lower-cased.
_WORDS = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
END, START = b" end", b" start"  # no word has a space
HELD_OUT, KEPT, DELETED_PART = 0, 1, 2
SLICES = "slice long, tokens long, train long, kept long, train_docs long, kept_docs long, ids array<long>, parts array<int>, lengths array<int>, words binary, places binary"
RESOLVED = "slice long, ids array<long>, parts array<int>, lengths array<int>, counts array<binary>, events array<long>, n_events array<long>"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number at a time."""
    text, at = text.translate(_WORDS), 0
    while at < len(text):
        end = len(text) if at + PIECE_BYTES >= len(text) else text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def part_of(doc_id: int | None, folds: int, fold: int) -> int:
    """Whether a document is held out of training, or of its two parts belongs to the one that is deleted while weights are learned."""
    if doc_id is None:
        return KEPT
    rest, place = divmod(zlib.crc32(str(doc_id).encode()), folds)[::-1]
    return HELD_OUT if rest == fold else DELETED_PART if place % DELETED == 0 else KEPT


class _Slice:
    def __init__(self):
        self.places, self.known, self.ids, self.parts, self.lengths = array("I"), {END: 0}, [], [], []

    def add(self, doc_id: int | None, text: bytes, part: int) -> None:
        known, before = self.known, len(self.places)
        for some in words(text):
            self.places.extend([known.setdefault(w, len(known)) for w in some])
        self.places.append(0)
        for name, value in (("ids", doc_id), ("parts", part), ("lengths", len(self.places) - before)):
            getattr(self, name).append(value)

    def row(self, key: int) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.known), np.uint64, len(self.known))
        parts, lengths = np.array(self.parts), np.array(self.lengths, np.int64)
        of = lambda chosen: int(lengths[chosen].sum())
        train, kept = parts != HELD_OUT, parts == KEPT
        values = [key, len(self.places), of(train), of(kept), int(train.sum()), int(kept.sum()), self.ids, self.parts, self.lengths, hashes.tobytes(), counting.pack(np.frombuffer(self.places, np.uint32))]
        kinds = [*[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in SLICES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def cut(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """The written slices of a corpus; each document is whole in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = TaskContext.get().partitionId() << 24, _Slice()
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                for doc_id, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    own.add(doc_id, text or b"", part_of(doc_id, folds, fold))
                    if len(own.places) >= slice_tokens:
                        yield own.row(key)
                        key, own = key + 1, _Slice()
        if own.ids:
            yield own.row(key)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return written(own.mapInArrow(run, SLICES), "lm-slices")


def _first(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each of a slice's tokens the part of its document, and whether it is the first there."""
    lengths = np.array(row["lengths"].as_py(), np.int64)
    first = np.zeros(int(lengths.sum()), bool)
    first[np.cumsum(lengths)[:-1]] = True
    first[:1] = True
    return np.repeat(np.array(row["parts"].as_py(), np.int8), lengths), first


def _grams(row: dict, first: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order a slice's distinct n-grams as keys, and which of them ends at each token."""
    word = counting.mixed(np.frombuffer(row["words"].as_py(), np.uint64))[counting.unpack(row["places"].as_py())]
    start, keys = counting.mixed(np.array([xxhash.xxh64_intdigest(START)], np.uint64))[0], word
    for n in range(1, order + 1):
        if n > 1:
            context = np.empty_like(word)
            context[1:] = keys[:-1]
            context[first] = start  # a text's first words have as many starts before them as the order asks for
            context *= np.uint64(0x9E3779B97F4A7C15)
            context += word
            keys = counting.mixed(context + np.uint64(n)) & TOLD_APART
        every, place = np.unique(keys, return_inverse=True)
        yield n, every, place.astype(np.uint32)


def _question(order: int):
    def question(row: dict) -> Iterator[counting.Question]:
        parts, first = _first(row)
        for n, every, place in _grams(row, first, order):
            yield n, every, np.stack([np.bincount(place[parts == p], minlength=len(every)).astype(np.uint32) for p in (KEPT, DELETED_PART)])

    return question


def _sums(kind: int, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    kept, train = counts[0], counts.sum(0)
    return np.stack([kept, train]), [int((train > 0).sum()), int((kept > 0).sum())]


def buckets_of(context: np.ndarray) -> np.ndarray:
    """The power of two at or below a context's frequency, from 1 on; 0 for a context that was never seen."""
    return np.where(context > 0, np.frexp(context.astype(float))[1], 0)


def contexts(counts: list[np.ndarray], first: np.ndarray, documents: int) -> list[np.ndarray]:
    """For the orders from 2 on how often each token's context occurred: at a text's beginning as often as there are texts."""
    out = []
    for own in counts[:-1]:
        before = np.empty(len(own), np.int64)
        before[1:] = own[:-1]
        before[first] = documents
        out.append(before)
    return out


def estimates(counts: list[np.ndarray], first: np.ndarray, documents: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each token's bucket, and for the orders from 2 on its share of its context.

    The bucket is the longest context's that was seen: 64 for each order, and its frequency's power of two.
    """
    bucket, shares = np.full(len(first), 64, np.int64), []
    for n, (own, context) in enumerate(zip(counts[1:], contexts(counts, first, documents), strict=True), 2):
        shares.append(np.divide(own, context, out=np.zeros(len(own)), where=context > 0))
        bucket = np.where(context > 0, 64 * n + buckets_of(context), bucket)
    return bucket, shares


def _rounded(x: np.ndarray) -> np.ndarray:
    """Steps of a logarithm from 1 on; 0 for zero."""
    return np.where(x > 0, np.rint(STEPS * np.log2(np.where(x > 0, x, 1))) + 1024, NEVER).astype(np.int64)


def _resolve(order: int, kept_docs: int):
    def resolve(row: dict, answers: dict[int, np.ndarray]) -> dict:
        parts, first = _first(row)
        kept, train, chosen = [], [], parts == DELETED_PART
        for n, _, place in _grams(row, first, order):
            told = answers.pop(n)
            kept.append(told[0][place])
            train.append(counting.pack(told[1][place]))
        bucket, shares = estimates(kept, first, kept_docs)
        cells = bucket[chosen]
        for x in [kept[0], *shares]:
            cells = cells << 11 | _rounded(x[chosen].astype(float))
        cells, n = np.unique(cells, return_counts=True)
        return {k: [row[k].as_py()] for k in ("slice", "ids", "parts", "lengths")} | {"counts": [train], "events": [cells.tolist()], "n_events": [n.tolist()]}

    return resolve


RESOLVED_ARROW = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.binary())), ("events", pa.list_(pa.int64())), ("n_events", pa.list_(pa.int64()))])


@dataclass
class Model:
    """Sizes of the training part and the mixture weights: for each bucket those of the uniform estimate and of the orders from 1 on."""

    order: int
    tokens: int
    vocabulary: int
    documents: int
    weights: dict[int, list[float]]

    def weights_of(self, bucket: np.ndarray) -> np.ndarray:
        every, place = np.unique(bucket, return_inverse=True)
        return np.array([self.weights.get(b) or self.default(b) for b in every.tolist()]).reshape(len(every), -1)[place]

    def default(self, bucket: int) -> list[float]:
        """Equal weights for the estimates that such a context has, where no held-out event taught others."""
        usable = bucket // 64 if self.tokens else 0
        return [1 / (usable + 1)] * (usable + 1) + [0.0] * (self.order - usable)

    def probabilities(self, counts: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        bucket, shares = estimates(counts, first, self.documents)
        parts = [np.full(len(first), 1 / (self.vocabulary + 1)), counts[0] / max(self.tokens, 1), *shares]
        return (self.weights_of(bucket) * np.stack(parts, axis=1)).sum(1)


def expectation_maximisation(given: np.ndarray, n: np.ndarray, usable: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of a mixture under which events (rows of estimates, each seen n times) are likeliest.

    Each usable estimate has the share of one event more, so that none has a weight of zero.
    """
    weights = np.zeros(given.shape[1])
    weights[: usable + 1] = 1 / (usable + 1)
    extra = (weights > 0) / (usable + 1)
    for _ in range(rounds):
        shares = given * weights
        shares /= shares.sum(1, keepdims=True)
        new = (n @ shares + extra) / (n.sum() + 1)
        moved, weights = np.abs(new - weights).max(), new
        if moved < SETTLED:
            break
    return weights


def learn(cell: np.ndarray, n: np.ndarray, order: int, tokens: int, vocabulary: int) -> dict[int, list[float]]:
    """Weights by bucket from the histogram of held-out events; tokens and vocabulary are those of the estimates they were counted with."""
    given = [np.full(len(cell), 1 / (vocabulary + 1))]
    for k in range(order - 1, -1, -1):
        step = cell >> (11 * k) & 2047
        x = np.where(step > 0, 2.0 ** ((step - 1024) / STEPS), 0.0)
        given.append(x / max(tokens, 1) if k == order - 1 else x)
    bucket, given = cell >> (11 * order), np.stack(given, axis=1)
    return {b: expectation_maximisation(given[bucket == b], n[bucket == b], b // 64).tolist() for b in np.unique(bucket).tolist()}


def resolved(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, fold: int = FOLD, slice_tokens: int = SLICE_TOKENS) -> tuple[DataFrame, Model]:
    """The written slices with the counts of their n-grams, and the model."""
    spark = docs.sparkSession
    own = cut(docs, folds, fold, slice_tokens)
    sizes = own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train", "kept", "train_docs", "kept_docs")]).first()
    answers = written(counting.answered(counting.ask(own, _question(order), counting.n_buckets(spark, sizes.tokens)), _sums), "lm-counts")
    vocabulary, kept_vocabulary = counting.facts(answers, 1)
    out = written(counting.joined(own, answers, _resolve(order, sizes.kept_docs), RESOLVED, RESOLVED_ARROW), "lm-resolved")
    events = out.select(F.explode(F.arrays_zip("events", "n_events")).alias("e")).groupBy(F.col("e.events").alias("cell")).agg(F.sum("e.n_events").alias("n")).toArrow()
    weights = learn(events["cell"].to_numpy(), events["n"].to_numpy(), order, sizes.kept, kept_vocabulary)
    return out, Model(order, sizes.train, vocabulary, sizes.train_docs, weights)


def scored(slices: DataFrame, model: Model) -> DataFrame:
    """A row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    total = model.tokens + 0.5 * (model.vocabulary + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                lengths = np.array(row["lengths"].as_py(), np.int64)
                starts = np.cumsum(lengths) - lengths
                counts = [counting.unpack(x).astype(np.int64) for x in row["counts"].as_py()]
                first = np.zeros(len(counts[0]), bool)
                first[starts] = True
                over = lambda x: np.add.reduceat(x, starts)
                base, score = over(np.log10((counts[0] + 0.5) / total)), over(np.log10(model.probabilities(counts, first)))
                known = over((counts[0] > 0).astype(np.int64))
                parts = np.array(row["parts"].as_py())
                values = [row["ids"].values, pa.array(parts == HELD_OUT), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), model.tokens)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(values, names=names)

    return slices.select("ids", "parts", "lengths", "counts").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, fold: int = FOLD, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """Every whole text's log10 probability under a model of the documents outside the held-out fold, with a simpler base score.

    A text's tokens are its words and one end. Null text counts as empty and has the end alone; a null id is never
    held out; repeated rows are documents of their own, other columns are not read, and an empty table gives an empty
    table. Without training documents every token has probability 1. A slice is as long as its longest text.
    """
    return scored(*resolved(docs, order, folds, fold, slice_tokens))
