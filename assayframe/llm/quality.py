"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines
before and after it; the chain ties neighbouring labels together. A document's
score is the mean of its lines' forward-backward marginals for good, weighted by
their lengths.

The field is trained on a bounded sample of labelled documents, each line with
its document's label. Features are made from bytes in numpy for many documents at
once, and the recursions run over the lines of all documents of a slice in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from assayframe.llm.common import fresh
from assayframe.llm.packing import slices
from assayframe.llm.samples import held_out, labelled

PER_CLASS, MAX_BYTES, MAX_LINES, STEPS = 1000, 50_000, 200, 150
#: A byte takes some hundred while features are made.
SLICE_BYTES = 1_000_000
#: Bytes by kind: space, lower, upper, digit, common sign, other sign, part of a longer character.
SPACE, LOWER, UPPER, DIGIT, COMMON, SIGN, WIDE = range(7)
KIND = np.full(256, SIGN, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[ord("a") : ord("z") + 1], KIND[ord("A") : ord("Z") + 1], KIND[ord("0") : ord("9") + 1], KIND[128:] = LOWER, UPPER, DIGIT, WIDE
KIND[[ord(c) for c in ".,;:?'\"()-"]] = COMMON
OWN = 10
FEATURES = 3 * OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes with its end, and every text's number of lines (1 at least)."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    kind = KIND[data]
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), starts).astype(np.float64)  # noqa: E731  the line's end is a space
    size = (ends - starts).astype(np.float64)
    black = count(kind != SPACE)
    upper, lower = count(kind == UPPER), count(kind == LOWER)
    blank = kind == SPACE
    word_start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    word_end = np.flatnonzero(~blank & np.r_[blank[1:], True])
    in_line = np.searchsorted(ends, word_start)
    n_words = np.bincount(in_line, minlength=len(ends)).astype(np.float64)
    length = word_end - word_start + 1
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)]
    ranks = np.r_[np.uint64(0), np.cumsum(data.astype(np.uint64) * np.arange(len(data), dtype=np.uint64), dtype=np.uint64)]
    bag = sums[word_end + 1] - sums[word_start]
    order = (ranks[word_end + 1] - ranks[word_start]) - (bag * np.uint64(0xF1DE83E19937733D) - length.astype(np.uint64)) * word_start.astype(np.uint64)
    same = np.r_[False, (bag[1:] == bag[:-1]) & (order[1:] == order[:-1]) & (in_line[1:] == in_line[:-1])]
    per = lambda x, of: np.divide(x, of, out=np.zeros_like(x), where=of > 0)
    of_words = lambda w: per(np.bincount(in_line, weights=w, minlength=len(ends)).astype(np.float64), n_words)
    x = np.stack(
        [
            np.log1p(size) / 5,
            per(upper, upper + lower),
            per(count(kind == SIGN), black),
            per(count(kind == DIGIT), black),
            per(count(kind == COMMON), black),
            per(count(kind == WIDE), black),
            of_words(length.astype(np.float64)) / 10,
            of_words(same.astype(np.float64)),
            of_words((length == 1).astype(np.float64)),
            (black == 0).astype(np.float64),
        ],
        axis=1,
    )
    n_lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    last = np.cumsum(n_lines) - 1
    first = last - n_lines + 1
    before, after = np.vstack([np.zeros((1, OWN)), x[:-1]]), np.vstack([x[1:], np.zeros((1, OWN))])
    before[first], after[last] = 0, 0
    return np.hstack([x, before, after, np.ones((len(x), 1))]).astype(np.float32), size + 1, n_lines


@dataclass
class Field:
    """``weights`` of a line's features for good against bad, ``step[a, b]`` for label a followed by b."""

    weights: np.ndarray
    step: np.ndarray


def _by_step(n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains, the longest first: their order, their first lines, and for each step how many chains have that many lines."""
    order = np.argsort(-n_lines, kind="stable")
    first = (np.cumsum(n_lines) - n_lines)[order]
    alive = np.searchsorted(-n_lines[order], -np.arange(n_lines.max(initial=0)), "left")
    return order, first, alive


def marginals(field: Field, good: np.ndarray, n_lines: np.ndarray, pairs: bool = False):
    """P(good) of every line, from the lines' scores for good against bad; with ``pairs`` also the expected label pairs."""
    _, first, alive = _by_step(n_lines)
    step = np.exp(field.step - field.step.max())
    emit = np.stack([np.exp(np.minimum(0, -good)), np.exp(np.minimum(0, good))], axis=1)
    forward, backward = np.empty((len(good), 2)), np.ones((len(good), 2))
    for t, n in enumerate(alive):
        at = first[:n] + t
        f = emit[at] if t == 0 else (forward[at - 1] @ step) * emit[at]
        forward[at] = f / f.sum(1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        b = (backward[at + 1] * emit[at + 1]) @ step.T
        backward[at] = b / b.sum(1, keepdims=True)
    both = forward * backward
    p = both[:, 1] / both.sum(1)
    if not pairs:
        return p
    inner = np.ones(len(good), bool)
    inner[(np.cumsum(n_lines) - 1)] = False
    at = np.flatnonzero(inner)
    joint = forward[at][:, :, None] * step * (emit[at + 1] * backward[at + 1])[:, None, :]
    return p, (joint / joint.sum((1, 2), keepdims=True)).sum(0) if len(at) else np.zeros((2, 2))


def train(x: np.ndarray, n_lines: np.ndarray, label: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> Field:
    """The field of the greatest penalised likelihood, by Adam from zero."""
    y = np.repeat(label, n_lines).astype(np.float64)
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(n_lines) - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    x = x.astype(np.float64)
    shift, scale = x.mean(0), x.std(0)
    shift[-1], scale[scale == 0] = 0, 1  # the last feature is the constant
    x = (x - shift) / scale
    for i in range(1, steps + 1):
        field.weights, field.step = theta[:-4], theta[-4:].reshape(2, 2)
        p, expected = marginals(field, x @ field.weights, n_lines, pairs=True)
        slope = np.r_[x.T @ (y - p), (seen - expected).ravel()] / len(y) - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    weights = theta[:-4] / scale
    weights[-1] -= weights @ shift
    return Field(weights, theta[-4:].reshape(2, 2))


def scores(field: Field, texts: list[bytes]) -> np.ndarray:
    x, size, n_lines = line_features(texts)
    p = marginals(field, x.astype(np.float64) @ field.weights, n_lines)
    of = np.repeat(np.arange(len(texts)), n_lines)
    return np.bincount(of, weights=p * size, minlength=len(texts)) / np.bincount(of, weights=size, minlength=len(texts))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 4, fold: int = 2, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> Field | None:
    """A field from a bounded sample; None where one of the labels doesn't occur in it.

    Features are made where the texts are; the driver gets at most
    2 x per_class x max_lines rows of FEATURES numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column(1).to_pylist():
                made.append(line_features([t.encode()])[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["doc_id", "label", "x"])

    rows = labelled(docs, labels, target, folds, fold, per_class, max_bytes)
    rows = rows.filter(F.length("text") - F.length(F.replace("text", F.lit("\n"))) < max_lines)
    rows = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id long, label int, x binary")
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    if {r.label for r in rows} != {0, 1}:
        return None
    each = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    return train(np.concatenate(each), np.array([len(x) for x in each]), np.array([r.label for r in rows]))


def with_score(docs: DataFrame, field: Field | None, column: str = "score", text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, with one more of the given name: the score of each whole text.

    A null or empty text is one empty line. Without a field every score is 0.5.
    Repeated rows give repeated rows; an empty table gives an empty table.
    """

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            out = np.full(len(texts), 0.5)
            if field is not None:
                for a, b in slices(texts, SLICE_BYTES):
                    out[a:b] = scores(field, [t or b"" for t in texts.slice(a, b - a).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], schema=pa.schema([*batch.schema, pa.field(column, pa.float64())]))

    if column in docs.columns:
        raise ValueError(f"the table has a column {column!r} already")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def score(docs: DataFrame, field: Field | None, folds: int = 4, fold: int = 2, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; other columns than doc_id and text are not read."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_score(own, field).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: Field | None, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` at least (all, without a field); all columns stay as they are."""
    if field is None:
        return docs
    column = fresh(docs, "quality")
    return with_score(docs, field, column).filter(F.col(column) >= threshold).drop(column)
