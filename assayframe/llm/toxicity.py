"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample, one on ordinary text and one on
toxic text, which continues the ordinary one. A text is cut into windows of a few words; a
window's distance is how many bytes fewer it takes with the toxic dictionary than with the
ordinary one.

Only labels of whole documents are known, and most of a toxic document is ordinary. So the toxic
dictionary grows in rounds. Each trains zstandard on the toxic sample's windows that the ordinary
dictionary explains worst and the toxic one not yet, and drops the pieces of the result that save
ordinary windows nearly as often as toxic ones. No list of words is made: what is chosen are pieces
of a trained dictionary, by the bytes that they save. Ordinary windows that still come near join
the ordinary dictionary.

Calibration, on documents that no dictionary has seen: how much oftener than ordinary text toxic
text has windows of each distance is a window's evidence (a logarithm, negative for small
distances). A document has the evidence of its best stretch of windows, less the logarithm of their
number: a long text has more stretches to be near by chance, and a short toxic passage in a long
text is not thinned out. Letters are widened to two bytes before compression, so that the few bytes
that any match costs weigh less against the letters that it saves.

The sample is bounded (``samples.labelled``); scoring sees every text whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.packing import slices
from assayframe.llm.samples import held_out, labelled, without_copies

PER_CLASS, MAX_BYTES = 2500, 20_000
#: Words of a window, and the bytes beyond which one is cut.
WORDS, LONGEST = 2, 64
#: Bytes of the ordinary dictionary, of what a round trains, of a piece of it and between pieces, and the windows that each class is judged by.
ORDINARY, TRAINED, PIECE, STEP, MOST_WINDOWS = 24_000, 20_000, 10, 2, 200_000
#: Rounds; the share of windows left out of a round as well explained, by turns; how much oftener, per window, a piece
#: has to save toxic windows than ordinary ones, in how many documents, and by how many bytes.
ROUNDS, EXPLAINED, ODDS, LEAST_DOCS, LEAST_SAVED = 6, (0.6, 0.0), 8, 4, 6
MOST_DISTANCE = 24
#: What a clean document left alone counts against a toxic one caught, where the threshold is set.
CLEAN_WEIGHT = 2.0

_OTHER = re.compile(r"[\W_]+")
_TAIL = bytes(range(1, 9))  # zstandard begins no match in the last eight bytes of its input


def plain(text: str) -> bytes:
    return b" " + _OTHER.sub(" ", text.lower()).strip().encode() + b" "


def widened(data: bytes) -> bytes:
    """Two bytes for each, the second a function of the first."""
    own = np.frombuffer(data, np.uint8)
    return np.stack([own, own * np.uint8(167) + np.uint8(77)], axis=1).tobytes()


def cuts(data: bytes, words: int = WORDS, longest: int = LONGEST) -> list[int]:
    """Where windows begin and end: at every so many spaces, and within what would be longer than ``longest``."""
    at = np.r_[np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[:-1:words], len(data) - 1]
    pieces = np.maximum((np.diff(at) + longest - 1) // longest, 1)
    start = np.repeat(at[:-1], pieces)
    return np.r_[start + longest * (np.arange(len(start)) - np.repeat(np.cumsum(pieces) - pieces, pieces)), at[-1]].tolist()


def windows(data: bytes) -> list[bytes]:
    at = cuts(data)
    return [data[a : b + 1] for a, b in zip(at[:-1], at[1:], strict=True)]


def trained(size: int, texts: list[bytes], segment: int) -> bytes:
    """The content of a dictionary that zstandard trains on texts; of too little text, the text itself."""
    try:
        whole = zstandard.train_dictionary(size, texts, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]
    return whole[160:] if len(whole) > 1000 else whole  # without the header


class Lengths:
    """Compressed lengths of widened windows with one dictionary."""

    def __init__(self, content: bytes):
        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=4, min_match=7, strategy=zstandard.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0)
        self._compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(widened(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress

    def of(self, wide: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, map(self._compress, wide)), np.int64, len(wide))


def _wide(some: list[bytes]) -> list[bytes]:
    return [widened(w) + _TAIL for w in some]


@dataclass
class Model:
    """The two dictionaries' contents, the evidence of each distance from 0 to MOST_DISTANCE, and the document's threshold."""

    ordinary: bytes
    toxic: bytes
    evidence: np.ndarray
    threshold: float = 0.0

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(min(evidence - self.threshold, 30.0), -30.0)))


class Distance:
    def __init__(self, model: Model):
        self.ordinary, self.toxic, self.evidence = Lengths(model.ordinary), Lengths(model.toxic), model.evidence

    def distances(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        data = plain(text)
        wide, at = widened(data), [2 * x for x in cuts(data)]
        own = [wide[a : b + 2] + _TAIL for a, b in zip(at[:-1], at[1:], strict=True)]
        return self.ordinary.of(own) - self.toxic.of(own)

    def of(self, text: str) -> tuple[float, int]:
        """A document's evidence, and the windows that have more than none."""
        each = self.evidence[np.clip(self.distances(text), 0, MOST_DISTANCE)]
        sums = np.r_[0.0, np.cumsum(each)]
        best = float((sums - np.minimum.accumulate(sums)).max())
        return best - math.log(len(each) + 1), int((each > 0).sum())


def _grams(data: bytes) -> set[bytes]:
    return {data[i : i + 6] for i in range(len(data) - 5)}


def _users(pieces: list[bytes], some: list[bytes]) -> list[int]:
    """For each window the piece that shares most of its six-byte strings, the first of equals; -1 for none."""
    index = defaultdict(list)
    for j, p in enumerate(pieces):
        for g in _grams(p):
            index[g].append(j)
    shared = [Counter(j for g in _grams(w) for j in index.get(g, ())) for w in some]
    return [max(c.items(), key=lambda x: (x[1], -x[0]))[0] if c else -1 for c in shared]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes] | None:
    """The contents of the ordinary and the toxic dictionary; None if no toxic text sets itself apart."""
    rng = np.random.default_rng(7)
    own = [(i, w) for i, t in enumerate(toxic) for w in windows(plain(t))]
    of, some = np.array([i for i, _ in own]), [w for _, w in own]
    if len(some) > MOST_WINDOWS:
        kept = np.sort(rng.permutation(len(some))[:MOST_WINDOWS])
        of, some = of[kept], [some[i] for i in kept]
    rest = [w for t in ordinary for w in windows(plain(t))]
    rest = [rest[i] for i in rng.permutation(len(rest))]
    half = max(1, min(len(rest) // 3, MOST_WINDOWS // 2))
    learnt, seen = rest[:half], rest[half : 3 * half] or rest
    base = trained(ORDINARY, learnt, 24)
    wide, wide_seen = _wide(some), _wide(seen)
    before, before_seen = Lengths(base).of(wide), Lengths(base).of(wide_seen)
    ratio, open_, kept = before / np.array([len(w) for w in wide]), np.ones(len(some), bool), []
    for k in range(ROUNDS):
        if not open_.any():
            break
        hard = np.flatnonzero(open_ & (ratio >= np.quantile(ratio[open_], EXPLAINED[k % len(EXPLAINED)])))
        fresh = trained(TRAINED, [some[i] for i in rng.permutation(hard)], 12)
        pieces = [fresh[i : i + PIECE] for i in range(0, max(len(fresh) - PIECE, 0) + 1, STEP)] + kept
        both = Lengths(base + b"".join(kept) + fresh)
        near = np.flatnonzero(before - both.of(wide) >= LEAST_SAVED)
        near_seen = np.flatnonzero(before_seen - both.of(wide_seen) >= LEAST_SAVED)
        docs, uses = defaultdict(set), Counter(_users(pieces, [seen[i] for i in near_seen]))
        for j, i in zip(_users(pieces, [some[i] for i in near]), near, strict=True):
            docs[j].add(of[i])
        odds = lambda j: len(docs[j]) / len(some) / ((uses[j] + 0.5) / len(seen))
        kept = [pieces[j] for j in sorted(docs) if j >= 0 and len(docs[j]) >= min(LEAST_DOCS, len(toxic)) and odds(j) >= ODDS]
        if not kept:
            return None
        open_ = before - Lengths(base + b"".join(kept)).of(wide) < LEAST_SAVED
    return base, base + b"".join(kept)


def calibrated(model: Model, texts: list[tuple[str, int]]) -> Model:
    """The model with the evidence of distances and the threshold that tell these texts apart best."""
    distance, label = Distance(model), np.array([y for _, y in texts])
    each = [np.clip(distance.distances(t), 0, MOST_DISTANCE) for t, _ in texts]
    counts = [np.bincount(np.concatenate([e for e, y in zip(each, label, strict=True) if y == c]), minlength=MOST_DISTANCE + 1) for c in (1, 0)]
    tail = [np.cumsum(c[::-1])[::-1] + 0.0 for c in counts]
    share = [(c + 2.0 * (t + 1) / (t[0] + 1)) / (c.sum() + 2.0) for c, t in zip(counts, tail, strict=True)]
    model.evidence = np.maximum.accumulate(np.clip(np.log(share[0] / share[1]), -2, 4))
    distance.evidence = model.evidence
    told = np.array([distance.of(t)[0] for t, _ in texts])
    best = (-1.0, 0.0)
    order = np.unique(told)
    for low, high in zip(np.r_[order[0] - 2, order], np.r_[order, order[-1] + 2], strict=True):
        said = told >= (low + high) / 2
        best = max(best, (round(said[label == 1].mean() + CLEAN_WEIGHT * (~said)[label == 0].mean(), 4), float((low + high) / 2)))
    model.threshold = best[1]
    return model


def train(texts: list[tuple[str, int]]) -> Model | None:
    """From (text, label) pairs; None where a label is missing or nothing sets it apart.

    The dictionaries come from three texts of four, the calibration from the rest, if both labels occur there.
    """
    texts = [texts[i] for i in without_copies([t for t, _ in texts])]
    rest, learnt = texts[::4], [x for i, x in enumerate(texts) if i % 4]
    if {y for _, y in rest} != {0, 1} or len(rest) < 20:
        learnt = rest = texts
    toxic, ordinary = [t for t, y in learnt if y == 1], [t for t, y in learnt if y == 0]
    made = dictionaries(toxic, ordinary) if toxic and ordinary else None
    return calibrated(Model(*made, np.zeros(MOST_DISTANCE + 1)), rest) if made else None


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 5, fold: int = 0, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model | None:
    rows = labelled(docs, labels, target, folds, fold, per_class, max_bytes).collect()
    return train([(r.text, r.label) for r in sorted(rows, key=lambda r: r.doc_id)])


def score(docs: DataFrame, model: Model | None, folds: int = 5, fold: int = 0, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted, windows`` for every row.

    ``windows`` counts the windows nearer to toxic text. A null or empty text has none. Without a model
    (no labelled rows of one kind) every score is 0. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model) if model else None
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                told = [distance.of(t) if distance else (0.0, 0) for t in texts.slice(a, b - a).to_pylist()]
                scores = [model.score(e) if model else 0.0 for e, _ in told]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64()), pa.array([n for _, n in told], pa.int64())], names=["doc_id", "score", "windows"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = own.mapInArrow(run, "doc_id long, score double, windows long")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "windows")
