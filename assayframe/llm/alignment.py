"""Alignment of two tokenizers' tokens by the bytes they cover.

Both tokenizers split words at a single space between two characters that aren't white space, so a text is encoded
word by word, and the ids of recent words are remembered. The tokens of a batch of documents are merged in lockstep: one
state vector holds, for each document (for a long one, for each run of words), a pointer into its A tokens and one into its B tokens;
each step compares the ends of all tokens pointed at, advances the pointers whose tokens end first, both where they end together,
which is a link and a cut, and compacts away what is finished.

How often a pair of ids is linked in the whole corpus is asked for by slices (``counting``).
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm import counting
from assayframe.llm.common import written
from assayframe.llm.packing import _byte_letters, slices as text_slices

#: Bytes of text merged at once, documents' bytes in a slice, bytes of a run of words, words remembered: bounds on memory only.
BATCH_BYTES, SLICE_BYTES, LANE_BYTES, CACHED_WORDS = 1_000_000, 16_000_000, 1024, 300_000
#: Tokens after which a lane of one long word goes on as another, and how many next ones are tried for a common end.
LANE_TOKENS, LOOK_AHEAD = 512, 32
#: How byte-level vocabularies split text (fixed pattern of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space that ends a word; where a text has other white space next to it, neither tokenizer need split there.
_BETWEEN, _OTHER_SPACE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s|^ | $")
SLICES = "slice long, n_links long, ids array<long>, a_counts array<int>, b_counts array<int>, links array<int>, shas array<string>, pairs binary, places binary"
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteLevel:
    """Ids and byte lengths of a byte-level vocabulary, given as a tokenizer's JSON file; special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if all(c in of for c in token)}
        for at, pair in enumerate(model["merges"]):  # merging by rank is the file's merging only if ids are in the order of merges
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if model["vocab"][left + right] != 256 + at:
                raise ValueError("the vocabulary's ids aren't in the order of its merges")
        ranks = {token: i for token, i in ranks.items() if i < 256 + len(model["merges"])}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def encode(self, words: list[str]) -> list[list[int]]:
        own = self.encoding.encode_ordinary
        return [own(" " + w) for w in words]


class Pieces:
    """Ids and byte lengths of a vocabulary of pieces, which puts a space before each text; whether they spell the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = self.model.id_to_piece(list(range(self.model.vocab_size())))
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("the vocabulary has pieces that go on after a space, so words can't be encoded by themselves")
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if self.model.is_byte(i) and (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array(list(map(len, self.bytes)), np.int32)

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)


@cache
def _encoders(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteLevel(a_path), Pieces(b_path)


class Words:
    """Both tokenizers' ids of words, remembered while there is room; None for a word that they don't both spell."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = _encoders(a_path, b_path)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = list(words)
        a, b = self.a.encode(new), self.b.encode(new)
        a_ids, a_cuts = _flat(a)
        b_ids, b_cuts = _flat(b)
        texts = [b" " + w.encode() for w in new]
        spelt = list(map(self.b.bytes.__getitem__, b_ids.tolist()))
        good = np.diff(np.concatenate([[0], np.cumsum(self.a.sizes[a_ids])])[a_cuts]) == np.fromiter(map(len, texts), np.int64, len(texts))
        if b"".join(spelt) != b"".join(texts):
            good &= [b"".join(spelt[s:e]) == t for s, e, t in zip(b_cuts[:-1].tolist(), b_cuts[1:].tolist(), texts, strict=True)]
        a_bytes, b_bytes = a_ids.tobytes(), b_ids.tobytes()
        a_cuts, b_cuts = (4 * a_cuts).tolist(), (4 * b_cuts).tolist()
        for k, (w, fine) in enumerate(zip(new, good.tolist(), strict=True)):
            self.known[w] = (a_bytes[a_cuts[k] : a_cuts[k + 1]], b_bytes[b_cuts[k] : b_cuts[k + 1]]) if fine else None


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers one after another, and where each list begins and ends."""
    cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]).astype(np.int64)
    return np.fromiter(itertools.chain.from_iterable(lists), "<u4", int(cuts[-1])), cuts


def words_of(text: str) -> list[str]:
    return _BETWEEN.split(text) if _OTHER_SPACE.search(text) else text.split(" ")


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens of A and of B end together, as places in both, in order.

    Lane k is a_ends[a_from[k]:a_to[k]] and what b_ends has from b_from[k] on up to the same end. All lanes advance together.
    """
    partner = np.full(len(a_ends), -1, np.int64)
    pa_, pb, last = a_from.copy(), b_from.copy(), a_to
    while len(pa_):
        x, y = a_ends[pa_], b_ends[pb]
        together = x == y
        partner[pa_[together]] = pb[together]
        pa_, pb = pa_ + (x <= y), pb + (y <= x)
        going = pa_ < last
        if not going.all():
            pa_, pb, last = pa_[going], pb[going], last[going]
    found = np.flatnonzero(partner >= 0)
    return found, partner[found]


def _split(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes' begins and ends in A and begins in B; a long lane, of one long word, goes on as another where tokens near every LANE_TOKENS-th end together."""
    sizes = np.diff(np.append(a_from, len(a_ends)))
    long = np.flatnonzero(sizes > 2 * LANE_TOKENS)
    if len(long):
        probes = np.concatenate([np.arange(a_from[k] + LANE_TOKENS, a_from[k] + sizes[k] - LANE_TOKENS, LANE_TOKENS) for k in long])
        near = probes[:, None] + np.arange(LOOK_AHEAD)
        place = np.searchsorted(b_ends, a_ends[near])
        same = b_ends[place] == a_ends[near]
        hit = np.flatnonzero(same.any(1))
        at = same[hit].argmax(1)
        a_from, b_from = np.append(a_from, near[hit, at] + 1), np.append(b_from, place[hit, at] + 1)
        order = np.argsort(a_from, kind="stable")
        a_from, b_from = a_from[order], b_from[order]
    return a_from, np.append(a_from[1:], len(a_ends)) if len(a_from) else a_from, b_from


def _spelt(n: int) -> np.ndarray:
    """Each id in decimal with each sign that may follow it."""
    out = np.empty(4 * n, object)
    for k, sign in enumerate((b",", b"|", b";", b"")):
        out[k::4] = [str(i).encode() + sign for i in range(n)]
    return out


class Merger:
    """Tokens, cuts, links and digests of batches of documents."""

    def __init__(self, a_path: str, b_path: str):
        self.words = Words(a_path, b_path)
        self.spelt = _spelt(max(len(self.words.a.sizes), len(self.words.b.sizes)))

    def merge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """For each text its numbers of A tokens, B tokens and links and its groups' digest, and all links as ``b << 32 | a``."""
        split = [words_of(t) if t else [] for t in texts]
        self.words.learn({w for ws in split for w in ws})
        of = self.words.known.__getitem__
        told = [list(map(of, ws)) for ws in split]
        told = [[] if None in pairs else pairs for pairs in told]
        flat = [p for pairs in told for p in pairs]
        a_flat, b_flat = [p[0] for p in flat], [p[1] for p in flat]
        a, b = np.frombuffer(b"".join(a_flat), np.uint32), np.frombuffer(b"".join(b_flat), np.uint32)
        a_ends, b_ends = np.cumsum(self.words.a.sizes[a], dtype=np.int64), np.cumsum(self.words.b.sizes[b], dtype=np.int64)
        a_words = np.concatenate([[0], np.cumsum(np.fromiter(map(len, a_flat), np.int64, len(flat)) // 4)])
        b_words = np.concatenate([[0], np.cumsum(np.fromiter(map(len, b_flat), np.int64, len(flat)) // 4)])
        doc_words = np.concatenate([[0], np.cumsum([len(p) for p in told])]).astype(np.int64)
        first = self._lanes(a_ends, a_words, doc_words)
        found, partner = lockstep(a_ends, b_ends, *_split(a_ends, b_ends, a_words[first], b_words[first]))
        a_cut, b_cut = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_cut[found], b_cut[partner] = True, True
        a_docs, b_docs = a_words[doc_words], b_words[doc_words]
        links = np.diff(np.searchsorted(found, a_docs))
        shas = self._digests(a, b, a_cut, b_cut, a_docs, b_docs)
        return np.diff(a_docs), np.diff(b_docs), links, shas, b[partner].astype(np.uint64) << np.uint64(32) | a[found].astype(np.uint64)

    @staticmethod
    def _lanes(a_ends: np.ndarray, a_words: np.ndarray, doc_words: np.ndarray) -> np.ndarray:
        """The words with which lanes begin: those of documents, and in long ones the first after each so many bytes."""
        begin = np.concatenate([[0], a_ends])[a_words[:-1]]  # bytes before each word
        starts = np.zeros(len(begin), bool)
        starts[doc_words[:-1][np.diff(doc_words) > 0]] = True
        since = begin - np.maximum.accumulate(np.where(starts, begin, 0)) if len(begin) else begin
        starts[1:] |= since[1:] // LANE_BYTES > since[:-1] // LANE_BYTES
        return np.flatnonzero(starts)

    def _digests(self, a, b, a_cut, b_cut, a_docs, b_docs) -> list[str]:
        a_last, b_last = np.flatnonzero(a_cut) + 1, np.flatnonzero(b_cut) + 1  # of each group
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        out = np.empty(len(a) + len(b), np.int64)
        sign_b = np.where(b_cut, 2, 0)
        sign_b[b_docs[1:][np.diff(b_docs) > 0] - 1] = 3
        out[np.arange(len(a)) + np.concatenate([[0], b_last])[a_group]] = a.astype(np.int64) * 4 + a_cut
        out[np.arange(len(b)) + (a_last[b_group] if len(b) else a_last)] = b.astype(np.int64) * 4 + sign_b
        ends = a_docs + b_docs
        said = self.spelt[out]
        return [hashlib.sha256(b"".join(said[s:e].tolist())).hexdigest() if e > s else "" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class _Slice:
    def __init__(self):
        self.lists, self.pairs, self.size = {k: [] for k in ("ids", "a_counts", "b_counts", "links", "shas")}, [], 0

    def add(self, ids: list, told: tuple) -> None:
        for name, values in zip(self.lists, (ids, *told[:4]), strict=True):
            self.lists[name].extend(values if isinstance(values, list) else values.tolist())
        self.pairs.append(told[4])

    def row(self, key: int) -> pa.RecordBatch:
        pairs = np.concatenate(self.pairs) if self.pairs else np.empty(0, np.uint64)
        every, place = np.unique(pairs, return_inverse=True)
        schema = [("slice", pa.int64()), ("n_links", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int32())) for c in ("a_counts", "b_counts", "links")], ("shas", pa.list_(pa.string())), ("pairs", pa.binary()), ("places", pa.binary())]
        values = [key, len(pairs), *self.lists.values(), counting.pack_sorted(every), counting.pack(place)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(values, schema, strict=True)], schema=pa.schema(schema))


def merged(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The written slices of a corpus with its documents' tokens merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, key, own = Merger(a_path, b_path), TaskContext.get().partitionId() << 24, _Slice()
        for batch in batches:
            for s, e in text_slices(batch.column(1), min(BATCH_BYTES, slice_bytes)):
                texts = batch.column(1).slice(s, e - s)
                own.add(batch.column(0).slice(s, e - s).to_pylist(), merger.merge(texts.to_pylist()))
                own.size += texts.nbytes
                if own.size >= slice_bytes:
                    yield own.row(key)
                    key, own = key + 1, _Slice()
        if own.lists["ids"]:
            yield own.row(key)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(own.mapInArrow(run, SLICES), "aligned-slices")


def _spread(pairs: np.ndarray) -> np.ndarray:
    """Pairs with their B id hashed, so that ranges are even; pairs of one B id stay together."""
    b = pairs >> np.uint64(32)
    return (b * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) << np.uint64(32) | pairs & np.uint64(0xFFFFFFFF)


def _question(row: dict) -> Iterator[counting.Question]:
    pairs = counting.unpack_sorted(row["pairs"].as_py())
    keys, n = _spread(pairs), np.bincount(counting.unpack(row["places"].as_py()).astype(np.int64), minlength=len(pairs))
    order = np.argsort(keys)
    yield 1, keys[order], n[order][None, :]


def _best(_: int, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Each pair's count, and whether its B id has no more frequent one."""
    n = counts[0]
    starts = np.flatnonzero(np.diff(keys >> np.uint64(32), prepend=np.uint64(2**33)))
    most = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(n))))
    return np.stack([n, (n == most).astype(np.int64)]), [len(n), int(n.sum())]


RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def _resolve(row: dict, answers: dict[int, np.ndarray]) -> dict:
    links = np.array(row["links"].as_py(), np.int64)
    ends = np.cumsum(links)
    pairs = counting.unpack_sorted(row["pairs"].as_py())
    count = best = np.zeros(len(pairs), np.int64)
    if 1 in answers:
        back = np.empty(len(pairs), np.int64)
        back[np.argsort(_spread(pairs))] = np.arange(len(pairs))
        count, best = answers[1].astype(np.int64)[:, back]
    place = counting.unpack(row["places"].as_py()).astype(np.int64)
    over = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[place])])[np.concatenate([[0], ends])])
    return {"doc_id": row["ids"].values, "n_a": row["a_counts"].as_py(), "n_b": row["b_counts"].as_py(), "n_groups": links, "n_links": links, "n_best": over(best), "count_sum": over(count), "groups_sha256": row["shas"].values}


def align(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Tokens are those of space and text. Null and empty texts, and texts that the tokens of A or B don't spell, have
    none: zeros and an empty digest. Every group ends with the one link of its last tokens, so there are as many links as groups.
    Null ids stay null, repeated rows are documents of their own, other columns are not read, an empty table gives an empty table.
    A text that has no single space between other signs is one word: it is encoded whole, and merged in lanes where tokens end together.
    """
    spark = docs.sparkSession
    slices = merged(docs, a_path, b_path, slice_bytes)
    asked = counting.ask(slices.select("slice", "pairs", "places"), _question, counting.n_buckets(spark, 0))
    answers = counting.answered(asked, _best)
    own = slices.select("slice", "ids", "a_counts", "b_counts", "links", "shas", "pairs", "places")
    return counting.joined(own, answers, _resolve, COLUMNS, RESULT)


def links_of(text: str, a_path: str, b_path: str) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """One text's ids of A and of B, and its links as places in both: for a look at a document."""
    merger = Merger(a_path, b_path)
    words = words_of(text) if text else []
    merger.words.learn(set(words))
    told = [merger.words.known[w] for w in words]
    if None in told or not told:
        return [], [], []
    a, b = (np.frombuffer(b"".join([p[k] for p in told]), np.uint32) for k in (0, 1))
    a_ends, b_ends = np.cumsum(merger.words.a.sizes[a]), np.cumsum(merger.words.b.sizes[b])
    found, partner = lockstep(a_ends, b_ends, np.array([0]), np.array([len(a)]), np.array([0]))
    return a.tolist(), b.tolist(), list(zip(found.tolist(), partner.tolist(), strict=True))
