"""Benchmark decontamination by the q-gram lemma.

A passage of m bytes that occurs in a text with at most k edits shares at least
m - q + 1 - k q of its q-grams with it, and these lie on at most k + 1
neighbouring diagonals (place in the text less place in the passage). So
diagonals are cut into bands of 2 (k + 1), each overlapping the next by half;
bands with enough shared q-grams are kept, and an alignment along the band's
diagonals decides, at a cost of m k. Nothing within the edit budget is missed.

Texts and passages are compared as UTF-8 bytes with A-Z lower-cased and every run of
other ASCII signs and spaces taken for one space; a passage's own ends are stripped. The benchmark is the query set: its
passages go to the tasks in blocks of at most ``block_bytes``, the texts are read
once for each block and never shuffled.

A text is gone through in overlapping pieces, and the places that share q-grams with passages are
expanded so many at a time, with sparse counts; so memory is bounded however long a text is, and however
often a q-gram occurs. Passages of less than q bytes are never found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.llm.common import fresh
from assayframe.llm.packing import slices

Q, EDITS, BLOCK_BYTES, SIEVE_BITS = 8, 0.1, 4_000_000, 22
#: Bytes of a text looked at together, and places with their passages expanded together: bounds on memory only.
PIECE_BYTES, EXPANDED = 1 << 18, 2_000_000
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_FAR = 1 << 40


def _kept(told: np.ndarray) -> np.ndarray:
    """All but the spaces that follow a space."""
    blank = told == 32
    kept = np.ones(len(told), bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    return kept


def plain(text: bytes) -> bytes:
    """The bytes that are compared."""
    told = np.frombuffer(text.translate(PLAIN), np.uint8)
    return told[_kept(told)].tobytes()


def _origin(kept: np.ndarray, place: int) -> int:
    """Where the byte at a place of the compared text is in the text itself; looked up block by block."""
    at = 0
    for at in range(0, len(kept), 1 << 16):
        here = int(np.count_nonzero(kept[at : at + (1 << 16)]))
        if place < here:
            return at + int(np.flatnonzero(kept[at : at + (1 << 16)])[place])
        place -= here
    return len(kept)


def budget(m: int, edits: float = EDITS) -> int:
    """Edits allowed in a passage of m bytes: its share, and no more than leave a q-gram whole for certain."""
    return max(0, min(int(edits * m), (m - Q) // Q))


def _along(a: np.ndarray, b: np.ndarray, low: int, width: int, free: bool, most: int) -> np.ndarray | None:
    """For each of ``width`` diagonals from ``low`` on the least edits between the whole of a and what of b ends there.

    What it begins with is free, or else b's beginning. None if all are above ``most``.
    """
    m, at = len(a), np.arange(width)
    other = np.full(m + width + 1, 256, np.int16)  # other[i + d] is the byte of b that a's i-th meets on diagonal d
    first, last = max(0, 1 - low), min(len(other), len(b) + 1 - low)
    if last > first:
        other[first:last] = b[first + low - 1 : last + low - 1]
    begin = low + at
    row = np.where((begin >= 0) & (begin <= len(b)), 0 if free else begin, _FAR)
    for i, c in enumerate(a.tolist(), 1):
        best = row + (other[i : i + width] != c)
        np.minimum(best[:-1], row[1:] + 1, out=best[:-1])
        row = np.minimum.accumulate(best - at) + at
        if row.min() > most:
            return None
    row[m + low + at > len(b)] = _FAR
    return row if row.min() <= most else None


def align(passage: bytes, text: bytes, diagonal: int, most: int) -> tuple[int, int, int] | None:
    """The least edits, ``most`` at most, that turn a part of the text into the passage, with where it begins and ends.

    The part shares q-grams with the passage on 2 (most + 1) diagonals from ``diagonal`` on, so its
    alignment doesn't leave these by more than ``most``.
    """
    m, low, width = len(passage), diagonal - most, 4 * most + 2
    base = max(0, low)
    a, b = np.frombuffer(passage, np.uint8), np.frombuffer(text, np.uint8)[base : max(0, low + width + m)]
    if (row := _along(a, b, low - base, width, True, most)) is None:
        return None
    edits, end = int(row.min()), m + low - base + int(row.argmin())
    back = _along(a[::-1], b[:end][::-1], -edits, 2 * edits + 1, False, edits)
    return edits, base + end - (m - edits + int(back.argmin())), base + end


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    every, of = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(of, np.concatenate(counts)).astype(np.int64)


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


@dataclass
class Block:
    """Some passages and the index of their q-grams: sorted codes, and of each posting its passage and place."""

    ids: list[int]
    passages: list[bytes]
    edits: np.ndarray
    codes: np.ndarray
    of: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    least: np.ndarray  # shared q-grams that an occurrence within the budget has at least
    reach: int  # bytes that no occurrence exceeds

    @staticmethod
    def codes_of(data: bytes) -> np.ndarray:
        """The q-gram that begins at each byte, as a number."""
        return np.ndarray((max(len(data) - Q + 1, 0),), "<u8", data, strides=(1,)) if len(data) >= Q else np.empty(0, np.uint64)

    @staticmethod
    def spot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE_BITS)

    @classmethod
    def build(cls, items: list[tuple[int, bytes]], edits: float = EDITS) -> Block:
        items = [(i, t) for i, t in ((i, plain(t).strip()) for i, t in items) if len(t) >= Q]
        codes = [cls.codes_of(t) for _, t in items]
        of = np.repeat(np.arange(len(items), dtype=np.int32), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes]) if codes else np.empty(0, np.int32)
        codes = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[cls.spot(codes)] = True
        k = np.array([budget(len(t), edits) for _, t in items], np.int64)
        m = np.array([len(t) for _, t in items], np.int64)
        reach = max(1024, int((m + k).max(initial=0)))
        return cls([i for i, _ in items], [t for _, t in items], k, codes[order], of[order], place[order], sieve, m - Q + 1 - Q * k, reach)

    def _expanded(self, codes: np.ndarray, spots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place in the text, passage and place in the passage of every shared q-gram, a bounded number at a time."""
        low = np.searchsorted(self.codes, codes[spots], "left")
        many = np.searchsorted(self.codes, codes[spots], "right") - low
        upto = np.cumsum(many)
        cut = 0
        while cut < len(spots):
            done = int(upto[cut - 1]) if cut else 0
            end = max(cut + 1, int(np.searchsorted(upto, done + EXPANDED, "right")))
            n = many[cut:end]
            posting = np.repeat(low[cut:end] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield np.repeat(spots[cut:end], n), self.of[posting], self.place[posting]
            cut = end

    def bands(self, text: bytes) -> list[tuple[int, int]]:
        """(passage, first diagonal) of the bands with enough shared q-grams."""
        codes, n = self.codes_of(text), len(self.ids)
        spots = np.flatnonzero(self.sieve[self.spot(codes)])
        parts = self._expanded(codes, spots)
        held, keys, counts = [], [], []
        for part in parts:  # an occurrence lies in two neighbouring stretches of the text; those with too few of a passage's q-grams leave
            key, count = np.unique(part[0] // self.reach * n + part[1], return_counts=True)
            keys.append(key)
            counts.append(count)
            held = [part] if len(keys) == 1 else []
        if not keys:
            return []
        key, count = _summed(keys, counts)
        follows = _among(key, key + n)
        two = count.copy()
        two[follows] += count[np.searchsorted(key, key[follows] + n)]
        enough = key[two >= self.least[key % n]]
        if not len(enough):
            return []
        alive = np.unique(np.concatenate([enough, enough + n]))
        keys, counts = [], []
        for spot, item, place in held or self._expanded(codes, spots):
            stay = _among(alive, spot // self.reach * n + item)
            item, diagonal = item[stay].astype(np.int64), spot[stay] - place[stay]
            band = diagonal // (self.edits[item] + 1)
            key, count = np.unique((np.concatenate([item, item]) << 40) + np.concatenate([band, band - 1]) + (1 << 39), return_counts=True)
            keys.append(key)
            counts.append(count)
        key, count = _summed(keys, counts)
        item = key >> 40
        band = (key & ((1 << 40) - 1)) - (1 << 39)
        enough = count >= self.least[item]
        return [(int(i), int(b * (self.edits[i] + 1))) for i, b in zip(item[enough], band[enough], strict=True)]

    def matches(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, edits, begin, end) of each passage's best occurrence within the budget."""
        if not self.ids or len(text) < Q:
            return []
        told = np.frombuffer(text.translate(PLAIN), np.uint8)
        kept = _kept(told)
        text = told[kept].tobytes()
        size = max(PIECE_BYTES, 4 * self.reach)
        best: dict[int, tuple[int, int, int]] = {}
        exact = set()
        for at in range(0, max(len(text) - self.reach, 1), size - self.reach):
            for i, diagonal in self.bands(text[at : at + size]):
                if i in exact:
                    continue
                k, passage = int(self.edits[i]), self.passages[i]
                if i not in best and (found := text.find(passage)) >= 0:  # no alignment betters an occurrence without edits
                    best[i] = (0, found, found + len(passage))
                    exact.add(i)
                elif aligned := align(passage, text, at + diagonal, k):
                    best[i] = min(best.get(i, aligned), aligned)
        return [(self.ids[i], edits, _origin(kept, a), _origin(kept, b - 1) + 1) for i, (edits, a, b) in sorted(best.items())]


def blocks(benchmark: DataFrame, edits: float = EDITS, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes``. Null and shorter passages than a q-gram match nothing."""
    own = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).filter(F.octet_length("text") >= Q)
    held, size = [], 0
    for row in own.orderBy("id", "text").toLocalIterator():
        if held and size + len(row.text) > block_bytes:
            yield Block.build(held, edits)
            held, size = [], 0
        held.append((row.id, bytes(row.text)))
        size += len(row.text)
    yield Block.build(held, edits)


MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def with_matches(docs: DataFrame, block: Block, column: str, text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, with one more of the given name: the block's passages in each whole text."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))
    shared, at = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.matches
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            for a, b in slices(texts):
                found = [[dict(zip(("item_id", "edits", "begin", "end"), m, strict=True)) for m in find(t or b"")] for t in texts.slice(a, b - a).to_pylist()]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], schema=pa.schema([*batch.schema, pa.field(column, kind)]))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, MATCH)]))


def find(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, edits, begin, end`` for every passage that a text has within the edit budget.

    begin and end count bytes of the whole text as it is; of several occurrences the best, then the first, is given.
    Null and empty texts have none. Repeated rows give repeated matches, and a benchmark row that repeats
    another's text gives its own. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks(benchmark, edits, block_bytes):
        some = with_matches(own, block, "found").select("doc_id", F.inline("found"))
        out = some if out is None else out.unionByName(some)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text has no passage of the benchmark; all columns stay as they are."""
    found = fresh(docs, "found")
    for block in blocks(benchmark, edits, block_bytes):
        docs = with_matches(docs, block, found).filter(F.size(found) == 0).drop(found)
    return docs
