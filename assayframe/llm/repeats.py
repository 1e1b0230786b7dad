"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Every window of ``depth`` bytes is a suffix cut off at that depth. Sorting goes
by most-significant digits, and a suffix that is alone in its group after any
digit leaves the sort. What is left equal at full depth are the repeats.

First digit: a window is assigned to its anchor, the ``gram`` bytes within it
with the least hash. Equal windows have equal anchors at equal places, so the
anchor's hash is a digit that whole runs of neighbouring windows share: one row
stands for all windows of an anchor, some seventy at a time. Anchors that occur
once leave.

Second digit: the hash of all the text that an anchor's windows cover. Where it
occurs twice, all these windows are repeats. One representative of it goes on,
with the anchors whose surroundings are unique, if the anchor has at least two
different surroundings: there some of the windows may be equal.

Further digits: the bytes of these windows, eight at a time, down to the depth.
An anchor with more than ``crowd`` different surroundings isn't sorted in one
task; its windows are counted by their 128-bit hashes in a grouped count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import meet, written
from assayframe.llm.packing import slices

BASE, MIX = 0x9E3779B97F4A7C15 | 1, 0xFF51AFD7ED558CCD
#: Window starts handled at once; their indices take the low bits of an anchor's order.
CHUNK, INDEX_BITS = 1 << 21, 22
#: About so many rows, and all of an anchor, are sorted at once.
SORTED_ROWS = 4_000
ANCHORS = "doc_id long, body long, key long, around long, at long, n int, into int"


class Anchors:
    """Anchors of the windows of a buffer: ``start`` and number ``n`` of an anchor's windows, its place and its gram's hash."""

    def __init__(self, depth: int, gram: int):
        self.depth, self.gram, self.width = depth, gram, depth - gram + 1
        size = CHUNK + depth + 1
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)])
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(BASE, -1, 1 << 64), np.uint64)])

    def _hashes(self, text: np.ndarray) -> np.ndarray:
        sums = np.empty(len(text) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.power[: len(text)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: len(text) - self.gram + 1]
        h ^= h >> np.uint64(33)
        h *= np.uint64(MIX)
        return h ^ (h >> np.uint64(33))

    def of(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """ends: where the documents of the buffer end."""
        found = []
        for a in range(0, max(len(text) - self.depth + 1, 0), CHUNK):
            part = text[a : a + CHUNK + self.depth - 1]
            h = self._hashes(part)
            least = (h & ~np.uint64((1 << INDEX_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
            span = 1
            while 2 * span <= self.width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < self.width:
                least = np.minimum(least[: len(least) - (self.width - span)], least[self.width - span :])
            anchor = (least & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)
            start = np.arange(len(anchor))
            doc = np.searchsorted(ends, start + a, "right")
            inside = start + a + self.depth <= ends[np.minimum(doc, len(ends) - 1)]
            start, anchor = start[inside], anchor[inside]
            if len(start):
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
                found.append((start[new] + a, np.diff(np.r_[new, len(start)]), anchor[new] + a, h[anchor[new]].view(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4


def _bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))


def anchors(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """A row per anchor: its document, hash ``key``, hash ``around`` of all its windows' text,
    the first window's place ``at``, the number ``n`` of windows, and how far the anchor is ``into`` the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(depth, gram)
        for batch in batches:
            column = batch.column(2)
            for a, b in slices(column):
                texts = column.slice(a, b - a).to_pylist()
                joined = b"".join(texts)
                sizes = np.array([len(t) for t in texts], np.int64)
                ends = np.cumsum(sizes)
                start, n, anchor, key = find.of(np.frombuffer(joined, np.uint8), ends)
                around = [xxhash.xxh3_64_intdigest(joined[s:e]) for s, e in zip(start.tolist(), (start + n + depth - 1).tolist(), strict=True)]
                doc = np.searchsorted(ends, start, "right")
                first = (ends - sizes)[doc]
                rows = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key), pa.array(np.array(around, np.uint64).view(np.int64)), pa.array(start - first), pa.array(n.astype(np.int32)), pa.array((anchor - start).astype(np.int32))],
                    names=["doc_id", "body", "key", "around", "at", "n", "into"],
                )

    return texts.filter(F.octet_length("text") >= depth).mapInArrow(run, ANCHORS)


def repeated_windows(group: np.ndarray, text: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Which of the windows at ``start`` equal another of the same group: most-significant digit first, eight bytes a digit."""
    alive = np.arange(len(start))
    wide = np.r_[text, np.zeros(8, np.uint8)]
    for d in range(0, depth, 8):
        if not len(alive):
            break
        digit = np.zeros(len(alive), np.uint64)
        for j in range(d, min(d + 8, depth)):
            digit = (digit << np.uint64(8)) | wide[start[alive] + j]
        order = np.lexsort((digit, group))
        alive, digit, group = alive[order], digit[order], group[order]
        new = np.r_[True, (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])]
        keep = ~(new & np.r_[new[1:], True])  # not alone
        group, alive = np.cumsum(new)[keep], alive[keep]
    out = np.zeros(len(start), bool)
    out[alive] = True
    return out


def _sort(depth: int):
    """Sorts the windows of all anchors of a batch; the rows of an anchor come together."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        parts = rows.column("text").to_pylist()
        size = np.array([len(p) for p in parts], np.int64)
        n = size - depth + 1
        base = np.cumsum(size) - size
        row = np.repeat(np.arange(len(parts)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        key, into = rows.column("key").to_numpy(), rows.column("into").to_numpy()
        place = (into[row] - j).astype(np.int64)  # how far the anchor is into this window
        group = np.unique(key, return_inverse=True)[1][row] * (depth + 1) + place
        same = repeated_windows(group, np.frombuffer(b"".join(parts), np.uint8), base[row] + j, depth)
        same &= rows.column("single").to_numpy()[row]
        hits = np.flatnonzero(same)
        new = np.flatnonzero(np.r_[True, (hits[1:] != hits[:-1] + 1) | (row[hits[1:]] != row[hits[:-1]])]) if len(hits) else hits
        first, count = hits[new], np.diff(np.r_[new, len(hits)])
        at = rows.column("at").to_numpy()[row[first]] + j[first]
        take = pa.array(row[first])
        return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks().take(take), rows.column("body").combine_chunks().take(take), pa.array(at), pa.array(at + count + depth - 1)], names=["doc_id", "body", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = held.column("key").to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(1, np.int64)
            cut = int(starts[-1])  # the last anchor may go on in the next batch
            ends = starts[np.searchsorted(starts, np.arange(SORTED_ROWS, cut, SORTED_ROWS))]
            a = 0
            for b in [*ends.tolist(), cut]:
                if a < b:
                    yield found(held.slice(a, b - a))
                    a = b
            held = held.slice(cut)
        if held is not None and len(held):
            yield found(held)

    return run


def _crowded(rows: DataFrame, depth: int) -> DataFrame:
    """The same by a grouped count of the windows' hashes, for anchors with very many surroundings."""
    j = F.explode(F.sequence(F.lit(0), F.octet_length("text") - depth)).alias("j")
    w = F.col("text").substr(F.col("j") + 1, F.lit(depth))
    windows = rows.select("*", j).select("doc_id", "body", "single", (F.col("at") + F.col("j")).alias("first"), F.xxhash64(w).alias("h"), F.xxhash64(F.lit(1), w).alias("g"))
    windows = written(windows, "windows")
    many = windows.groupBy("h", "g").count().filter("count > 1")
    return windows.filter("single").join(many, ["h", "g"], "left_semi").select("doc_id", "body", "first", (F.col("first") + depth).alias("last"))


def repeated_spans(texts: DataFrame, depth: int = 200, gram: int = 64, crowd: int = 2_000) -> DataFrame:
    """``doc_id, body, spans``: per document the byte ranges (first, last past the end) of its repeated windows, unmerged."""
    rows = written(anchors(texts, depth, gram), "anchors")
    often = written(rows.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1"), "anchor_counts")
    rows = written(meet(rows, often, "key", "often").drop("often"), "repeated_anchors")
    one = F.min(F.struct("doc_id", "body", "at", "n", "into")).alias("one")
    groups = written(rows.groupBy("key", "around").agg(F.count("*").alias("size"), one), "surroundings")
    whole = rows.join(groups.filter("size > 1").select("key", "around"), ["key", "around"])
    whole = whole.select("doc_id", "body", F.col("at").alias("first"), (F.col("at") + F.col("n") + depth - 1).alias("last"))

    mixed = groups.groupBy("key").agg(F.count("*").alias("ways")).filter("ways > 1")
    mixed = groups.join(mixed, "key").select("key", "ways", (F.col("size") == 1).alias("single"), "one.*")
    wanted = mixed.groupBy("doc_id", "body").agg(F.collect_list(F.struct("key", "ways", "single", "at", "n", "into")).alias("w")).withColumnRenamed("doc_id", "of_id").withColumnRenamed("body", "of_body")
    same = texts["doc_id"].eqNullSafe(wanted["of_id"]) & (texts["body"] == wanted["of_body"])
    cut = texts.join(wanted, same).select("doc_id", "body", F.inline(F.transform("w", lambda w: F.struct(*[w[c].alias(c) for c in ("key", "ways", "single", "at", "into")], F.col("text").substr((w["at"] + 1).cast("int"), w["n"] + depth - 1).alias("text")))))
    cut = written(cut, "windows_text")
    schema = "doc_id long, body long, first long, last long"
    sorted_ = cut.filter(F.col("ways") <= crowd).repartition("key").sortWithinPartitions("key").mapInArrow(_sort(depth), schema)
    spans = whole.unionByName(sorted_)
    rest = cut.filter(F.col("ways") > crowd)
    if not rest.isEmpty():
        spans = spans.unionByName(_crowded(rest, depth))
    return spans.groupBy("doc_id", "body").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def remove_repeats(docs: DataFrame, depth: int = 200, gram: int = 64, crowd: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for every row.

    ``kept`` are the bytes left (possibly not valid UTF-8: cuts fall anywhere),
    ``spans`` the maximal removed runs as (first, last past the end).
    Null text counts as empty and texts shorter than the depth never lose a byte. Rows
    that repeat both id and text repeat each other, so both lose all. Rows without
    an id take part like others. Other columns are not read.
    """
    texts = _bytes(docs, id_col, text_col)
    found = repeated_spans(texts, depth, gram, crowd).withColumnRenamed("doc_id", "of_id").withColumnRenamed("body", "of_body")
    same = texts["doc_id"].eqNullSafe(found["of_id"]) & (texts["body"] == found["of_body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                own = texts.slice(a, b - a).to_pylist()
                runs = [merged(s) for s in batch.column(2).slice(a, b - a).to_pylist()]
                kept = [b"".join(t[e:s] for e, s in zip([0, *(e for _, e in r)], [*(s for s, _ in r), len(t)], strict=True)) if r else t for t, r in zip(own, runs, strict=True)]
                spans = [[{"first": s, "last": e} for s, e in r] for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in own], pa.int64()), pa.array([sum(e - s for s, e in r) for r in runs], pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept binary"
    return texts.join(found, same, "left").select("doc_id", "text", "spans").mapInArrow(run, schema)

