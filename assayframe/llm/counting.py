"""Corpus-wide counts for slices of a corpus that are too many to broadcast and too dear to look up row by row.

A slice is a bounded run of documents in one row of a written table. It asks for its distinct
keys once each, with its own counts, in packed blocks dealt by ranges of hashed keys; a range sums
what all slices say and answers each slice in the order of its question. So a key that every
document has is one entry for each slice, not one for each document, no key is ever gathered with
its documents, and a slice goes on by itself with exact counts of all its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASKED = "kind int, bucket int, slice long, keys binary, counts binary"
ANSWERED = "slice long, kind int, bucket int, answer binary, facts array<long>"
#: Keys that a range answers at once, on average.
RANGE_KEYS = 2_000_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (finaliser with fixed public multipliers)."""
    keys = (keys ^ (keys >> np.uint64(30))) * _MIX[0]
    keys = (keys ^ (keys >> np.uint64(27))) * _MIX[1]
    return keys ^ (keys >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of 0 and more as planes of their bytes, compressed; few bytes where they are small."""
    least = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    plain = np.ascontiguousarray(values.astype(least))
    planes = plain.view(np.uint8).reshape(-1, least.itemsize).T
    return bytes([least.itemsize]) + len(plain).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, size * n)), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}").reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).astype(np.uint64), dtype=np.uint64)


#: What a slice asks: a kind of key, the distinct keys in ascending order, and rows of counts for each.
Question = tuple[int, np.ndarray, np.ndarray]


def ask(slices: DataFrame, question: Callable[[dict], Iterator[Question]], buckets: int) -> DataFrame:
    """The packed questions of all slices; ``question`` gets a slice's row and yields its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                out: dict[str, list] = {"kind": [], "bucket": [], "slice": [], "keys": [], "counts": []}
                for kind, keys, counts in question(row):
                    cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(cut)).tolist():
                        at = slice(cut[b], cut[b + 1])
                        for name, value in zip(out, (kind, b, row["slice"].as_py(), pack_sorted(keys[at]), pack(counts[:, at].ravel())), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return slices.mapInArrow(run, ASKED)


def answered(asked: DataFrame, answer: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, list[int]]]) -> DataFrame:
    """For each question ``slice, kind, bucket, answer``, with ``facts`` of the range at one of them.

    ``answer`` gets a kind, the range's distinct keys and their summed counts (a row for each count asked), and gives
    rows of numbers to send back for each key, with numbers that describe the range as a whole.
    """

    def run(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        counts = [unpack(x).astype(np.int64).reshape(-1, len(k)) for x, k in zip(table["counts"].to_pylist(), keys, strict=True)]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros((len(counts[0]), len(every)), np.int64)
        for row, given in zip(sums, np.concatenate(counts, axis=1), strict=True):
            np.add.at(row, place, given)
        told, facts = answer(table["kind"][0].as_py(), every, sums)
        ends = np.cumsum([len(k) for k in keys])
        back = [pack(told[:, place[e - len(k) : e]].ravel()) for e, k in zip(ends.tolist(), keys, strict=True)]
        return pa.table({"slice": table["slice"], "kind": table["kind"], "bucket": table["bucket"], "answer": pa.array(back, pa.binary()), "facts": pa.array([facts, *[None] * (len(back) - 1)], pa.list_(pa.int64()))})

    return asked.groupBy("kind", "bucket").applyInArrow(run, ANSWERED)


def joined(slices: DataFrame, answers: DataFrame, f: Callable[[dict, dict[int, np.ndarray]], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    """Each slice with its answers: ``f`` gets the slice's row and, for each kind, rows of numbers in the order of its keys."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds: dict[int, list[tuple[int, bytes]]] = {}
        for kind, bucket, data in zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["answer"].to_pylist(), strict=True):
            kinds.setdefault(kind, []).append((bucket, data))
        rows = left.num_rows
        if not rows:
            return arrow.empty_table()
        per = {}
        for kind, parts in kinds.items():
            parts.sort()
            size = ANSWER_ROWS
            per[kind] = np.concatenate([unpack(d).reshape(size, -1) for _, d in parts], axis=1)
        row = {name: left[name][0] for name in left.column_names}
        return pa.Table.from_pydict(f(row, per), schema=arrow)

    return slices.groupBy("slice").cogroup(answers.select("slice", "kind", "bucket", "answer").groupBy("slice")).applyInArrow(run, schema)


#: Numbers that an answer has for each key.
ANSWER_ROWS = 2


def n_buckets(spark, keys: int) -> int:
    """Ranges enough for so many keys, and for the session's shuffles."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // RANGE_KEYS), 1)


def facts(answers: DataFrame, kind: int) -> list[int]:
    """The sums of what the ranges of a kind say of themselves; [0, 0] where there are none."""
    own = answers.filter((F.col("kind") == kind) & F.col("facts").isNotNull()).select(F.col("facts")[0].alias("a"), F.col("facts")[1].alias("b"))
    row = own.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return [int(x) for x in row]
