"""Identities of data, and results kept and found by them.

A row's digest with its number of copies, then one over the sorted digests of each bucket, then one over
the buckets and the method: equal exactly for the same rows and method, whatever
the partitioning. Tasks count copies and pack their digests by bucket, so packs are shuffled and not rows, and a bucket gathers a row with many copies once for each half a million rows of a task at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leading hexadecimal digits of a digest that name its bucket: 4,096 buckets.
BUCKET_DIGITS = 3
#: Digests that a task packs at a time: 16 MB.
PACKED_ROWS = 1 << 19
PACKED = "b int, d binary, n array<long>"


def row_digest(columns: list[str]):
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def _counted(digests: np.ndarray, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different digests in order, and the copies of each."""
    if copies is None:
        return np.unique(digests, return_counts=True)
    order = np.argsort(digests)
    digests = digests[order]
    first = np.flatnonzero(np.concatenate([[True], digests[1:] != digests[:-1]]))
    return digests[first], np.add.reduceat(copies[order], first)


def _pack(batches):
    """A task's digests by bucket, each different one once."""
    for digests in _chunks(batches):
        d, n = _counted(digests)
        lead = d.view(np.uint8).reshape(-1, 32)[:, :2].astype(np.int64)
        b = (lead[:, 0] << 8 | lead[:, 1]) >> (16 - 4 * BUCKET_DIGITS)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        ends = np.append(first, b.size).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), first.size, [None, pa.py_buffer(ends * np.int32(32)), pa.py_buffer(d)])
        yield pa.RecordBatch.from_arrays([pa.array(b[first], pa.int32()), packed, pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))], ["b", "d", "n"])


def _digests(column: pa.Array) -> np.ndarray:
    """The digests of 32 bytes, or packs of them, one after another."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("S32")


def _chunks(batches):
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_digests(batch.column(0)))
            size += batch.num_rows
        if size >= PACKED_ROWS:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _buckets(batches):
    """``b`` and the digests and copies of its packs, which lie one after another."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        b, d, n = batch.column("b").to_numpy(), _digests(batch.column("d")), batch.column("n").flatten().to_numpy()
        first = np.flatnonzero(np.diff(b, prepend=-1))
        starts = np.append(0, np.cumsum(batch.column("n").value_lengths().to_numpy()))[first]
        for k, start, stop in zip(b[first].tolist(), starts, np.append(starts[1:], n.size)):
            if held and k != name:
                yield name, held
                held = []
            name = k
            held.append((d[start:stop], n[start:stop]))
    if held:
        yield name, held


def _digest_buckets(batches):
    """``b, h, n``: a digest over each bucket."""
    out = []
    for b, packs in _buckets(batches):
        d, n = _counted(np.concatenate([d for d, _ in packs]), np.concatenate([n for _, n in packs]))
        told = ",".join(f"{x}:{k}" for x, k in zip(d.tobytes().hex(",", -32).split(","), n.tolist()))
        out.append((b, hashlib.sha256(told.encode()).hexdigest(), int(n.sum())))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int64()))], ["b", "h", "n"])


def data_identity(df: DataFrame, columns: list[str], method: str = "") -> DataFrame:
    """One row ``identity, rows``."""
    packs = df.select(F.unhex(row_digest(columns)).alias("d")).mapInArrow(_pack, PACKED)
    buckets = packs.repartition("b").sortWithinPartitions("b").mapInArrow(_digest_buckets, "b int, h string, n long")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ",")
    return buckets.agg(F.sha2(F.concat(F.lit(f"{method}\n"), whole), 256).alias("identity"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def reusable(requests: DataFrame, results: DataFrame, contract: str) -> DataFrame:
    """The requests (with ``identity``) that a completed result of the same contract answers."""
    done = results.filter((F.col("status") == "completed") & (F.col("contract") == contract))
    return requests.join(done.select("identity").distinct(), "identity", "left_semi")


def check_unchanged(df: DataFrame, columns: list[str], requested: str, method: str = "") -> None:
    if data_identity(df, columns, method).first()["identity"] != requested:
        raise ValueError("the source changed since the analysis was requested")


def restore_or_compute(manifest: DataFrame | None, source: str, identity: str, compute, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(features, manifest row): the stored features if source, identity and checksum all match, else computed and stored at ``path``.

    ``manifest (source, identity, path, checksum)`` is what earlier calls returned, one row each.
    """
    if manifest is not None:
        hit = manifest.filter((F.col("source") == source) & (F.col("identity") == identity)).limit(1).collect()
        if hit:
            stored = manifest.sparkSession.read.parquet(hit[0].path)
            if data_identity(stored, columns).first()["identity"] == hit[0].checksum:
                return stored, manifest.sparkSession.createDataFrame([tuple(hit[0])], manifest.schema)
    made = compute()
    made.write.mode("overwrite").parquet(path)
    stored = made.sparkSession.read.parquet(path)
    checksum = data_identity(stored, columns).first()["identity"]
    return stored, made.sparkSession.createDataFrame([(source, identity, path, checksum)], "source string, identity string, path string, checksum string")


def read_stored(manifest: DataFrame, source: str, identity: str, columns: list[str]) -> DataFrame:
    """The stored features; a missing or damaged artifact is an error."""
    hit = manifest.filter((F.col("source") == source) & (F.col("identity") == identity)).limit(1).collect()
    if not hit:
        raise LookupError(f"no stored features of {source} with this identity")
    stored = manifest.sparkSession.read.parquet(hit[0].path)
    if data_identity(stored, columns).first()["identity"] != hit[0].checksum:
        raise ValueError(f"the stored features of {source} are not what was written")
    return stored
