"""Chat formatting by columnar byte assembly, and its reader.

A conversation's text is its turns' segments, one after another. A segment is an
opening mark, the escaped text and a closing mark; control strings within a
text are escaped, so that they can't end or begin a turn. Sorted turns are assembled a
slice at a time: lengths, cumulative offsets and scatter indices in numpy, heads, texts and closings
copied into one preallocated Arrow buffer, whose offsets are then set at the ends of conversations.

A conversation comes as one row, or as numbered chunks where it goes on in the next slice, so one of any
length takes as much memory as a slice and a turn. The reader sees conversation, chunk number, text and loss
mask only, finds turns by their marks, and takes chunks that are cut anywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.packing import SLICE_BYTES, slices

#: Opening and closing marks by role; any other role is named in its opening mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE {}] ", " [/ROLE]")
LOSS_ROLE = "assistant"

FORMATTED = "conv_id long, chunk long, text string, loss array<struct<begin:long,end:long>>"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_SEGMENT = re.compile(r"(?:(\[INST\] )|(\[OUT\] )|(<<SYS>>)|\[ROLE ((?:[^\\\]]|\\.)*+)\] )((?:[^\\\[\]<>]++|\\.)*+)(\[/INST\]|</s>|<</SYS>>|\[/ROLE\])", re.DOTALL)
_LOSS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def escaped(text):
    """A column with a backslash before every backslash, square or angle bracket, with which all marks begin."""
    return F.regexp_replace(text, r"([\\\[\]<>])", r"\\$1")


def scatter(parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The row-wise concatenation of binary columns in one new buffer, where rows begin and end there, and where each part begins."""
    offsets = [np.frombuffer(p.buffers()[1], np.int32, len(p) + 1, p.offset * 4).astype(np.int64) for p in parts]
    sizes = [np.diff(o) for o in offsets]
    at = np.r_[0, np.cumsum(np.sum(sizes, axis=0))]
    if at[-1] > np.iinfo(np.int32).max:
        raise ValueError("a slice's segments take more than 2 GB: a single turn is that long")
    out, place, begins = np.empty(int(at[-1]), np.uint8), at[:-1].copy(), []
    for p, o, n in zip(parts, offsets, sizes, strict=True):
        begins.append(place.copy())
        if int(n.sum()):
            data = np.frombuffer(p.buffers()[2], np.uint8)[o[0] : o[-1]]
            out[np.repeat(place - (o[:-1] - o[0]), n) + np.arange(len(data))] = data
        place = place + n
    return out, at, begins


def _segments(roles: pa.Array, names: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, rows' begins and ends, and begin and end of what the loss covers in each row (equal where nothing)."""
    told = roles.dictionary_encode()
    known, code = told.dictionary.to_pylist(), told.indices.to_numpy()
    other = [OTHER[0].format(r) for r in names.to_pylist()] if set(known) - set(MARKS) else None
    opens = [MARKS[r][0] if r in MARKS else None for r in known]
    closes = [MARKS.get(r, OTHER)[1] for r in known]
    heads = pa.array([opens[c] if opens[c] is not None else other[i] for i, c in enumerate(code)], pa.utf8())
    out, at, begins = scatter([heads, texts, pa.array([closes[c] for c in code], pa.utf8())])
    covered = np.array([r == LOSS_ROLE for r in known])[code]
    return out, at, begins[1], np.where(covered, begins[2], begins[1])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of rows whose roles and texts together take about a slice's bytes, or of one row."""
    sizes = sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, "right")))
        yield start, end
        start = end


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, chunk, text, loss`` from rows of ``conv_id, turn, role, text``: a row for each conversation, or for each chunk of it.

    The loss mask is a list of byte ranges of the chunk: an assistant's escaped texts, nothing of other
    roles. Turns of equal number go by role, then by text; a null turn goes first, and rows without a
    conv_id are one conversation. Null role and text count as empty; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chunk = (), 0  # the conversation that the last row belonged to, and its next chunk
        for batch in batches:
            for a, b in _runs(batch):
                conv, roles, names, texts = (c.slice(a, b - a) for c in batch.columns)
                out, at, loss_a, loss_b = _segments(roles, names, texts.cast(pa.utf8()))
                ids = conv.to_pylist()
                first = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
                numbers = [chunk if (ids[i],) == last else 0 for i in first[:1]] + [0] * (len(first) - 1)
                last, chunk = (ids[-1],), numbers[-1] + 1
                rows = np.r_[first, len(ids)]
                ends = at[rows]
                texts = pa.Array.from_buffers(pa.utf8(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
                base = np.repeat(ends[:-1], np.diff(rows))
                covered = np.flatnonzero(loss_b > loss_a)
                spans = pa.StructArray.from_arrays([pa.array((x - base)[covered]) for x in (loss_a, loss_b)], fields=list(_LOSS.value_type))
                loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(covered, rows).astype(np.int32)), spans).cast(_LOSS)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in first], pa.int64()), pa.array(numbers, pa.int64()), texts, loss], names=["conv_id", "chunk", "text", "loss"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("told"))
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "told")
    return own.select("conv_id", "role", escaped(F.col("role")).alias("name"), escaped(F.col("told")).alias("text")).mapInArrow(run, FORMATTED)


def turns_of(text: str) -> Iterator[tuple[str, str, int]]:
    """Role and text of each whole turn that a formatted text begins with, and where it ends."""
    at = 0
    while m := _SEGMENT.match(text, at):
        role = "user" if m[1] else "assistant" if m[2] else "system" if m[3] else _ESCAPED.sub(r"\1", m[4])
        close = MARKS.get(role, OTHER)[1]
        if m[6] != close.lstrip() or not m[0].endswith(close):
            raise ValueError(f"a turn's marks don't match: {m[0][:80]!r}")
        at = m.end()
        yield role, _ESCAPED.sub(r"\1", m[5][: len(m[5]) - (len(close) - len(m[6]))]), at


class _Reading:
    """A conversation as far as it has been read."""

    def __init__(self):
        self.turns = self.chars = self.loss_chars = 0
        self.turn_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()
        self.rest = self.covered = ""

    def chunk(self, text: str, loss: list[dict]) -> None:
        self.chars += len(text)
        self.rest += text
        end = 0
        for role, told, end in turns_of(self.rest):
            self.turns += 1
            self.turn_digest.update(f"{role}\n{told}\n".encode())
        self.rest = self.rest[end:]
        data = text.encode()
        self.covered += "".join(data[x["begin"] : x["end"]].decode() for x in loss)
        cut = len(self.covered) - (len(self.covered) - len(self.covered.rstrip("\\"))) % 2  # half an escape waits
        told, self.covered = _ESCAPED.sub(r"\1", self.covered[:cut]), self.covered[cut:]
        self.loss_chars += len(told)
        self.loss_digest.update(told.encode())

    def row(self, conv: int | None) -> tuple:
        if self.rest or self.covered:
            raise ValueError(f"conversation {conv} ends within a turn: {self.rest[:80]!r}")
        return conv, self.turns, self.turn_digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(chunks: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id, chunk, text, loss``: turns are found by their marks, chunks may be cut anywhere.

    What belongs to no turn is an error. A turn is held whole, a conversation isn't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        conv, reading = None, None
        for batch in batches:
            done = []
            for a, b in slices(batch.column(1).cast(pa.binary())):
                part = batch.slice(a, b - a)
                for c, text, loss in zip(*[x.to_pylist() for x in part.columns], strict=True):
                    if reading is None or c != conv:
                        if reading is not None:
                            done.append(reading.row(conv))
                        conv, reading = c, _Reading()
                    reading.chunk(text, loss)
            if done:
                yield of(done)
        if reading is not None:
            yield of([reading.row(conv)])

    own = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return own.select("conv_id", "text", "loss").mapInArrow(run, READ)
