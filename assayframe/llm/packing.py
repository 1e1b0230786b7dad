"""Packing token ids into fixed-length sequences: concatenate and cut.

Pass 1 tokenises every document and writes a token table in which each row
holds its partition and its token offset within that partition. The partitions'
token totals, one number each, are summed to give every partition its base; base
plus local offset is a document's place in the one long stream of all ids.
Pass 2 cuts that stream every ``length`` ids. A document that crosses a boundary
gives a piece on both sides, so that all sequences but the last are full.

The order of the stream is the order of partitions and rows in the token table,
which is written once; a lost executor doesn't change it.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import written

TOKENS_SCHEMA = "part int, local_start long, doc_id long, n_tokens long, ids binary"
#: Distinct pieces whose ids a worker remembers, and bytes handled at once: bounds on memory only.
CACHED_PIECES, SLICE_BYTES = 400_000, 2_000_000

#: The tokenizer's own split into pieces, for lower-cased text of characters up to U+017F.
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿā-ſ", "0-9²³¹¼½¾", " \t\n\x0b\x0c\r\x85\xa0"
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: Texts with other characters, or with what may be a special token, go to the tokenizer whole.
_OTHER = re.compile("[^\x00-ſ]|<\\|")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of pieces, each encoded when first asked for and remembered while there is room."""

    def __init__(self, model):
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])
        if len(self) < CACHED_PIECES and len(piece) < 50:
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and never joins across pieces
    (words, digits, runs of signs), so a text's ids are those of its pieces, one
    after another. Pieces repeat far more often than texts, and the tokenizer's
    model is asked for each only once as long as there is room to remember it.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.pieces = _Pieces(self.tokenizer.model)

    def encode(self, texts: list[str]) -> list[bytes]:
        of = self.pieces.__getitem__
        return [self._whole(t) if _OTHER.search(t) else b"".join(map(of, _PIECE.findall(t.lower()))) for t in texts]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row; so that a batch is never unpacked whole."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, end
        start = end


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written token table: ``part, local_start, doc_id, n_tokens, ids``.

    Each document's ids end with ``end_id``, so that a null or empty text has one
    id. Null ids stay null, repeated rows are documents of their own, other
    columns are not read, an empty table gives an empty table.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = PieceEncoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                ids = [x + end for x in encoder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part, np.int32)), pa.array(starts), batch.column(0).slice(a, b - a), pa.array(n), pa.array(ids, pa.binary())],
                    names=["part", "local_start", "doc_id", "n_tokens", "ids"],
                )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(own.mapInArrow(run, TOKENS_SCHEMA), "tokens")


def pack(tokens: DataFrame, length: int = 2048) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``start`` counts the document's ids before the piece, ``offset`` the ids
    before it in its sequence, ``ids`` are the piece's own. The driver sees one
    number per partition of the token table and nothing else.
    """
    spark = tokens.sparkSession
    totals = sorted(tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    sums = itertools.accumulate((r.n for r in totals), initial=0)
    bases = spark.createDataFrame([(r.part, base) for r, base in zip(totals, sums, strict=False)], "part int, base long")
    at = tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("local_start"))

    def piece(window):
        first = F.greatest(window * length, F.col("at"))
        last = F.least((window + 1) * length, F.col("at") + F.col("n_tokens"))
        start, n = first - F.col("at"), last - first
        ids = F.col("ids").substr((start * 4 + 1).cast("int"), (n * 4).cast("int"))
        return F.struct(start.alias("start"), n.alias("length"), window.alias("sequence_id"), (first - window * length).alias("offset"), ids.alias("ids"))

    whole = lambda c: F.floor(c / F.lit(length)).cast("long")
    windows = F.sequence(whole(F.col("at")), whole(F.col("at") + F.col("n_tokens") - 1))
    return at.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.inline(F.transform(windows, piece))).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """One row per sequence: ``sequence_id, n_tokens, ids``, ids padded to ``length``.

    A last sequence whose size is a power of two stays as it is. A sequence has
    ``length`` pieces at most, so a group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    n = F.sum("length")
    joined = pieces.groupBy("sequence_id").agg(n.alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
    exact = F.bit_count("n_tokens") == 1
    pad = pad_id.to_bytes(4, "little").hex()
    filled = F.concat("ids", F.unhex(F.repeat(F.lit(pad), (F.lit(length) - F.col("n_tokens")).cast("int"))))
    return joined.select("sequence_id", "n_tokens", F.when(exact, F.col("ids")).otherwise(filled).alias("ids"))
