"""Landed CSV and JSON files as DataFrames."""

from __future__ import annotations

import csv
import functools
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.functions.text import clean, column_name
from assayframe.streaming.shared import written


def csv_table(spark: SparkSession, path: str, row_id: str | None = "primary_id") -> DataFrame:
    """A CSV with a header: every column as text under its stripped name, spaces to underscores, rows numbered from 1 in file order.

    Of several files the first by name comes first. A file that has a column of the number's name already is an error.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = df.columns
    named = [column_name(c) for c in raw]
    if not row_id:
        return df.toDF(*named)
    if row_id.lower() in {c.lower() for c in named}:
        raise ValueError(f"the file has a column {row_id} already")
    own = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(raw)], F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    own = written(own, "csv-rows")
    total, bases = 1, []
    for r in own.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("file", "block").collect():  # one row per file or part of one
        bases.append((r["file"], r["block"], total - r["first"]))
        total += r["n"]
    bases = spark.createDataFrame(bases, "file string, block long, base long")
    out = own.join(F.broadcast(bases), ["file", "block"])
    return out.select((F.col("at") + F.col("base")).alias(row_id), *[F.col(f"c{k}").alias(n) for k, n in enumerate(named)])


def protein_aids(spark: SparkSession, path: str, protein: str = r"([^/]*?)(_aids)?\.json$") -> DataFrame:
    """``Protein, AID`` from one JSON document per protein, which ``protein`` finds in the file's path."""
    raw = spark.read.schema("IdentifierList struct<AID: array<bigint>>").option("multiLine", True).json(path)
    named = F.regexp_extract(F.col("_metadata.file_path"), protein, 1)
    return raw.select(named.alias("Protein"), F.explode(F.col("IdentifierList.AID").cast("array<string>")).alias("AID")).distinct()


def aid_cids(documents: DataFrame) -> DataFrame:
    """``AID, CID`` from ``batch_no, asked (array of AIDs), body (JSON text)``.

    An entry without an AID belongs to the batch's only AID; of an AID in several batches the last counts.
    """
    schema = "InformationList struct<Information: array<struct<AID: bigint, CID: array<bigint>>>>"
    entries = documents.select("batch_no", "asked", F.explode(F.from_json("body", schema)["InformationList"]["Information"]).alias("i"))
    only = F.when(F.size("asked") == 1, F.element_at("asked", 1).cast("string"))
    named = entries.select("batch_no", F.coalesce(F.col("i.AID").cast("string"), only).alias("AID"), F.col("i.CID").alias("CIDs")).filter("AID is not null")
    last = named.groupBy("AID").agg(F.max("batch_no").alias("batch_no"))
    return named.join(last, ["AID", "batch_no"]).select("AID", F.explode(F.col("CIDs").cast("array<string>")).alias("CID")).distinct()


def titles(documents: DataFrame) -> DataFrame:
    """``CID, Title`` from ``batch_no, body (JSON text)``: trimmed, without empty ones, the last of each compound."""
    schema = "PropertyTable struct<Properties: array<struct<CID: bigint, Title: string>>>"
    rows = documents.select("batch_no", F.posexplode(F.from_json("body", schema)["PropertyTable"]["Properties"]).alias("at", "p"))
    rows = rows.select(clean(F.col("p.CID")).alias("CID"), clean(F.col("p.Title")).alias("Title"), F.struct("batch_no", "at").alias("seq")).filter("CID <> '' and Title <> ''")
    return rows.groupBy("CID").agg(F.max_by("Title", "seq").alias("Title"))


#: Listed files are read by blocks of so many bytes, in pieces of so many; to open one counts as so many.
BLOCK, PIECE, OPEN = 128_000_000, 1 << 20, 1 << 16
BOM = b"\xef\xbb\xbf"
_filesystem = functools.lru_cache(16)(pafs.FileSystem.from_uri)


def _pieces(stream, block: int, n: int) -> Iterator[bytes]:
    """The lines that begin in a block, in pieces of whole lines, each without its last line feed; a line may go on in later blocks."""
    end, at, begun, rest = block + n, max(block - 1, 0), block == 0, []
    stream.seek(at)
    while chunk := stream.read(min(PIECE, max(end - at, 1 << 16))):
        skipped = len(BOM) if block == at == 0 and chunk.startswith(BOM) else 0
        if not begun:  # the line that the byte before the block belongs to is another block's
            skipped = chunk.find(b"\n") + 1
            begun = skipped > 0
            if not begun or at + skipped >= end:
                at += len(chunk)
                if at >= end:
                    return
                continue
        last = chunk.find(b"\n", max(end - 1 - at, skipped)) + 1
        cut = last or chunk.rfind(b"\n", skipped) + 1
        if cut:
            yield b"".join([*rest, chunk[skipped : cut - 1]])
            rest, skipped = [], cut
        if last:
            return
        rest.append(chunk[skipped:])
        at += len(chunk)
    if text := b"".join(rest):
        yield text


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, block, value``: the lines of listed blocks of files."""

    def lines(some: list[tuple]) -> pa.RecordBatch:
        files, blocks, texts = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)]
        cut = pc.split_pattern(texts, b"\n")
        of = pc.list_parent_indices(cut)
        return pa.RecordBatch.from_arrays([files.take(of), blocks.take(of), cut.flatten().view(pa.string())], names=["file", "block", "value"])

    some, size = [], 0
    for batch in batches:
        for file, block, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            folder, _, name = file.rpartition("/")
            fs, root = _filesystem(folder)
            with fs.open_input_file(f"{root}/{name}") as stream:
                for text in _pieces(stream, block, n):
                    some.append((file, block, text))
                    size += len(text)
                    if size >= PIECE:
                        yield lines(some)
                        some, size = [], 0
    if some:
        yield lines(some)


_LINES = "file string, block long, line long, odd boolean, even_record long, odd_record long, value string"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of file blocks in their order, numbered in their block, with what the quotes before them in it say.

    ``odd``: an odd number of quotes stands before the line. ``even_record`` counts the records that have begun in the block, this
    line's included, if the block begins outside of quotes, and ``odd_record`` if it begins inside.
    """
    now, line, odd, even, other = None, 0, 0, 0, 0
    for batch in batches:
        block = batch.column(0).cast(pa.string()).to_numpy(zero_copy_only=False) + "\n" + batch.column(1).cast(pa.string()).to_numpy(zero_copy_only=False)
        quotes = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e == s:
                continue
            if block[s] != now:
                now, line, odd, even, other = block[s], 0, 0, 0, 0
            before = (odd + np.cumsum(quotes[s:e]) - quotes[s:e]) % 2
            begun = np.cumsum(before == 0), np.cumsum(before == 1)
            columns = [pa.array(line + np.arange(e - s)), pa.array(before == 1), pa.array(even + begun[0]), pa.array(other + begun[1])]
            part = batch.slice(s, e - s)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, part.column(2)], names=["file", "block", "line", "odd", "even_record", "odd_record", "value"])
            line, odd = line + e - s, int(odd + quotes[s:e].sum()) % 2
            even, other = even + int(begun[0][-1]), other + int(begun[1][-1])


def _lines_of(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    if isinstance(files, str):
        text = spark.read.option("lineSep", "\n").text(files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        return text.mapInArrow(_lines, _LINES)
    tasks = max(spark.sparkContext.defaultParallelism, (files.agg(F.sum(F.col("bytes") + OPEN)).first()[0] or 0) // BLOCK)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(BLOCK).cast("long")))
    blocks = files.filter("bytes > 0").select("file", starts.alias("block"), "bytes").select("file", "block", F.least(F.lit(BLOCK), F.col("bytes") - F.col("block")).alias("n"))
    return blocks.repartition(tasks, "file", "block").mapInArrow(lambda batches: _lines(_listed(batches)), _LINES)


def records(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    """``file, record_no, value``: the records of CSV files of any size, which may hold line breaks in quotes.

    ``files`` is a path, whose files Spark lists on the driver, or a list of them as a table (``file, bytes``, as of ``writers.write_files``), which the driver never
    holds: use it where there are very many. Listed files are opened by tasks through pyarrow's file systems, and aren't compressed.

    Files are cut into blocks and lines. A first look counts quotes and records by block; their sums along a file tell
    for each block whether it begins inside quotes, and with which record. Lines that are a record by themselves stay where they are; only those of
    records of several lines meet, a record at a time. Quotes are those of RFC 4180: a field with one in it is quoted.
    """
    lines = written(_lines_of(spark, files), "csv-lines")  # files, of which there may be very many, are opened once
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sizes = lines.select("file", "block", "even_record", "odd_record", quotes.alias("q")).groupBy("file", "block").agg(F.max("even_record").alias("even"), F.max("odd_record").alias("odd_begun"), F.sum("q").alias("q"))
    by = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("q").over(by), F.lit(0)) % 2 == 1
    begun = F.sum(F.when(F.col("inside"), F.col("odd_begun")).otherwise(F.col("even"))).over(by)
    starts = sizes.withColumn("inside", inside).select("file", "block", "inside", F.coalesce(begun, F.lit(0)).alias("first"))
    starts = written(starts.filter("block > 0"), "csv-blocks")  # a file's first block begins outside of quotes, with its first record
    here = lines.join(F.broadcast(starts), ["file", "block"], "left").withColumns({"inside": F.coalesce("inside", F.lit(False)), "first": F.coalesce("first", F.lit(0))})
    number = F.col("first") + F.when(F.col("inside"), F.col("odd_record")).otherwise(F.col("even_record")) - 1
    goes_on = F.col("odd") != F.col("inside")
    ends = (F.when(goes_on, 1).otherwise(0) + quotes) % 2 == 0
    own = here.select("file", number.alias("record_no"), "block", "line", "value", (~goes_on & ends).alias("whole"))
    several = own.filter("not whole").groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("l"))
    joined = several.select("file", "record_no", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("value"))
    return own.filter("whole").select("file", "record_no", "value").unionByName(joined)


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [next(csv.reader(io.StringIO(v.removesuffix("\r"), newline="")), []) for v in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.list_(pa.string()))], names=["file", "record_no", "fields"])


def assay_cells(spark: SparkSession, files: str | DataFrame, aid: str = r"(\d+)\D*$") -> DataFrame:
    """``AID, row_no, pos, column, value`` from one ragged CSV per assay, whose number ``aid`` finds in the file's path.

    ``files`` is a path or a list of files (``records``). A file of any size is read by many tasks; only the splitting of a record into its fields is Python. Fields beyond the header are dropped.
    """
    own = written(records(spark, files).mapInArrow(_fields, "file string, record_no long, fields array<string>"), "csv-fields")  # for headers and cells
    header = own.filter("record_no = 0").select("file", F.col("fields").alias("header"))
    cells = own.filter("record_no > 0").join(header.hint("merge"), "file")  # a header for each file, never broadcast: stored headers are alike and far smaller than in memory
    told = cells.select(F.regexp_extract("file", aid, 1).alias("AID"), (F.col("record_no") - 1).alias("row_no"), F.posexplode(F.arrays_zip("header", "fields")).alias("pos", "c"), F.size("fields").alias("n"), F.size("header").alias("h"))
    return told.filter("pos < n and pos < h").select("AID", "row_no", "pos", F.col("c.header").alias("column"), F.col("c.fields").alias("value"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``name, category, entry`` from collection taxonomy documents."""
    raw = spark.read.schema("name string, category string, entries array<string>").option("multiLine", True).json(path)
    return raw.select("name", "category", F.explode("entries").alias("entry"))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """The required columns only; missing ones are an error before any row is read."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df.select(*columns)
