"""CSV exports and derived tables. No writer replaces what exists."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.operators.refine import contains, project
from assayframe.streaming.shared import written

#: SQL types of declared columns (fixed names).
DECLARED = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double"}


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, order_by: list | None = None) -> None:
    """All or the selected columns, with a header."""
    out = project(df, columns)
    (out.orderBy(*order_by) if order_by else out).write.mode("errorifexists").option("header", True).csv(path)


def export_subgroup(df: DataFrame, path: str, column: str, value: str, columns: list[str] | None = None) -> None:
    """The rows whose column contains the text; for an unknown column a file without rows."""
    export_csv(contains(df, column, value), path, columns)


def write_files(lines: DataFrame, folder: str, name: Column, head: Column, line: Column, order: Column) -> DataFrame:
    """A text file for each ``name``, which has to be one for a file system: the ``head`` that its rows share, then their lines in order.

    Returns the written list of finished files: ``file, bytes``. Tasks write below ``folder``, a shared place that pyarrow's file systems reach, and go through a file's
    lines as a stream. So the driver, which Spark's own writer would tell of every file, sees none, however many there are. What a lost or repeated task left behind is in no list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        now, out, size, done = None, None, 0, []

        def finish() -> None:
            if out is not None:
                out.close()
                done.append((f"{folder}/{part}/{now}", size))

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["file", "bytes"])
            done.clear()
            return batch

        for batch in batches:
            names, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e == s:
                    continue
                text = b"\n".join(rows[s:e]) + b"\n"
                if names[s] != now:
                    finish()
                    if now is None:
                        fs.create_dir(f"{root}/{part}", recursive=True)
                    now, size, text = names[s], 0, batch.column(1)[s].as_py() + b"\n" + text
                    out = fs.open_output_stream(f"{root}/{part}/{now}", compression=None)
                out.write(text)
                size += len(text)
            yield told()
        finish()
        yield told()

    own = lines.select(name.alias("name"), head.cast("binary").alias("head"), line.cast("binary").alias("line"), order.alias("order"))
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as small files cost by their number, not by the bytes that Spark would join tasks by
    own = own.repartition(tasks, "name").sortWithinPartitions("name", "order").select("name", "head", "line")
    return written(own.mapInArrow(run, "file string, bytes long"), "files")


def derive_table(df: DataFrame, name: str, types: dict[str, str] | None = None) -> DataFrame:
    """A new catalog table with declared types, NaN as null; an empty result still has its columns."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        raise ValueError(f"the table {name} exists")
    kinds = dict(df.dtypes)
    value = lambda c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.col(f"`{c}`")
    cast = lambda c: value(c).try_cast(DECLARED[types[c]]) if types and c in types else value(c)
    df.select(*[cast(c).alias(c) for c in df.columns]).write.mode("errorifexists").saveAsTable(name)
    return spark.table(name)
