"""Stored tables that are updated by key without rewriting what an update doesn't touch.

Rows lie in buckets by the hash of their key, each bucket in files of its own. A manifest names the files of every bucket; an update reads the buckets that its
keys fall into, merges, writes these buckets anew, and publishes the next manifest by one rename. Files are never changed: readers of
an older manifest, and everybody if an update fails, see the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayframe.functions.names import fresh
from assayframe.sources import files

BUCKETS = 64
#: The bucket of rows without a key, which no update touches; it has as many files as its rows had tasks.
NO_KEY = -1


class Conflict(RuntimeError):
    """Another update was published meanwhile."""


@dataclass
class Snapshot:
    """The table at a shared ``root`` with one key column. More ``buckets`` mean less to rewrite for a small update."""

    spark: SparkSession
    root: str
    key: str
    buckets: int = BUCKETS

    def _bucket(self, key: str) -> Column:
        c = F.col(f"`{key}`")
        return F.when(c.isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(c.cast("string")), F.lit(self.buckets))).cast("int")

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.root}/manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """``schema``, and ``files``: the folders of each bucket, by its number as text."""
        version = version if version is not None else max(self.versions(), default=None)
        if version is None:
            raise LookupError(f"there is no table at {self.root}")
        return files.read_json(self.spark, self._place(version)) | {"version": version}

    def _place(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets, as of a version (by default the last)."""
        told = self.manifest(version)
        schema = StructType.fromJson(json.loads(told["schema"]))
        paths = [p for b, some in told["files"].items() if buckets is None or int(b) in buckets for p in some]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)  # files from before a column was added have null there

    def _write(self, df: DataFrame, version: int, kept: dict[str, list[str]]) -> int:
        """Writes rows by bucket and publishes a manifest that has them beside the ``kept`` files."""
        name, place = fresh("bucket", df), f"{self.root}/data/{uuid.uuid4().hex}"
        own = df.withColumn(name, self._bucket(self.key))
        salt = F.when(F.col(name) == NO_KEY, F.monotonically_increasing_id()).otherwise(0)  # rows without a key don't meet in one task
        own.repartition(F.col(name), salt).write.partitionBy(name).parquet(place)
        told = {b: list(p) for b, p in kept.items()}
        for folder in files.names(self.spark, place):
            if folder.startswith(f"{name}="):
                told.setdefault(folder.split("=")[1], []).append(f"{place}/{folder}")
        if not files.write_json(self.spark, {"schema": df.schema.json(), "files": told}, self._place(version)):
            raise Conflict(f"version {version} of {self.root} was published by another update")
        return version

    def create(self, df: DataFrame) -> int:
        if self.versions():
            raise ValueError(f"there is a table at {self.root} already")
        return self._write(df, 1, {})

    def update(self, updates: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], update_key: str | None = None) -> int:
        """Publishes the table with ``updates`` merged in, and gives its version.

        ``merge(rows, updates)`` is one of ``operators.merge``, or like them: it has to leave a row's key as it is. It gets
        the rows of the buckets that the updates' keys fall into and nothing else. Rows that it makes without a key are added to those there are.
        """
        now = self.manifest()
        touched = [r[0] for r in updates.select(self._bucket(update_key or self.key)).distinct().collect()]  # a number for each bucket at most
        again = [b for b in touched if b != NO_KEY]
        merged = merge(self.read(now["version"], again), updates)
        kept = {b: p for b, p in now["files"].items() if int(b) not in again}
        return self._write(merged, now["version"] + 1, kept)
