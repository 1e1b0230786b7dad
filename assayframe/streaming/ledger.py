"""A stored table that takes each batch once and each key once.

Rows are kept with a digest of their key, in buckets by that digest, one folder per batch. A batch is staged and then
published by one rename of its folder, rows and digests together; its name in the ledger is the folder's. So a batch that is replayed after a crash is
recognised whole, also its rows with a null in the key, which are new in every other batch; and one that crashed before the rename
left nothing that is read.

The stored side is read by its buckets, the digest column alone, without a shuffle. A small batch isn't sorted against it either:
its digests, counted first, are looked up while the stored ones are scanned.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.digests import once
from assayframe.sources import files

BUCKETS = 64
#: Digests of 16 bytes that are broadcast at most.
SMALL_BATCH = 1_000_000
DIGEST = "row_digest"


@dataclass
class Ledger:
    """The table at a shared ``root``, keyed by ``keys``. Of equal keys the row of the first batch stays, of one batch's the least row."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def batches(self) -> list[str]:
        return [n.removeprefix("batch=") for n in files.names(self.spark, f"{self.root}/rows") if n.startswith("batch=")]

    def has(self, batch: str) -> bool:
        return files.exists(self.spark, f"{self.root}/rows/batch={batch}")

    def stored(self) -> DataFrame | None:
        """All rows with their digests, known to Spark as bucketed by these; None before the first batch."""
        batches = self.batches()
        if not batches:
            return None
        schema = self.spark.read.parquet(f"{self.root}/rows/batch={batches[0]}").schema
        name, place = f"ledger_{uuid.uuid4().hex}", f"{self.root}/rows"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(f"CREATE TABLE {name} ({columns}, `batch` string) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return self.spark.table(name)

    def rows(self) -> DataFrame:
        own = self.stored()
        if own is None:
            raise LookupError(f"no batch was ever added to {self.root}")
        return own.drop(DIGEST, "batch")

    def new(self, rows: DataFrame) -> DataFrame:
        """Of the rows those whose key isn't stored, each once, with their digests."""
        if DIGEST in rows.columns or "batch" in rows.columns:
            raise ValueError(f"the columns {DIGEST} and batch belong to the ledger")
        fresh_rows, stored = once(rows, list(self.keys), DIGEST), self.stored()
        if stored is None:
            return fresh_rows
        return fresh_rows.join(stored.select(DIGEST), DIGEST, "left_anti").select(*rows.columns, DIGEST)

    def add(self, rows: DataFrame, batch: str) -> bool:
        """Adds a batch; False, without reading a row, if it was added before."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch's name is of letters, digits, and ._-")
        if self.has(batch):
            return False
        staged, table = f"{self.root}/staged/{uuid.uuid4().hex}", f"staged_{uuid.uuid4().hex}"
        own = self._settled(rows)
        own.repartition(self.buckets, DIGEST).write.option("path", staged).bucketBy(self.buckets, DIGEST).sortBy(DIGEST).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        return files.publish(self.spark, staged, f"{self.root}/rows/batch={batch}")

    def _settled(self, rows: DataFrame) -> DataFrame:
        stored = self.stored()
        if stored is None:
            return self.new(rows)
        own = once(rows, list(self.keys), DIGEST)
        place = f"{self.root}/staged/{uuid.uuid4().hex}"
        own.write.parquet(place)  # looked at twice, made once
        own = self.spark.read.schema(own.schema).parquet(place)
        if own.count() > SMALL_BATCH:
            return own.join(stored.select(DIGEST), DIGEST, "left_anti").select(*own.columns)
        known = stored.select(DIGEST).join(F.broadcast(own.select(DIGEST)), DIGEST, "left_semi")  # as many as the batch has, at most
        return own.join(F.broadcast(known), DIGEST, "left_anti").select(*own.columns)

