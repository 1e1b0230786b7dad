"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. New rows are reduced to
(digest, largest id, count) with map-side aggregation, a sort-merge anti-join
against the index leaves the digests it doesn't hold, and these are appended.
The index side of every join is read bucket by bucket, without a shuffle.

Only DataFrame operations are used. A digest that holds a large share of all
rows is no hot spot: copies are counted before the shuffle, and decisions on the
few largest groups reach their rows by a bounded broadcast (``common.meet``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm.common import ascii_lower, fresh, meet, one_of_each, written

INDEX_SCHEMA = "digest string, keep_id long, batch long"


def normalised(text):
    """What is compared: the text with A-Z lower-cased; null is the empty text."""
    return ascii_lower(F.coalesce(text, F.lit("")))


class DigestIndex:
    """A digest table in the session's catalog: ``digest, keep_id, batch``.

    ``buckets`` is fixed when the table is made (the session's number of shuffle
    partitions if none is given); pick it so that a bucket of the final index
    fits a task.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            self._append(spark.createDataFrame([], INDEX_SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, batch: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch and returns a decision for each of its rows.

        Columns: ``doc_id, keep_id, group_size, kept, text_sha256``; group_size
        counts the batch's rows. Of equal new texts the row with the largest id
        stays. A text that the index already held keeps the row of its first
        batch, so every row of it is dropped here. A batch number that was added
        before gives the same decisions again and appends nothing.

        Null text counts as empty. Rows without an id lose to any id; where no
        row of a text has an id, keep_id is null and one such row stays. Of
        rows that repeat both id and text, one stays. An empty batch gives no
        rows. Other columns are not read.
        """
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
        rows = written(own.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies")), "digests")
        groups = rows.groupBy("text_sha256").agg(F.max("doc_id").alias("new_id"), F.sum("copies").alias("group_size"))
        groups = written(groups, "digest_groups")
        new = groups.select(F.col("text_sha256").alias("digest"), F.col("new_id").alias("keep_id"), F.lit(batch).cast("long").alias("batch"))
        self._append(new.join(self.table().hint("merge"), "digest", "left_anti"))

        known = self.table().withColumnRenamed("digest", "text_sha256").hint("merge")
        decided = written(groups.drop("new_id").join(known, "text_sha256"), "decided")
        out = meet(rows, decided, "text_sha256", "group_size")
        mine = (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return out.select(
            "doc_id",
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
            mine.alias("mine"),
            "text_sha256",
        ).select("doc_id", "keep_id", "group_size", (F.col("mine") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: int = 0) -> DataFrame:
    """``docs`` without the rows that repeat a text; all columns stay as they are."""
    index = index or DigestIndex(docs.sparkSession)
    kept = index.add(docs, batch).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_digest"))
    own_id, own_digest = fresh(docs, "own_id"), fresh(docs, "own_digest")
    own = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_digest: F.sha2(normalised(F.col("text")), 256)})
    same = own[own_digest].eqNullSafe(kept["kept_digest"]) & own[own_id].eqNullSafe(kept["kept_id"])
    return one_of_each(own.join(kept, same, "left_semi"), own_digest, own_id).select(*[F.col(f"`{c}`") for c in docs.columns])
