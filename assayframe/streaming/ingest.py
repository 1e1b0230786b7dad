"""Incremental ingest of activity rows, in batches or from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from assayframe.functions.digests import key_digest, once, whole_key
from assayframe.functions.names import fresh
from assayframe.operators.links import expected_only
from assayframe.streaming.ledger import Ledger

#: What makes two activity rows the same (fixed key).
KEY = ("CID", "AID", "Protein", "Activity_Type", "Relation", "Activity_Value_Raw", "Unit", "Outcome", "Source_Column", "Result_Tag")


def new_rows(rows: DataFrame, known: DataFrame | None, jobs: DataFrame | None = None) -> DataFrame:
    """The rows that are expected and not known yet, each once; a row with a null in its key is never known.

    Keys meet as digests of 16 bytes. Of rows with one key the least stays.
    """
    if jobs is not None:
        rows = expected_only(rows, jobs)
    digest = fresh("key_digest", rows)
    own = once(rows, list(KEY), digest)
    if known is not None:
        whole = known.filter(whole_key(list(KEY))).select(*KEY)
        own = own.join(whole.select(key_digest(whole, list(KEY)).alias(digest)), digest, "left_anti")
    return own.select(*rows.columns)


def activity_ledger(spark: SparkSession, root: str) -> Ledger:
    """A stored activity table below a shared folder."""
    return Ledger(spark, root, KEY)


def ingest(rows: DataFrame, ledger: Ledger, batch: str, jobs: DataFrame | None = None) -> bool:
    """Adds a batch's new rows; a batch of the same name again adds nothing, nor do known rows in another batch."""
    return not ledger.has(batch) and ledger.add(expected_only(rows, jobs) if jobs is not None else rows, batch)


def stream(source: DataFrame, ledger: Ledger, checkpoint: str, jobs: DataFrame | None = None, extract=None, name: str = "stream", after=None) -> StreamingQuery:
    """The streaming variant over a file source: every micro-batch is ingested exactly once, also after a restart.

    ``extract`` makes activity rows of a micro-batch, for instance ``assay.extract``
    over cells. ``name`` tells the batches of this checkpoint from those of others; ``after`` is called with each batch's number once it
    is published. All files that are there are taken, and then the query ends.
    """

    def take(batch: DataFrame, number: int) -> None:
        ingest(extract(batch) if extract else batch, ledger, f"{name}-{number}", jobs)
        if after:
            after(number)

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
