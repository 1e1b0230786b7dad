"""Helpers shared by the operators: the shared folder, written tables, row choice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all run on this machine."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        known = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage: a lost executor later costs a read, not the whole job.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. ``lower`` does so for pure ASCII, and faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of the keys (null is a value), with its columns as they are."""
    order = fresh(df, "one_of_each")
    w = Window.partitionBy(*keys).orderBy(F.lit(1))
    return df.withColumn(order, F.row_number().over(w)).filter(F.col(order) == 1).drop(order)


#: A key with at least this share of all rows counts as hot; so there are that many of them at most.
HOT_SHARE = 512


def meet(rows: DataFrame, decided: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with one decision per key, of whose ``size`` rows a hot key may have a third of all.

    Hot keys, HOT_SHARE at most by their definition, are broadcast, so that their rows stay where
    they are; all others are joined by a shuffle in which no key has more than 1/HOT_SHARE of the rows. ``total``
    is the sum of sizes, where it is known.
    """
    total = total if total is not None else decided.agg(F.sum(size)).first()[0] or 0
    hot = decided.filter(F.col(size) * HOT_SHARE >= F.lit(max(total, 2 * HOT_SHARE)))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(decided, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
