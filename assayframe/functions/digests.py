"""Digests of keys, and one row of each key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_key(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"`{k}`").isNotNull()
    return out


def key_digest(df: DataFrame, keys: list[str]) -> Column:
    """16 bytes that tell keys apart. A key with a null equals no other, so its row gets a digest of its own, another one each time."""
    text = lambda columns: F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})
    own = F.concat(F.lit(f"null {uuid.uuid4().hex} "), F.monotonically_increasing_id(), F.lit(" "), text(df.columns))
    return F.unhex(F.md5(F.when(whole_key(keys), text(keys)).otherwise(own).cast("binary")))


def once(df: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """One row of each key, the least, with its digest; combined before the shuffle. Rows with a null in their key all stay.

    Where the key is the whole row, its rows are equal, and nothing is sorted to find the least.
    """
    if set(keys) == set(df.columns):
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = df.select(*[F.col(f"`{c}`") for c in df.columns], key_digest(df, keys).alias(digest))
        return own.repartition(parts, digest).distinct()
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    least = df.select(key_digest(df, keys).alias(digest), rest.alias("row")).groupBy(digest).agg(F.min("row").alias("row"))
    return least.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], digest)
