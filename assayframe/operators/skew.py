"""Joins in which one key may have a third of all rows, and filters by sets of keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.names import fresh

#: A key with at least this share of all rows counts as hot; so there are that many of them at most.
HOT_SHARE = 512
#: Bits of a filter: 4,096 pieces of 4 kB, 16 MB, however many keys it holds.
FILTER_BITS = 1 << 27


def meet(rows: DataFrame, decided: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``total`` rows with one decision per key, which knows how many ``size`` rows its key has.

    Hot keys are broadcast, so that their rows stay where they are; all others are
    joined by a shuffle in which no key has more than 1 / HOT_SHARE of the rows.
    """
    hot = F.col(size) * HOT_SHARE >= F.lit(max(total, 2 * HOT_SHARE))
    few, rest = F.broadcast(decided.filter(hot)), decided.filter(~hot)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(decided.filter(hot).select(key)), key, "left_anti").join(rest, key))


def may_hold(rows: DataFrame, key: Column, keys: DataFrame, of: Column) -> DataFrame:
    """The rows whose key may be among ``keys``, and few others: where a shuffle of all rows would be dear.

    The keys' hashes are bits of a map that Spark's bitmap aggregate builds and that is broadcast; its size has a bound that
    doesn't depend on the data. With very many keys it lets more rows pass, never fewer.
    """
    piece, bits_of = fresh("piece", rows), fresh("bits", rows)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bits = keys.select(place(of).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias(piece)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(bits_of))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.col(bits_of).substr((F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.bit_get(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(key)) == F.col(piece)).filter(hit).select(*columns)
