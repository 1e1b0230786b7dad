"""Structured refinement of a table: projection, grouping, one condition or one order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.names import fresh

PREVIEW_ROWS = 10


def project_active(df: DataFrame, columns: list[str]) -> DataFrame:
    """The requested columns that the table still has, in the order requested."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The requested columns; None or none means all, and unknown ones are an error that names them all."""
    if not columns:
        return df
    if unknown := [c for c in columns if c not in df.columns]:
        raise ValueError("unknown columns: " + ", ".join(unknown))
    return df.select(*[F.col(f"`{c}`") for c in columns])


@dataclass(frozen=True)
class Condition:
    """``column op value``; mode ``text`` compares as strings, ``numeric`` as doubles (what isn't a number never matches).

    By default strings are compared with text columns and numbers with numeric ones.
    """

    column: str
    op: str
    value: object = None
    mode: str | None = None

    def on(self, df: DataFrame) -> Column:
        if self.column not in df.columns:
            raise ValueError(f"unknown column: {self.column}")
        c = F.col(f"`{self.column}`")
        if self.op == "is null":
            return c.isNull()
        if self.op == "is not null":
            return c.isNotNull()
        if self.op == "like":
            return c.cast("string").ilike(str(self.value))
        mode = self.mode or ("text" if dict(df.dtypes)[self.column] == "string" else "numeric")
        left, right = (c.cast("string"), F.lit(str(self.value))) if mode == "text" else (c.try_cast("double"), F.lit(float(self.value)))
        ops = {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
        if self.op not in ops:
            raise ValueError(f"unknown comparison: {self.op}")
        return ops[self.op]


def first_per_group(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key (null is a key): the first by ``order``.

    A least struct, so that a group of any size is combined before the shuffle.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    one = fresh("first", df)
    first = F.min(F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]])).alias(one)
    return df.groupBy(F.col(f"`{key}`")).agg(first).select(*[F.col(f"`{c}`") if c == key else F.col(f"`{one}`.`{c}`") for c in df.columns])


def refine(df: DataFrame, columns: list[str], group_by: str | None = None, where: Condition | None = None, order_by: str | None = None, ascending: bool = True) -> DataFrame:
    """The chosen columns under at most one of a grouping, a condition and an order."""
    if sum(x is not None for x in (group_by, where, order_by)) > 1:
        raise ValueError("give one of group_by, where and order_by")
    chosen = [c for c in columns if c in df.columns]
    if not chosen:
        raise ValueError("select at least one column")
    if where is not None:
        return project(df.filter(where.on(df)), chosen)
    out = project(df, chosen)
    if group_by is not None:
        if group_by not in chosen:
            raise ValueError("group_by must be one of the selected columns")
        return first_per_group(out, group_by, [c for c in chosen if c != group_by])
    if order_by is not None:
        if order_by not in chosen:
            raise ValueError("order_by must be one of the selected columns")
        c = F.col(f"`{order_by}`")
        return out.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last())
    return out


def preview(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    if not 1 <= limit <= PREVIEW_ROWS:
        raise ValueError(f"a preview has 1 to {PREVIEW_ROWS} rows")
    return df.limit(limit)


def contains(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column has the text in any case; % and _ in it stay wildcards. An unknown column gives no rows."""
    if column not in df.columns:
        return df.limit(0)
    return df.filter(F.col(f"`{column}`").cast("string").ilike(f"%{value}%"))


def row_count(df: DataFrame | None) -> int:
    """A missing table has no rows."""
    return 0 if df is None else df.count()


def group_count(df: DataFrame, column: str) -> DataFrame:
    """One row ``groups``: the distinct values of a column, null being one; 0 for an unknown column."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([(0,)], "groups long")
    return df.select(F.col(f"`{column}`").alias("v")).distinct().agg(F.count("*").alias("groups"))


def first_seen(df: DataFrame, key: Column, sequence: str) -> DataFrame:
    """``key, first`` of the distinct non-null keys, in the order in which they first occur."""
    return df.select(key.alias("key"), F.col(sequence).alias("s")).filter("key is not null").groupBy("key").agg(F.min("s").alias("first")).orderBy("first")


def keep_last(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Per key the row with the greatest sequence."""
    rest = [c for c in df.columns if c not in (key, sequence)]
    one = fresh("last", df)
    last = F.max(F.struct(F.col(f"`{sequence}`"), *[F.col(f"`{c}`") for c in rest])).alias(one)
    return df.groupBy(F.col(f"`{key}`")).agg(last).select(*[F.col(f"`{c}`") if c == key else F.col(f"`{one}`.`{c}`") for c in df.columns])


def with_row_ids(df: DataFrame, name: str = "primary_id") -> DataFrame:
    """Rows numbered from 1 in file order, each partition on its own after the partitions' sizes are known.

    The partitions are written once, below ``spark.checkpoint.dir``, so that a task that is run again numbers no row anew.
    A table that has a column of that name already is an error.
    """
    from assayframe.streaming.shared import written

    if fresh(name, df) != name:
        raise ValueError(f"the table has a column {name} already")
    part, at, base = (fresh(n, df) for n in ("part", "at", "base"))
    own = written(df.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "row-ids")
    return number_partitions(own, part, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)), name, base, 1, df.columns)


def number_partitions(own: DataFrame, part: str, place, name: str, base: str, start: int, columns: list[str]) -> DataFrame:
    """Rows with the number of their partition and their place in it, numbered over all; the driver sees one count per partition."""
    total, bases = start, []
    for p, n in sorted((r[part], r["count"]) for r in own.groupBy(part).count().collect()):
        bases.append((p, total))
        total += n
    bases = own.sparkSession.createDataFrame(bases, f"`{part}` int, `{base}` long")
    return own.join(F.broadcast(bases), part).select((place + F.col(f"`{base}`")).alias(name), *[F.col(f"`{c}`") for c in columns])
