"""Filters, summaries and orders of a long activity table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.text import integer_prefix, not_blank

#: Columns of an activity export, in order (fixed format).
EXPORT_COLUMNS = ("CID", "AID", "Protein", "Activity_Type", "Relation", "Activity_Value", "Unit", "Outcome", "Source_Column", "Activity_Status", "Result_Tag")
#: Relations that qualify a value (fixed values).
QUALIFIED = (">", "<", ">=", "<=")
#: Longer lists of values are joined instead of put into the plan.
MAX_LISTED = 1000


def one_of(column: str, values: Iterable[str] | None) -> Column | None:
    """IN filter; blanks in the list don't count, and an empty list filters nothing."""
    some = [v for v in values or () if v is not None and str(v).strip() != ""]
    return F.col(column).isin(some) if some else None


def in_range(column: str, low: float | None = None, high: float | None = None) -> Column | None:
    """Inclusive range, open where an end is None; null never matches."""
    parts = [p for p in (F.col(column) >= low if low is not None else None, F.col(column) <= high if high is not None else None) if p is not None]
    return reduce(Column.__and__, parts) if parts else None


def filtered(activity: DataFrame, types=None, outcomes=None, units=None, aids=None, value_range: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """All given filters at once; predicates stay on raw columns, so that they reach the scan."""
    lists = {"Activity_Type": types, "Outcome": outcomes, "Unit": units, "AID": aids}
    for column, values in lists.items():
        values = list(values or ())
        if len(values) > MAX_LISTED:
            wanted = activity.sparkSession.createDataFrame([(str(v),) for v in values if v is not None and str(v).strip()], f"{column} string").distinct()
            activity = activity.join(wanted, column, "left_semi")
        elif (p := one_of(column, values)) is not None:
            activity = activity.filter(p)
    p = in_range("Activity_Value", *value_range)
    return activity if p is None else activity.filter(p)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-blank values of a column, sorted."""
    return df.filter(not_blank(column)).select(column).distinct().orderBy(column)


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: how many values other than null a column has; it reads that column alone."""
    return df.select(F.col(f"`{column}`").alias("v")).distinct().agg(F.count("v").alias(name))


def one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row each, side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in out.columns])


def summary(activity: DataFrame) -> DataFrame:
    """One row: rows, distinct CIDs and AIDs, least and greatest value, and the distinct values of the short columns.

    The AIDs, of which there may be any number, are listed by ``distinct_values``. Rows are grouped by compound, and
    assays counted by a scan of their column, so that no row is multiplied for a distinct count.
    """
    short = {"activity_types": "Activity_Type", "outcomes": "Outcome", "units": "Unit", "relations": "Relation"}
    some = lambda c: F.collect_set(F.when(not_blank(c), F.col(c)))
    by_cid = activity.groupBy("CID").agg(F.count("*").alias("n"), F.min("Activity_Value").alias("low"), F.max("Activity_Value").alias("high"), *[some(c).alias(n) for n, c in short.items()])
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(n)))).alias(n) for n in short]
    whole = by_cid.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("CID").alias("cid_count"), F.min("low").alias("min_value"), F.max("high").alias("max_value"), *lists)
    return one_row(whole, distinct_count(activity, "AID", "aid_count")).select("row_count", "cid_count", "aid_count", "min_value", "max_value", *short)


def value_stats(activity: DataFrame) -> DataFrame:
    """One row: values, least, greatest, and how many rows have a qualified relation."""
    return activity.agg(
        F.count("Activity_Value").alias("value_count"),
        F.min("Activity_Value").alias("min_value"),
        F.max("Activity_Value").alias("max_value"),
        F.coalesce(F.sum(F.col("Relation").isin(*QUALIFIED).cast("long")), F.lit(0)).alias("qualified_count"),
    )


def cids(activity: DataFrame) -> DataFrame:
    return distinct_values(activity, "CID")


def ordered(activity: DataFrame, limit: int | None = None) -> DataFrame:
    """By assay number, compound and tag; with a limit the first rows of that order."""
    out = activity.orderBy(integer_prefix("AID"), "CID", "Result_Tag")
    return out if limit is None else out.limit(limit)


def export(activity: DataFrame, path: str, **filters) -> None:
    """The filtered rows as CSV with the export columns, in order."""
    ordered(filtered(activity, **filters)).select(*EXPORT_COLUMNS).write.mode("errorifexists").option("header", True).csv(path)
