"""Selection of compounds by the collections that list them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.names import fresh
from assayframe.operators.activity import one_row


def listed(column: str) -> Column:
    """The collections of a pipe-delimited text."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"\|"), lambda c: F.trim(c)), lambda c: c != "")


def in_collections(df: DataFrame, column: str, targets: list[str], logic: str = "OR") -> DataFrame:
    """Rows in any (OR) or in all (AND) of the target collections."""
    wanted = F.array(*[F.lit(t) for t in targets]).cast("array<string>")
    if logic == "OR":
        return df.filter(F.arrays_overlap(listed(column), wanted))
    if logic == "AND":
        return df.filter(F.size(F.array_except(wanted, listed(column))) == 0)
    raise ValueError("logic is OR or AND")


def in_categories(df: DataFrame, column: str, taxonomy: DataFrame, categories: list[str]) -> DataFrame:
    """Rows listed in any entry of the named taxonomy categories (``category, entry``)."""
    name = fresh("entry", df)
    entries = taxonomy.filter(F.col("category").isin(*categories)).select(F.col("entry").alias(name)).distinct()
    hits = df.withColumn(name, F.explode(listed(column))).join(entries, name, "left_semi").drop(name)
    return hits.dropDuplicates()


def flat_structure(column: str) -> Column:
    """A structure text without its stereo marks."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[@/\\]", "")


def curate(df: DataFrame, structure: str, order: str, column: str, targets: list[str], logic: str = "OR", valid: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(deduplicated, retained, one row of counts): one row per structure without stereo marks, the least by ``order``; then the collections.

    ``valid``, a condition on a row, counts the retained rows that a user's own check accepts.
    """
    key = flat_structure(structure)
    first = F.min(F.struct(F.col(f"`{order}`"), *[F.col(f"`{c}`") for c in df.columns if c != order])).alias("f")
    one = df.groupBy(key.alias("key")).agg(first).select(*[F.col(f"f.`{c}`") for c in df.columns])
    kept = in_collections(one, column, targets, logic)
    n = lambda d, name: d.agg(F.count("*").alias(name))
    good = kept if valid is None else kept.filter(valid)
    report = one_row(n(df, "original_rows"), n(one, "deduplicated_rows"), n(kept, "retained_rows"), n(good, "valid_rows"))
    report = report.select("original_rows", (F.col("original_rows") - F.col("deduplicated_rows")).alias("duplicates_removed"), "deduplicated_rows", "retained_rows", (F.col("retained_rows") - F.col("valid_rows")).alias("invalid_rows"))
    return one, kept, report
