"""Profiles of sets of tables, expectations, and safe changes of column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.text import castable, clean

TYPES = {"TEXT": "string", "INTEGER": "bigint", "REAL": "double"}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rows`` of every table: one count each, in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def origin(table: Column, tool: str) -> Column:
    """What a table's name says of where it comes from; ``tool`` names the property tool that users' tables are called by."""
    low = F.lower(table)
    return F.when(low == "main", "base").when(F.contains(low, F.lit(tool)), f"possible_{tool}").otherwise("derived_inferred")


def statuses(table: Column, rows: Column, columns: Column, duplicate: Column, tool: str) -> Column:
    """Status labels of a table, in a fixed order (fixed values; the label of a tool's output is named by ``tool``)."""
    low, n = F.lower(table), F.size(columns)
    plain = F.transform(columns, lambda c: F.regexp_replace(F.lower(c), "[_ ]", ""))
    has = lambda w: F.contains(low, F.lit(w))
    both = F.array_contains(plain, "cid") & F.array_contains(plain, "smiles")
    return F.array_compact(
        F.array(
            F.when((rows == 0) & (n == 0), "empty").when(rows == 0, "structure_only").otherwise("ok"),
            F.when((n > 0) & (n <= 3), "few_columns"),
            F.when(has("temp") | has("stale"), "possible_temporary"),
            F.when(has("test"), "possible_test_table"),
            F.when(both & (n <= 4), f"possible_{tool}_output"),
            F.when(duplicate, "possible_duplicate"),
        )
    )


def action(table: Column, status: Column, metadata_status: Column) -> Column:
    """The recommended action: the first rule that holds (fixed values)."""
    any_of = lambda *s: F.arrays_overlap(status, F.array(*[F.lit(x) for x in s]))
    return (
        F.when(table == "main", "Keep as base")
        .when(any_of("empty", "structure_only"), "Review or delete")
        .when(any_of("possible_temporary", "possible_test_table"), "Review cleanup")
        .when(any_of("possible_duplicate"), "Compare before use")
        .when(metadata_status == "inferred", "Review provenance")
        .otherwise("Available")
    )


def profile(tables: dict[str, DataFrame], metadata: DataFrame | None = None, tool: str = "property") -> DataFrame:
    """A row per table: rows, columns with types, role, origin, status labels and recommended action.

    ``metadata (table, role, origin)`` wins over what is inferred. Tables with the
    same number of rows and the same columns are possible duplicates; labels that name
    the property tool in use do so by ``tool``.
    """
    spark = next(iter(tables.values())).sparkSession
    shapes = spark.createDataFrame([(n, d.columns, [t for _, t in d.dtypes]) for n, d in tables.items()], "table string, column_names array<string>, column_types array<string>")
    own = shapes.join(row_counts(tables), "table")
    same = own.groupBy("rows", "column_names").agg(F.count("*").alias("alike"))
    own = own.join(same, ["rows", "column_names"])
    if metadata is None:
        own = own.withColumns({"m_role": F.lit(None).cast("string"), "m_origin": F.lit(None).cast("string"), "known": F.lit(False)})
    else:
        named = metadata.select("table", F.col("role").alias("m_role"), F.col("origin").alias("m_origin"), F.lit(True).alias("known"))
        own = own.join(named, "table", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    status = statuses(F.col("table"), F.col("rows"), F.col("column_names"), F.col("alike") > 1, tool)
    out = own.select(
        "table",
        "rows",
        F.size("column_names").cast("long").alias("columns"),
        "column_names",
        "column_types",
        F.coalesce("m_role", F.when(F.col("table") == "main", "base").otherwise("derived")).alias("role"),
        F.coalesce("m_origin", origin(F.col("table"), tool)).alias("origin"),
        F.when(F.col("known"), "registered").otherwise("inferred").alias("metadata_status"),
        status.alias("status"),
    )
    return out.withColumn("recommended_action", action(F.col("table"), F.col("status"), F.col("metadata_status")))


def check_expected(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """``table, problem, expected_rows, actual_rows`` of tables unexpected, missing, or with another number of rows (a null expects any)."""
    e = expected.select("table", F.col("rows").alias("expected_rows"), F.lit(True).alias("e"))
    a = counts.select("table", F.col("rows").alias("actual_rows"), F.lit(True).alias("a"))
    both = e.join(a, "table", "full_outer")
    problem = F.when(F.col("e").isNull(), "unexpected").when(F.col("a").isNull(), "missing").when(F.col("expected_rows") != F.col("actual_rows"), "row_count")
    return both.withColumn("problem", problem).filter("problem is not null").select("table", "problem", "expected_rows", "actual_rows")


def incompatible_values(df: DataFrame, column: str, kind: str, limit: int | None = 5) -> DataFrame:
    """Distinct values of a column that can't become the type, sorted; the first ``limit`` for a report."""
    bad = df.filter(~castable(F.col(f"`{column}`"), kind)).select(F.col(f"`{column}`").cast("string").alias("value")).distinct().orderBy("value")
    return bad if limit is None else bad.limit(limit)


def change_type(df: DataFrame, column: str, kind: str, identifiers: tuple[str, ...] = ()) -> DataFrame:
    """The table with one column cast, blanks to null; refused for identifiers and where a value doesn't fit."""
    if column in identifiers:
        raise ValueError(f"{column} identifies rows; its type stays")
    if found := [r.value for r in incompatible_values(df, column, kind).collect()]:
        raise ValueError(f"{column} has values that aren't {kind}: " + ", ".join(found))
    t = clean(F.col(f"`{column}`"))
    value = F.col(f"`{column}`").cast("string") if kind == "TEXT" else F.nullif(t, F.lit("")).try_cast(TYPES[kind])
    return df.withColumn(column, value)


def database_summary(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many tables and rows."""
    return row_counts(tables).agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"))
