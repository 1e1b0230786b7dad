"""Activity records from long assay cells ``(AID, row_no, pos, column, value)``.

A row's cells become one map, so every rule about a row is a look-up in it; only
the assay's unit row is joined. The first non-blank activity column of a row wins
by keyword and then by header position, numeric or not; a row without one falls
back to its standard column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.text import activity_text, clean, number

#: Keywords of activity columns, the strongest first (fixed values).
KEYWORDS = ("IC50", "EC50", "AC50", "GI50", "LC50", "Ki", "Kd", "Potency")
#: Standard columns (fixed names).
STANDARD_VALUES = ("PubChem Standard Value", "Standard Value")
STANDARD_TYPES = ("PubChem Standard Type", "Standard Type")
PUBCHEM_UNITS = ("PubChem Standard Unit", "PubChem Standard Units")
STANDARD_UNITS = ("Standard Unit", "Standard Units")
STANDARD_RELATIONS = ("PubChem Standard Relation", "Standard Relation")
TAG, CID, OUTCOME = "PUBCHEM_RESULT_TAG", "PUBCHEM_CID", "PUBCHEM_ACTIVITY_OUTCOME"


def _is_qualifier(column: Column) -> Column:
    return F.replace(F.lower(F.trim(column)), F.lit("_"), F.lit(" ")).endswith(" qualifier")


def keyword_rank(column: Column) -> Column:
    """The place of the first keyword in a column's name; null if it is no activity column."""
    low, rank = F.lower(column), F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(KEYWORDS))):
        rank = F.when(F.contains(low, F.lit(k.lower())), F.lit(i)).otherwise(rank)
    return F.when(~column.startswith("PUBCHEM_") & ~_is_qualifier(column), rank)


def rows(cells: DataFrame) -> DataFrame:
    """``AID, row_no, cells, candidates``: a row's values by column (the last of a repeated one) and its non-blank activity columns in order of choice."""
    one = cells.groupBy("AID", "row_no", "column").agg(F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    rank = keyword_rank(F.col("column"))
    candidate = F.when(rank.isNotNull() & (clean("value") != ""), F.struct(rank.alias("rank"), F.col("pos"), F.col("column")))
    return one.groupBy("AID", "row_no").agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.coalesce("value", F.lit("")).alias("value")))).alias("cells"),
        F.min(candidate).alias("first_column"),
        F.max(rank.isNotNull() | F.col("column").isin(*STANDARD_VALUES)).alias("has_header"),
    )


def _get(cells: Column, column: Column | str) -> Column:
    key = F.lit(column) if isinstance(column, str) else column
    return clean(F.try_element_at(cells, key))


def _first(cells: Column, columns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(_get(cells, c), F.lit("")) for c in columns], F.lit(""))


def _qualifier(cells: Column, column: Column) -> Column:
    forms = [_get(cells, F.concat(column, F.lit(end))) for end in ("_Qualifier", " Qualifier")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in forms], F.lit(""))


def units(cells: DataFrame) -> DataFrame:
    """``AID, units``: the first RESULT_UNIT row of each assay, as a map."""
    own = rows(cells).filter(F.try_element_at("cells", F.lit(TAG)) == "RESULT_UNIT")
    return own.groupBy("AID").agg(F.min_by("cells", "row_no").alias("units"))


def with_choice(cells: DataFrame) -> DataFrame:
    """Data rows (a tag of digits, a compound) with all that a record is made of."""
    c, unit_row = F.col("cells"), F.coalesce(F.col("units"), F.create_map().cast("map<string,string>"))
    data = rows(cells).filter(F.coalesce(F.try_element_at("cells", F.lit(TAG)), F.lit("")).rlike(r"^\d+$") & (_get(c, CID) != ""))
    data = data.join(units(cells), "AID", "left").withColumn("units", unit_row)
    own, u = F.col("first_column.column"), F.col("units")
    standard = F.coalesce(*[F.when(_get(c, s) != "", F.lit(s)) for s in STANDARD_VALUES])
    unit_of = lambda column: _get(u, column)
    either = lambda *cols: F.coalesce(*[F.nullif(x, F.lit("")) for x in cols], F.lit(""))
    kind = _first(c, STANDARD_TYPES)
    fallback = F.when(kind == "Relative potency", "dimensionless").otherwise("")
    standard_unit = F.when(
        F.col("standard") == STANDARD_VALUES[0], either(unit_of(STANDARD_VALUES[0]), _first(c, PUBCHEM_UNITS + STANDARD_UNITS), fallback)
    ).otherwise(either(_first(c, STANDARD_UNITS + PUBCHEM_UNITS), unit_of(STANDARD_VALUES[1]), fallback))
    data = data.withColumn("own", own).withColumn("standard", F.when(F.col("own").isNull(), standard))
    is_own = F.col("own").isNotNull()
    source = F.coalesce("own", "standard")
    return data.select(
        "AID",
        "row_no",
        "cells",
        "has_header",
        _get(c, CID).alias("CID"),
        _get(c, TAG).alias("Result_Tag"),
        _get(c, OUTCOME).alias("Outcome"),
        source.alias("Source_Column"),
        is_own.alias("is_own"),
        F.when(is_own, F.lit("")).otherwise(kind).alias("standard_type"),
        F.when(is_own, F.col("own")).otherwise(F.coalesce(F.nullif(kind, F.lit("")), F.col("standard"))).alias("Activity_Type"),
        F.when(is_own, _qualifier(c, F.col("own"))).otherwise(either(_first(c, STANDARD_RELATIONS), _qualifier(c, F.col("standard")))).alias("Relation"),
        _get(c, source).alias("Activity_Value_Raw"),
        F.when(is_own, unit_of(F.col("own"))).otherwise(standard_unit).alias("Unit"),
    )


def extract(cells: DataFrame) -> DataFrame:
    """Activity records: a row for each data row whose chosen value is a number."""
    chosen = with_choice(cells).filter("Source_Column is not null").withColumn("Activity_Value", number("Activity_Value_Raw"))
    return chosen.filter("Activity_Value is not null").select("CID", "AID", "Activity_Type", "Relation", "Activity_Value", "Activity_Value_Raw", "Unit", "Outcome", "Source_Column", F.lit("enriched").alias("Activity_Status"), "Result_Tag")


def descriptions(cells: DataFrame) -> DataFrame:
    """``CID, types, values`` per compound and assay: the chosen columns and their formatted texts, numeric or not."""
    chosen = with_choice(cells).filter("Source_Column is not null")
    told = activity_text(F.col("AID"), F.col("Source_Column"), F.col("Activity_Value_Raw"), F.col("Relation"), F.col("Unit"), F.col("Outcome"), F.col("standard_type"))
    return chosen.groupBy("CID", "AID").agg(F.array_sort(F.collect_set("Source_Column")).alias("types"), F.array_sort(F.collect_set(told)).alias("values"))


def failures(cells: DataFrame) -> DataFrame:
    """``AID, row_no, CID, failure`` for data rows that give no record.

    The classes are: unsupported_activity_column, no_numeric_value_for_cid, outcome_only, assay_has_no_quantitative_activity.
    """
    known = [*STANDARD_VALUES, *STANDARD_TYPES, *PUBCHEM_UNITS, *STANDARD_UNITS, *STANDARD_RELATIONS]
    other = F.exists(F.map_entries("cells"), lambda e: (clean(e["value"]) != "") & ~e["key"].startswith("PUBCHEM_") & ~e["key"].isin(*known) & ~_is_qualifier(e["key"]))
    failed = with_choice(cells).filter(F.col("Source_Column").isNull() | number("Activity_Value_Raw").isNull())
    outcome = F.col("Outcome") != ""
    kind = (
        F.when(other, "unsupported_activity_column")
        .when(F.col("has_header") & ~outcome, "no_numeric_value_for_cid")
        .when(outcome, "outcome_only")
        .otherwise("assay_has_no_quantitative_activity")
    )
    return failed.select("AID", "row_no", "CID", kind.alias("failure"))
