"""One consistently labelled row per structure from repeated measurements.

Structures with contradicting or non-binary outcomes are set aside; of the rest,
values in micromolar are averaged geometrically, and the measurement nearest to
the mean is the reference.

A source's wide rows are read twice and shuffled never: once for narrow rows, from which structures, means, the references' places and
all counters come, and once to fetch the few rows at these places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.names import fresh
from assayframe.functions.text import clean, id_key, micromolar, sorted_ids
from assayframe.operators.activity import one_row
from assayframe.operators.skew import may_hold, meet
from assayframe.streaming.shared import written

#: Columns that a source must have, statuses that make a row usable, and property columns that are carried along (fixed values).
REQUIRED = ("CID", "AID", "Outcome", "InChIKey", "SMILES_Harmonized", "SMILES_Harmonization_Status", "Activity_Type", "Relation", "Activity_Value", "Activity_Value_Raw", "Unit")
USABLE_STATUSES = ("ok", "ok_with_warnings")
PROPERTIES = (
    "InChI", "InChIKey", "SMILES", "ConnectivitySMILES", "SMILES_RDKit", "SMILES_Harmonized", "SMILES_Harmonization_Status", "SMILES_Harmonization_Message",
    "MolecularFormula", "MW", "XLogP", "TPSA", "Charge", "HBondDonorCount", "HBondAcceptorCount", "RotatableBondCount", "HeavyAtomCount",
)
EXACT = ("", "=")
#: Log distances are compared to so many decimals, so that sums in another order break no ties.
DISTANCE_DECIMALS = 12


class ConsolidationError(ValueError):
    """The source can't be consolidated safely."""


def _smiles() -> Column:
    return clean("SMILES_Harmonized")


def _status() -> Column:
    return F.lower(clean("SMILES_Harmonization_Status"))


def usable(df: DataFrame) -> DataFrame:
    return df.filter((_smiles() != "") & _status().isin(*USABLE_STATUSES))


def unusable(df: DataFrame) -> DataFrame:
    """Rows without a usable structure, with the reason (fixed values)."""
    reason = F.when(_smiles() == "", "missing_smiles_harmonized").otherwise(F.concat(F.lit("harmonization_status:"), F.when(_status() == "", "missing").otherwise(_status())))
    return df.filter(~((_smiles() != "") & _status().isin(*USABLE_STATUSES))).select(*[clean(c).alias(c) for c in ("CID", "AID", "Outcome", "SMILES_Harmonized", "SMILES_Harmonization_Status")], reason.alias("reason"))


def activity_type(df: DataFrame) -> str:
    """The one activity type of the usable rows; anything else is an error."""
    t = clean("Activity_Type")
    found = sorted(r[0] for r in usable(df).select(t.alias("t")).filter("t <> ''").distinct().limit(20).collect())
    if len(found) != 1:
        raise ConsolidationError("the usable rows must have exactly one activity type; found: " + (", ".join(found) or "none"))
    return found[0]


def check_columns(df: DataFrame) -> None:
    if missing := sorted(set(REQUIRED) - set(df.columns)):
        raise ConsolidationError("missing columns: " + ", ".join(missing))


#: Names of the helper columns of a source's narrow rows.
_NARROW = ("is_usable", "smiles", "um", "cid", "aid", "outcome")


def narrow(df: DataFrame, kind: str | None = None) -> DataFrame:
    """What grouping needs of every row, and no wide field: whether it is usable, its structure, value in micromolar, ids and outcome."""
    value = F.col("Activity_Value").try_cast("double")
    eligible = (clean("Activity_Type") == F.lit(kind)) & clean("Relation").isin(*EXACT)
    ok = (_smiles() != "") & _status().isin(*USABLE_STATUSES)
    columns = (ok, _smiles(), F.when(eligible, micromolar(value, "Unit")), clean("CID"), clean("AID"), clean("Outcome"))
    return df.select(*[c.alias(n) for c, n in zip(columns, _NARROW, strict=True)])


def groups(rows: DataFrame) -> DataFrame:
    """Per structure of narrow rows: its sources, whether its outcomes are ``active``, ``inactive`` or other, and its mean logarithm."""
    low = F.lower("outcome")
    flag = lambda c: F.max(c.cast("int")) == 1
    return rows.filter("is_usable").groupBy("smiles").agg(
        sorted_ids("cid").alias("Source_CIDs"),
        sorted_ids("aid").alias("Source_AIDs"),
        F.count("*").alias("Source_Row_Count"),
        F.array_sort(F.collect_set("outcome")).alias("Outcomes"),
        flag(low == "active").alias("has_active"),
        flag(low == "inactive").alias("has_inactive"),
        flag(~low.isin("active", "inactive")).alias("has_other"),
        (F.sum(F.log("um").cast("decimal(38,18)")).cast("double") / F.nullif(F.count("um"), F.lit(0))).alias("log_mean"),  # summed exactly, in whatever order
    )


def traces(df: DataFrame) -> DataFrame:
    """Per structure: its sources and whether its outcomes are ``active``, ``inactive`` or other."""
    return groups(narrow(df)).drop("log_mean")


def _excluded(trace: DataFrame, which: Column, reason: str) -> DataFrame:
    return trace.filter(which).select(F.col("smiles").alias("SMILES_Harmonized"), "Source_CIDs", "Source_AIDs", "Source_Row_Count", "Outcomes", F.lit(reason).alias("reason"))


def conflicts(df: DataFrame) -> DataFrame:
    """Structures both active and inactive, whatever else they are."""
    return _excluded(traces(df), F.col("has_active") & F.col("has_inactive"), "active_inactive_conflict")


def non_binary(df: DataFrame) -> DataFrame:
    """Structures with an outcome that is neither, and no conflict."""
    return _excluded(traces(df), ~(F.col("has_active") & F.col("has_inactive")) & F.col("has_other"), "non_binary_or_missing_outcome")


def row_key(columns: list[str]) -> Column:
    """A text that orders equal measurements: the row's columns by name."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


@dataclass
class Consolidation:
    """A source's narrow rows and its structures, both written once; all results come from these and one look at the wide rows."""

    df: DataFrame
    kind: str
    rows: DataFrame
    structures: DataFrame

    @classmethod
    def of(cls, df: DataFrame, kind: str | None = None) -> Consolidation:
        """``kind`` is the activity type; without it the source is asked (one small job) and must have exactly one."""
        check_columns(df)
        kind = kind if kind is not None else activity_type(df)
        rows = written(narrow(df, kind), "narrow")
        return cls(df, kind, rows, written(groups(rows), "structures"))

    def labelled(self) -> DataFrame:
        """The structures with one binary label."""
        return self.structures.filter("not (has_active and has_inactive) and not has_other")

    def nearest(self) -> DataFrame:
        """Per labelled structure the place in the order of references that its best rows share: no value, distance, compound, assay.

        Only narrow rows meet here. The least place is combined before the shuffle, and the rows of a hot structure stay where they are.
        """
        total = self.structures.agg(F.coalesce(F.sum("Source_Row_Count"), F.lit(0))).first()[0]
        own = self.rows.filter("is_usable").select("smiles", "um", "cid", "aid")
        met = meet(own, self.labelled().select("smiles", "log_mean", "Source_Row_Count"), "smiles", "Source_Row_Count", total)
        first = met.groupBy("smiles").agg(F.min(F.struct(_distance(F.col("log_mean")), id_key("cid").alias("cid"), id_key("aid").alias("aid"))).alias("first"), F.first("log_mean").alias("log_mean"))
        return first.select("smiles", F.col("first.cid.text").alias("cid"), F.col("first.aid.text").alias("aid"), "log_mean")

    def references(self) -> DataFrame:
        """Per labelled structure its first row in the whole order, with the wide fields that are carried along.

        Wide rows are read once more; those of no reference's structure, compound and assay are dropped before anything is shuffled.
        """
        carried = [c for c in PROPERTIES if c in self.df.columns and c != "SMILES_Harmonized"]
        value = F.col("Activity_Value").try_cast("double")
        eligible = (clean("Activity_Type") == self.kind) & clean("Relation").isin(*EXACT)
        chosen = written(self.nearest(), "nearest")
        place = fresh("place", self.df)
        rows = usable(self.df).withColumn(place, F.xxhash64(_smiles(), clean("CID"), clean("AID")))
        chosen = chosen.withColumn("place", F.xxhash64("smiles", "cid", "aid"))
        few = may_hold(rows, F.col(place), chosen, F.col("place")).select(
            F.col(place).alias("place"),
            _smiles().alias("smiles"),
            F.when(eligible, micromolar(value, "Unit")).alias("um"),
            id_key("CID").alias("cid"),
            id_key("AID").alias("aid"),
            row_key(self.df.columns).alias("row"),
            F.struct(*[clean(c).alias(c) for c in ("CID", "AID", "Activity_Type", "Relation", "Unit")], value.alias("Activity_Value"), "Activity_Value_Raw").alias("m"),
            F.struct(*carried).alias("p"),
        )
        own = chosen.select(F.col("smiles").alias("of"), F.col("cid").alias("of_cid"), F.col("aid").alias("of_aid"), "place", "log_mean")
        met = few.join(own, "place").filter("smiles = of and cid.text = of_cid and aid.text = of_aid")
        order = F.struct(_distance(F.col("log_mean")), "cid", "aid", "row")
        return met.groupBy("smiles").agg(F.min_by(F.struct("um", "m", "p", "log_mean"), order).alias("b"))

    def consolidated(self) -> DataFrame:
        carried = [c for c in PROPERTIES if c in self.df.columns and c != "SMILES_Harmonized"]
        chosen = self.labelled().drop("log_mean").join(self.references(), "smiles")
        has = F.col("b.um").isNotNull()
        ref = lambda c, name: F.when(has, F.col(c)).alias(name)
        return chosen.select(
            F.col("smiles").alias("SMILES_Harmonized"),
            *[F.col(f"b.p.{c}").alias(c) for c in carried if c == "InChIKey"],
            F.when(F.col("has_active"), "Active").otherwise("Inactive").alias("Outcome"),
            *[ref(f"b.m.{c}", f"Reference_{c}") for c in ("CID", "AID", "Activity_Type", "Relation", "Activity_Value", "Activity_Value_Raw", "Unit")],
            ref("b.um", "Reference_Activity_Value_uM"),
            F.when(has, "selected").otherwise("no_eligible_activity").alias("Reference_Selection_Status"),
            "Source_CIDs",
            "Source_AIDs",
            "Source_Row_Count",
            F.size("Source_AIDs").cast("long").alias("Source_AID_Count"),
            *[F.col(f"b.p.{c}").alias(c) for c in carried if c != "InChIKey"],
            F.when(has, F.exp("b.log_mean")).alias("Geometric_Mean_Activity_uM"),
        )

    def metrics(self) -> DataFrame:
        """The seventeen counters from what is written; no wide row is looked at."""
        made = self.labelled().select(
            F.when(F.col("has_active"), "Active").otherwise("Inactive").alias("Outcome"), "Source_Row_Count", "Source_AIDs",
            F.when(F.col("log_mean").isNotNull(), "selected").otherwise("no_eligible_activity").alias("Reference_Selection_Status"),
        )
        return _counters(self.rows.select("is_usable"), self.structures, made)


def _distance(log_mean: Column) -> Column:
    """Where a row stands in the order of references: rows without a value last, then by distance to the mean."""
    return F.struct(F.col("um").isNull().alias("last"), F.round(F.abs(F.log("um") - log_mean), DISTANCE_DECIMALS).alias("distance")).alias("near")


def consolidate(df: DataFrame, kind: str | None = None) -> DataFrame:
    """One row per consistently labelled structure.

    ``kind`` is the activity type; without it the source is asked (one small job)
    and must have exactly one. A structure without an eligible value keeps its
    row, with null reference columns and the properties of its first measurement.
    """
    return Consolidation.of(df, kind).consolidated()


def with_json_lists(consolidated: DataFrame) -> DataFrame:
    """For an export: the id lists as JSON text."""
    return consolidated.withColumns({c: F.to_json(c) for c in ("Source_CIDs", "Source_AIDs")})


def metrics(df: DataFrame, consolidated: DataFrame) -> DataFrame:
    """One row of the seventeen counters of a consolidation; their names are fixed values.

    Where the ``Consolidation`` is at hand, its own ``metrics`` look at neither table again.
    """
    rows = narrow(df)
    return _counters(rows, groups(rows), consolidated)


def _counters(rows: DataFrame, structures: DataFrame, made: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    is_a, is_i = F.col("Outcome") == "Active", F.col("Outcome") == "Inactive"
    ok, both, other = F.col("is_usable"), F.col("has_active") & F.col("has_inactive"), F.col("has_other")
    source = rows.agg(F.count("*").alias("source_row_count"), n(ok).alias("valid_source_row_count"), n(~ok).alias("unusable_row_count"))
    trace = structures.agg(F.count("*").alias("unique_structure_count"), n(both).alias("conflicting_structure_count"), n(~both & other).alias("non_binary_structure_count"))
    out = made.agg(
        F.count("*").alias("created_row_count"),
        n(is_a).alias("active_structure_count"),
        n(is_i).alias("inactive_structure_count"),
        n(F.when(is_a, F.col("Source_Row_Count"))).alias("active_source_observation_count"),
        n(F.when(is_i, F.col("Source_Row_Count"))).alias("inactive_source_observation_count"),
        n(F.col("Source_Row_Count") - 1).alias("consolidated_duplicate_count"),
        n(F.col("Source_Row_Count")).alias("represented_source_row_count"),
        n(F.col("Reference_Selection_Status") == "selected").alias("selected_reference_count"),
        n(F.col("Reference_Selection_Status") == "no_eligible_activity").alias("no_eligible_activity_count"),
    )
    aids = made.select("Outcome", F.explode("Source_AIDs").alias("aid")).distinct().agg(n(is_a).alias("active_distinct_aid_count"), n(is_i).alias("inactive_distinct_aid_count"))
    return one_row(source, trace, out, aids)


#: What must hold of the counters, in SQL.
INVARIANTS = {
    "outcome_count": "active_structure_count + inactive_structure_count = created_row_count",
    "outcome_evidence": "active_source_observation_count + inactive_source_observation_count = represented_source_row_count",
    "reference_count": "selected_reference_count + no_eligible_activity_count = created_row_count",
    "represented_rows": "represented_source_row_count - created_row_count = consolidated_duplicate_count",
    "source_rows": "valid_source_row_count + unusable_row_count = source_row_count",
    "structures": "created_row_count + conflicting_structure_count + non_binary_structure_count = unique_structure_count",
    "not_negative": "least(created_row_count, consolidated_duplicate_count, unusable_row_count) >= 0",
}


def invariants(metric_row: DataFrame) -> DataFrame:
    """One row with a boolean per invariant."""
    return metric_row.select(*[F.expr(e).alias(k) for k, e in INVARIANTS.items()])


def check_invariants(metric_row: DataFrame) -> None:
    if broken := [k for k, v in invariants(metric_row).first().asDict().items() if not v]:
        raise ConsolidationError("broken invariants: " + ", ".join(broken))


def metrics_to_json(metric_row: DataFrame) -> DataFrame:
    return metric_row.select(F.to_json(F.struct(*sorted(metric_row.columns))).alias("metrics_json"))


def metrics_from_json(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The counters of a JSON text; all null where a field is missing or an invariant is broken."""
    parsed = F.from_json(column, ", ".join(f"{n} long" for n in sorted(names)))
    whole = df.select(parsed.alias("m"))
    good = F.lit(True)
    for n in names:
        good &= F.col(f"m.{n}").isNotNull()
    rows = whole.select(*[F.when(good, F.col(f"m.{n}")).alias(n) for n in sorted(names)])
    holds = F.lit(True)
    for e in INVARIANTS.values():
        holds &= F.coalesce(F.expr(e), F.lit(False))
    return rows.select(*[F.when(holds, F.col(n)).alias(n) for n in sorted(names)])
