import itertools
import random

import pytest

from assayframe.operators import consolidate as c
from assayframe.operators import features

COLUMNS = ["CID", "AID", "Outcome", "InChIKey", "SMILES_Harmonized", "SMILES_Harmonization_Status", "Activity_Type", "Relation", "Activity_Value", "Activity_Value_Raw", "Unit", "MW"]


def row(cid="1", aid="1", outcome="Active", smiles="CC", status="ok", kind="IC50", relation="=", value=1.0, unit="MICROMOLAR", mw="30"):
    return (cid, aid, outcome, f"key-{smiles}", smiles, status, kind, relation, value, str(value), unit, mw)


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{x} {'double' if x == 'Activity_Value' else 'string'}" for x in COLUMNS))


def only(df):
    (r,) = df.collect()
    return r


def test_geometric_mean_and_nearest_reference(spark):
    r = only(c.consolidate(frame(spark, [row("10", value=100.0, unit="NANOMOLAR"), row("20", value=1.0), row("30", value=10.0)])))
    assert r.Geometric_Mean_Activity_uM == pytest.approx(1.0) and r.Reference_CID == "20" and r.Source_CIDs == ["10", "20", "30"]


def test_ties_go_to_the_least_ids(spark):
    rows = [row("20", "90", value=1.0), row("10", "90", value=100.0), row("10", "80", value=1.0), row("20", "80", value=100.0)]
    for order in itertools.islice(itertools.permutations(rows), 0, 24, 5):
        r = only(c.consolidate(frame(spark, list(order)).repartition(3)))
        assert r.Geometric_Mean_Activity_uM == pytest.approx(10.0) and (r.Reference_CID, r.Reference_AID) == ("10", "80")


def test_only_exact_positive_convertible_values_count(spark):
    bad = [row(relation=x, value=50.0) for x in ("<", "<=", ">", ">=")] + [row(value=x) for x in (0.0, -1.0, float("nan"), float("inf"))] + [row(unit="PERCENT", value=9.0)]
    r = only(c.consolidate(frame(spark, [row(value=2.0), *bad])))
    assert r.Geometric_Mean_Activity_uM == pytest.approx(2.0) and r.Source_Row_Count == 10


def test_a_structure_without_eligible_values_keeps_its_row(spark):
    r = only(c.consolidate(frame(spark, [row("7", relation=">", mw="1"), row("3", relation=">", mw="2")])))
    assert r.Reference_Selection_Status == "no_eligible_activity" and r.Reference_CID is None and r.Geometric_Mean_Activity_uM is None and r.MW == "2"


def test_conflicts_come_before_other_outcomes(spark):
    df = frame(spark, [row(outcome="Active"), row(outcome="inactive "), row(outcome="Probe"), row(smiles="N", outcome="Probe"), row(smiles="O", status="failed"), row(smiles=" ", status="ok"), row(smiles="S")])
    assert only(c.conflicts(df)).SMILES_Harmonized == "CC"
    assert only(c.non_binary(df)).SMILES_Harmonized == "N"
    assert sorted(r.reason for r in c.unusable(df).collect()) == ["harmonization_status:failed", "missing_smiles_harmonized"]
    assert only(c.consolidate(df)).SMILES_Harmonized == "S"


def test_wrong_sources_are_errors(spark):
    with pytest.raises(c.ConsolidationError, match="exactly one"):
        c.consolidate(frame(spark, [row(), row(kind="Ki")]))
    with pytest.raises(c.ConsolidationError, match="missing columns: Unit"):
        c.consolidate(frame(spark, [row()]).drop("Unit"))


def test_metrics_hold_on_random_data_in_any_order(spark):
    r = random.Random(3)
    rows = [row(str(r.randrange(9)), str(r.randrange(5)), r.choice(["Active", "Active", "Inactive", "Other"]), r.choice("ABCDEFGH") * r.randint(1, 3), r.choice(["ok", "ok", "failed"]), value=float(r.randint(0, 5))) for _ in range(150)]
    df = frame(spark, rows)
    made = c.consolidate(df, "IC50")
    metrics = c.metrics(df, made)
    c.check_invariants(metrics)
    again = c.consolidate(frame(spark, rows[::-1]).repartition(5), "IC50")
    assert sorted(map(str, again.collect())) == sorted(map(str, made.collect()))
    encoded = c.metrics_to_json(metrics)
    assert only(c.metrics_from_json(encoded, "metrics_json", metrics.columns)).asDict() == only(metrics).asDict()
    broken = encoded.selectExpr("replace(metrics_json, '\"created_row_count\":', '\"created_row_count\":1') as j")
    assert set(only(c.metrics_from_json(broken, "j", metrics.columns))) == {None}


def test_populations_are_checked(spark):
    df = frame(spark, [row(smiles="B"), row(smiles="A", outcome="Inactive")])
    got = features.population(c.consolidate(df))
    assert sorted(map(tuple, got.collect())) == [("A", "Inactive"), ("B", "Active")]
    bad = spark.createDataFrame([("A", "Active", "selected"), ("A", "odd", "raw")], "SMILES_Harmonized string, Outcome string, Reference_Selection_Status string")
    with pytest.raises(features.PopulationError, match="duplicate_structure.*outcome.*selection_status"):
        features.population(bad)
