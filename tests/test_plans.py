"""What the plans must look like at scale."""

import pytest
from pyspark.sql import functions as F

from assayframe.plans.queries import QUERIES
from assayframe.streaming.shared import shared_path

SF = "/root/testdata/sf0.001"
#: Queries whose plan begins at what they have written.
EAGER = {"incremental_ingest"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_query_pairs_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(QUERIES["pruned_scan"](spark, SF))
    assert "ReadSchema: struct<o_orderstatus:string>" in text
    text = plan(QUERIES["activity_value_stats"](spark, SF))
    assert "l_tax" not in text and "p_brand" not in text


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["merge_by_key"](spark, SF))
    assert "IsNotNull(l_linenumber), EqualTo(l_linenumber,2)" in text and "l_extendedprice" not in text


def test_one_row_per_group_is_combined_before_the_shuffle(spark):
    text = plan(QUERIES["refine_group"](spark, SF))
    assert "partial_min" in text and "Window" not in text


@pytest.mark.parametrize("name", ["activity_summary", "traceability_summary", "enrichment_scope", "consolidate_metrics"])
def test_distinct_counts_multiply_no_row(spark, name):
    assert "Expand" not in plan(QUERIES[name](spark, SF))


def test_consolidation_reads_wide_rows_once_more_and_shuffles_few(spark):
    from assayframe.operators.consolidate import Consolidation
    from assayframe.plans.queries import KIND, _source

    wide = _source(spark, SF)
    wide.write.mode("overwrite").parquet(place := shared_path(spark, "wide"))
    made = Consolidation.of(spark.read.parquet(place), KIND)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(made.consolidated())
        assert text.count("wide-") == 1  # one scan of the source
        below = text[text.rindex("BroadcastHashJoin", 0, text.index("wide-")) :]
        assert "bitmap_construct_agg" in below and "Exchange" not in text[text.rindex("BroadcastHashJoin", 0, text.index("wide-")) : text.index("wide-")]  # filtered before anything is shuffled
        assert "wide-" not in plan(made.metrics())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_hot_structure_stays_where_it_is(spark):
    """One structure with most rows: its rows meet its mean by a broadcast, in all tasks that have some."""
    from assayframe.operators.consolidate import Consolidation
    from tests.test_consolidate import frame, row

    rows = [row(str(i), str(i % 7), smiles="HOT" if i % 3 else f"S{i}", value=float(i % 11 + 1)) for i in range(3000)]
    made = Consolidation.of(frame(spark, rows).repartition(4), "IC50")
    hot = made.structures.filter("Source_Row_Count > 1000").count()
    assert hot == 1 and made.consolidated().count() == 1001
    text = plan(made.nearest())
    assert "BroadcastHashJoin" in text and "Union" in text


def test_filters_by_sets_of_keys_let_all_members_pass(spark):
    from assayframe.operators.skew import may_hold

    rows, keys = spark.range(20_000).selectExpr("concat('k', id) k", "id"), spark.range(0, 20_000, 100).selectExpr("concat('k', id) of")
    kept = {r.id for r in may_hold(rows, F.col("k"), keys, F.col("of")).collect()}
    assert kept >= set(range(0, 20_000, 100)) and len(kept) < 260
    assert may_hold(rows, F.col("k"), keys.limit(0), F.col("of")).count() == 0
