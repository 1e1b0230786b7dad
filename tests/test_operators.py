import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayframe.operators import activity, assay, collections, enrich, features, identity, links, merge, neighbours, profile, refine
from assayframe.sources import readers, writers
from assayframe.streaming import ingest


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# activity and refinement


@pytest.fixture(scope="module")
def acts(spark):
    data = [("1", "10", "IC50", "Active", "uM", ">", 5.0, "1"), ("2", "9", "Ki", "", "nM", "", None, "2"), ("2", "9x", "IC50", None, "uM", "=", 7.0, "3"), ("3", "x", "IC50", "Active", "", "<", 5.0, "1")]
    return spark.createDataFrame(data, "CID string, AID string, Activity_Type string, Outcome string, Unit string, Relation string, Activity_Value double, Result_Tag string")


def test_filters(acts):
    assert activity.filtered(acts, types=["IC50", "", None], value_range=(5.0, 6.0)).count() == 2
    assert activity.filtered(acts, types=[], outcomes=[" "]).count() == 4
    assert activity.filtered(acts, value_range=(None, 100.0)).count() == 3
    assert activity.filtered(acts, aids=[str(i) for i in range(2000)]).count() == 2


def test_summary_stats_and_order(acts):
    s = activity.summary(acts).first()
    assert (s.row_count, s.cid_count, s.aid_count, s.min_value, s.max_value) == (4, 3, 4, 5.0, 7.0)
    assert s.outcomes == ["Active"] and s.units == ["nM", "uM"]
    assert tuple(activity.value_stats(acts).first()) == (3, 5.0, 7.0, 2)
    assert tuple(activity.value_stats(acts.limit(0)).first()) == (0, None, None, 0)
    assert [r.AID for r in activity.ordered(acts).collect()] == ["x", "9", "9x", "10"]
    assert [r.CID for r in activity.cids(acts).collect()] == ["1", "2", "3"]


def test_refine(spark):
    df = spark.createDataFrame([(1, "9", None), (2, "50", "b"), (3, "100", "b"), (4, "abc", "a")], "id int, mw string, k string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(refine.refine(df, ["id"], where=refine.Condition("mw", ">", 100))) == [1, 2, 4]
    assert ids(refine.refine(df, ["id"], where=refine.Condition("mw", ">", 40, "numeric"))) == [2, 3]
    assert ids(refine.refine(df, ["id"], where=refine.Condition("k", "is null"))) == [1]
    assert rows(refine.refine(df, ["k", "id", "gone"], group_by="k"), "id") == [(None, 1), ("b", 2), ("a", 4)]
    assert [r.id for r in refine.refine(df, ["id", "k"], order_by="k").collect()][0] == 1
    for wrong in ({"columns": []}, {"columns": ["id"], "group_by": "k"}, {"columns": ["id"], "where": refine.Condition("zz", "=", 1)}, {"columns": ["id", "k"], "group_by": "k", "order_by": "k"}):
        with pytest.raises(ValueError):
            refine.refine(df, **wrong)
    with pytest.raises(ValueError, match="x, y"):
        refine.project(df, ["x", "id", "y"])
    assert refine.project_active(df, ["k", "x", "id"]).columns == ["k", "id"]
    assert refine.group_count(df, "k").first()[0] == 3 and refine.group_count(df, "zz").first()[0] == 0
    assert refine.contains(df, "k", "B").count() == 2 and refine.contains(df, "zz", "b").count() == 0 and refine.contains(df, "mw", "1_0").count() == 1
    with pytest.raises(ValueError):
        refine.preview(df, 11)
    assert refine.row_count(None) == 0


def test_row_ids_follow_the_partitions(spark):
    df = spark.range(100).repartition(7).select("id")
    numbered = refine.with_row_ids(df)
    assert sorted(r.primary_id for r in numbered.collect()) == list(range(1, 101))


def test_keep_last_and_first_seen(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, s int, v string")
    assert rows(refine.keep_last(df, "k", "s"), "k") == [("a", 3, "y"), ("b", 2, None)]
    ids = spark.createDataFrame(list(enumerate(["1", "1.0", "2", "bad", None, "2"])), "s int, v string")
    from assayframe.functions.text import compound_id

    assert [r.key for r in refine.first_seen(ids, compound_id("v"), "s").collect()] == ["1", "2"]


# merges


def test_merge_by_key(spark):
    t = spark.createDataFrame([(1, "a", "k"), (2, "b", "k"), (2, "c", "k")], "id int, v string, w string")
    u = spark.createDataFrame([(2, None, 5), (9, "z", 6)], "pk int, v string, n int")
    assert rows(merge.merge_by_key(t, u, "id", "pk"), "id", "n") == [(1, "a", "k", None), (2, None, "k", 5), (2, None, "k", 5)]
    assert merge.merge_by_key(t, u, "id", "pk", []) is t
    twice = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "id int, v string, s int")
    assert ("new" in {r.v for r in merge.merge_by_key(t, twice, "id", sequence="s").collect()}) and merge.merge_by_key(t, twice, "id", sequence="s").count() == 3


def test_insert_ignore_is_idempotent_and_nulls_never_repeat(spark):
    t = spark.createDataFrame([("1", "a"), ("2", None)], "k string, l string")
    n = spark.createDataFrame([("1", "a"), ("3", "c"), ("3", "c"), ("2", None)], "k string, l string")
    once = merge.insert_ignore(t, n, ["k", "l"])
    assert rows(once, "k", "l") == [("1", "a"), ("2", None), ("2", None), ("3", "c")]
    whole = n.filter("l is not null")
    assert merge.insert_ignore(merge.insert_ignore(t, whole, ["k", "l"]), whole, ["k", "l"]).count() == 3


def test_upserts(spark):
    schema = "CID string, AIDs string, Proteins string, Compound_Name string, Activity_Enrichment_Status string"
    t = spark.createDataFrame([("1", "a", "p", "", "s"), ("2", "a", "p", "kept", "s"), ("4", "a", "p", "n", "s")], schema)
    u = spark.createDataFrame([("1", "b", "q", "new", "e"), ("2", "b", "q", "new", "e"), ("3", "b", "q", "new", "e")], schema)
    once = merge.upsert_compounds(t, u)
    assert rows(once, "CID") == [("1", "b", "q", "new", "e"), ("2", "b", "q", "kept", "e"), ("3", "b", "q", "new", "e"), ("4", "a", "p", "n", "s")]
    assert rows(merge.upsert_compounds(once, u), "CID") == rows(once, "CID")
    cache = spark.createDataFrame([("1", "success", "t0", None, "x"), ("2", "failed", "t0", "e", None)], "PubChem_CID string, status string, fetched_at string, error_message string, MW string")
    res = spark.createDataFrame([("1", "failed", "down", None, None), ("2", "success", None, 2, "f")], "PubChem_CID string, status string, error_message string, MW int, F string")
    assert rows(merge.upsert_cache(cache, res, "t1"), "PubChem_CID") == [("1", "failed", "t1", "down", "x", None), ("2", "success", "t1", None, "2", "f")]


# enrichment and links


def test_keys_are_split_and_enrichment_is_incremental(spark):
    df = spark.createDataFrame([("1",), ("2.0",), ("bad",), (None,), ("2",)], "cid string")
    cache = spark.createDataFrame([("1", "success", "t0", None, "a"), ("2", "failed", "t0", "x", None)], "PubChem_CID string, status string, fetched_at string, error_message string, MW string")
    assert {(r.key, r.raw, r.state) for r in enrich.split_keys(df, "cid", cache).collect()} == {("1", None, "cached"), ("2", None, "pending"), (None, "bad", "invalid"), (None, None, "invalid")}

    def runner(frame):
        if (frame["CID"] == "3").any():
            raise RuntimeError("chunk failed")
        return pd.DataFrame({"PubChem_CID": frame["CID"], "M W:": frame["CID"] + "g"})

    table, refreshed = enrich.enrich(df, "cid", cache, runner=runner, columns=["M W:"], fetched_at="t1")
    assert {r.M_W for r in table.filter("cid like '2%'").collect()} == {"2g"}
    assert enrich.split_keys(df, "cid", refreshed).filter("state = 'pending'").count() == 0
    failed = enrich.run_function(spark.createDataFrame([("3",)], "k string"), runner, ["MW"]).first()
    assert (failed.status, failed.error_message) == ("failed", "chunk failed")
    assert tuple(enrich.progress(refreshed).first()) == (2, 2, 0)
    assert enrich.missing_results(spark.createDataFrame([("1",), ("9",)], "k string"), refreshed).first().PubChem_CID == "9"


def test_links(spark):
    pa = spark.createDataFrame([("P1", "1"), ("P2", "1"), ("P2", "2")], "Protein string, AID string")
    ac = spark.createDataFrame([("1", "10"), ("2", "10"), ("2", "11")], "AID string, CID string")
    found = links.expand(pa, ac)
    assert found.count() == 4
    names = spark.createDataFrame([("10", "ten")], "CID string, Title string")
    assert rows(links.fold(found, names, names), "CID") == [("10", "1, 2", "P1, P2", "ten", "enriched"), ("11", "2", "P2", "", "partial_or_failed")]
    assert rows(links.jobs(found), "Protein", "AID") == [("P1", "1", ["10"]), ("P2", "1", ["10"]), ("P2", "2", ["10", "11"])]
    jobs = spark.createDataFrame([("1", ["10"]), ("2", [])], "AID string, CIDs array<string>")
    got = spark.createDataFrame([("1", "10"), ("1", "12"), ("2", "99"), ("3", "10")], "AID string, CID string")
    assert rows(links.expected_only(got, jobs), "AID") == [("1", "10"), ("2", "99")]
    assert tuple(links.enrichment_scope(found).first()) == (3, 4, 2)


# assays and readers


def test_assay_files(spark, tmp_path):
    (tmp_path / "aid_77.csv").write_text(
        "PUBCHEM_RESULT_TAG,PUBCHEM_CID,PUBCHEM_ACTIVITY_OUTCOME,Ki,IC50,IC50 Qualifier,PubChem Standard Value,Standard Type,Standard Relation\n"
        "RESULT_TYPE,,,,,,,,\nRESULT_UNIT,,,MICROMOLAR,NANOMOLAR,,MICROMOLAR,,\n"
        "1,5,Active,3,\"1,200\",>,,,\n2,6,Inactive,4,,,,,\n3,7,Active,,,,12.3,IC50,>\n4,8,Active,,n/a,,5,Ki,\n5,,Active,1,,,,,\n6,9,,,,,,,\n"
    )
    (tmp_path / "aid_78.csv").write_text("PUBCHEM_RESULT_TAG,PUBCHEM_CID,PUBCHEM_ACTIVITY_OUTCOME,Comment\n1,5,Active,\"two\nlines\"\n")
    cells = readers.assay_cells(spark, f"{tmp_path}/*.csv").cache()
    got = [(r.AID, r.CID, r.Activity_Type, r.Relation, r.Activity_Value, r.Unit) for r in assay.extract(cells).orderBy("AID", "CID").collect()]
    assert got == [("77", "5", "IC50", ">", 1200.0, "NANOMOLAR"), ("77", "6", "Ki", "", 4.0, "MICROMOLAR"), ("77", "7", "IC50", ">", 12.3, "MICROMOLAR")]
    assert {(r.AID, r.CID, r.failure) for r in assay.failures(cells).collect()} == {("77", "8", "unsupported_activity_column"), ("77", "9", "no_numeric_value_for_cid"), ("78", "5", "unsupported_activity_column")}
    told = {r.CID: r["values"] for r in assay.descriptions(cells).collect()}
    assert told["5"] == ["AID 77: IC50 > 1,200 NANOMOLAR (Active)"] and told["7"] == ["AID 77: PubChem Standard Value (IC50) > 12.3 MICROMOLAR (Active)"]


def test_json_and_csv_readers(spark, tmp_path):
    (tmp_path / "P9_aids.json").write_text('{"IdentifierList": {"AID": [3, 4, 3]}}')
    assert rows(readers.protein_aids(spark, str(tmp_path / "P9_aids.json")), "AID") == [("P9", "3"), ("P9", "4")]
    body = '{"InformationList": {"Information": [{"AID": 1, "CID": [5, 6]}, {"CID": [7]}]}}'
    docs = spark.createDataFrame([(0, ["1", "2"], body), (1, ["1"], '{"InformationList": {"Information": [{"CID": [8]}]}}')], "batch_no int, asked array<string>, body string")
    assert rows(readers.aid_cids(docs)) == [("1", "8")]
    names = spark.createDataFrame([(0, '{"PropertyTable": {"Properties": [{"CID": 1, "Title": " a "}, {"CID": 2, "Title": " "}, {"CID": 1, "Title": "b"}]}}')], "batch_no int, body string")
    assert rows(readers.titles(names)) == [("1", "b")]
    (tmp_path / "t.csv").write_text(' My Col ,n\n"x, ""y""",1\n,2\n')
    df = readers.csv_table(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("primary_id", "bigint"), ("My_Col", "string"), ("n", "string")] and rows(df) == [(1, 'x, "y"', "1"), (2, None, "2")]
    (tmp_path / "tax.json").write_text('{"name": "N", "category": "C", "entries": ["a", "b"]}')
    assert readers.taxonomy(spark, str(tmp_path / "tax.json")).count() == 2
    with pytest.raises(ValueError):
        readers.required(df, ["n", "zz"])


def test_writers(spark, tmp_path, acts):
    writers.export_subgroup(acts, str(tmp_path / "a"), "AID", "9", ["CID", "AID"])
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 2
    activity.export(acts.withColumns({c: F.lit("x") for c in ("Protein", "Source_Column", "Activity_Status")}), str(tmp_path / "b"), types=["IC50"])
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).columns == list(activity.EXPORT_COLUMNS)
    made = writers.derive_table(spark.createDataFrame([("5", float("nan"))], "a string, b double"), "derived_for_test", {"a": "INTEGER"})
    assert rows(made) == [(5, None)]
    with pytest.raises(ValueError):
        writers.derive_table(acts, "derived_for_test")


# neighbours, features and identity


def fps(spark, matrix, outcomes):
    data = [(f"m{i:03d}", o, [int(k) for k in np.flatnonzero(m)]) for i, (m, o) in enumerate(zip(matrix, outcomes))]
    return spark.createDataFrame(data, "id string, outcome string, bits array<int>")


def test_four_fingerprints(spark):
    m = [[1, 1, 0, 0], [1, 1, 1, 0], [0, 0, 1, 1], [0, 0, 0, 1]]
    out = neighbours.nearest(fps(spark, m, ["Active", "Active", "Inactive", "Inactive"]), 4)
    assert [(r.neighbour_id, round(r.similarity, 6)) for r in out.orderBy("id").collect()] == [("m001", 0.666667), ("m000", 0.666667), ("m003", 0.5), ("m002", 0.5)]
    assert tuple(neighbours.modelability_index(out).first()) == (1.0, 4)


def test_empty_fingerprints_are_nan_and_nearest(spark):
    out = neighbours.nearest(fps(spark, [[0, 0], [1, 0], [0, 0], [0, 0]], ["Active"] * 4), 2)
    got = [(r.neighbour_id, r.similarity) for r in out.orderBy("id").collect()]
    assert [g[0] for g in got] == ["m002", "m000", "m000", "m000"] and got[0][1] != got[0][1] and got[1][1] == 0.0
    with pytest.raises(ValueError):
        neighbours.modelability_index(out)
    assert neighbours.nearest(fps(spark, [[1]], ["Active"]), 1).count() == 0


@pytest.mark.parametrize("block", [20_000, 40])
def test_neighbours_against_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    m = rng.random((130, 130)) < 0.1
    m[5] = m[6]
    both = m.astype(int) @ m.T.astype(int)
    n = m.sum(1)
    sim = both / np.maximum(n[:, None] + n[None] - both, 1)
    np.fill_diagonal(sim, -1)
    out = neighbours.nearest(fps(spark, m, ["Active", "Inactive"] * 65), 130, block).orderBy("id").collect()
    assert [int(r.neighbour_id[1:]) for r in out] == sim.argmax(1).tolist()
    assert np.allclose([r.similarity for r in out], sim.max(1))


def test_features_and_identity(spark, tmp_path):
    df = fps(spark, [[1, 0], [0, 1], [1, 1]], ["Active", "Inactive", "Active"])
    one = identity.data_identity(df, ["id", "outcome"], "m").first().identity
    assert identity.data_identity(df.repartition(5), ["id", "outcome"], "m").first().identity == one
    assert identity.data_identity(df, ["id", "outcome"], "n").first().identity != one
    assert identity.data_identity(df.limit(2), ["id", "outcome"], "m").first().identity != one
    out, meta = features.export(df.repartition(3), one, "m")
    assert [(r.row_index, r.id, r.y) for r in out.orderBy("row_index").collect()] == [(0, "m000", 1), (1, "m001", 0), (2, "m002", 1)] and meta.first().active_rows == 2
    with pytest.raises(features.PopulationError):
        features.export(df.limit(1), one, "m")
    calls = itertools.count()

    def compute():
        next(calls)
        return df

    stored, manifest = identity.restore_or_compute(None, "s", one, compute, str(tmp_path / "f"), ["id", "bits"])
    again, _ = identity.restore_or_compute(manifest, "s", one, compute, str(tmp_path / "g"), ["id", "bits"])
    assert next(calls) == 1 and again.count() == 3
    assert identity.read_stored(manifest, "s", one, ["id", "bits"]).count() == 3
    with pytest.raises(LookupError):
        identity.read_stored(manifest, "s", "other", ["id", "bits"])
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "f"))
    with pytest.raises(ValueError):
        identity.read_stored(manifest, "s", one, ["id", "bits"])
    grams = features.hashed_ngrams(spark.createDataFrame([("abcd",), ("ab",), (None,)], "t string"), "t").collect()
    assert len(grams[0].bits) == 2 and grams[1].bits == [] and grams[2].bits == []


def test_order_index_over_many_ranges(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("k"))
    out = features.with_order_index(df, "k", 16).orderBy("row_index").collect()
    assert [r.row_index for r in out] == list(range(1000)) and [r.k for r in out] == sorted(r.k for r in out)


# profiles, collections, ingest


def test_profiles(spark):
    t = {"main": spark.createDataFrame([(1, "1", "2")], "primary_id int, CID string, MW string"), "temp_x": spark.createDataFrame([("1", "C")], "CID string, SMILES string"), "temp_y": spark.createDataFrame([("1", "C")], "CID string, SMILES string"), "none": spark.createDataFrame([], "a int, b int, c int, d int")}
    p = {r.table: r for r in profile.profile(t).collect()}
    assert p["main"].recommended_action == "Keep as base" and p["main"].role == "base"
    assert p["temp_x"].status == ["ok", "few_columns", "possible_temporary", "possible_property_output", "possible_duplicate"] and p["temp_x"].recommended_action == "Review cleanup"
    assert p["none"].status == ["structure_only"] and p["none"].recommended_action == "Review or delete"
    df = spark.createDataFrame([("1", "5"), ("2", " "), ("3", None)], "id string, v string")
    assert rows(profile.change_type(df, "v", "INTEGER"), "id") == [("1", 5), ("2", None), ("3", None)]
    with pytest.raises(ValueError):
        profile.change_type(df, "id", "REAL", identifiers=("id",))
    with pytest.raises(ValueError, match="x"):
        profile.change_type(df.unionByName(spark.createDataFrame([("4", "x")], "id string, v string")), "v", "REAL")


def test_collections(spark):
    df = spark.createDataFrame([("2", "C@H", "a|b"), ("1", "CH", "b"), ("3", "N", " c "), ("4", None, None)], "id string, s string, c string")
    assert [r.id for r in collections.in_collections(df, "c", ["a", "c"]).orderBy("id").collect()] == ["2", "3"]
    assert collections.in_collections(df, "c", ["a", "b"], "AND").first().id == "2"
    tax = spark.createDataFrame([("k", "b"), ("k", "a")], "category string, entry string")
    assert collections.in_categories(df, "c", tax, ["k"]).count() == 2
    assert tuple(collections.curate(df, "s", "id", "c", ["b"])[2].first()) == (4, 1, 3, 1, 0)


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(str(i % 4), *["x"] * 9) for i in range(8)] + [(None, *["x"] * 9)], ", ".join(f"{k} string" for k in ingest.KEY))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    ledger = ingest.activity_ledger(spark, f"file://{tmp_path}/table")
    for run in ("one", "two"):
        stream = ingest.activity_stream(spark, str(tmp_path / "in"), df.schema, 1)
        ingest.stream(stream, ledger, str(tmp_path / run)).awaitTermination()
    assert ledger.rows().count() == 5


def test_approximate_neighbours_cover_every_row(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), "Active", np.flatnonzero(rng.random(64) < 0.4).tolist()) for i in range(200)] + [("none", "Active", [])]
    df = spark.createDataFrame(rows, "id string, outcome string, bits array<int>")
    got = {r.id: r.similarity for r in neighbours.approximate_all(df, 64).collect()}
    best = {r.id: r.similarity for r in neighbours.nearest(df, 64).collect()}
    assert set(got) == {r[0] for r in rows}
    recall = np.mean([got[i] >= best[i] - 1e-9 for i in best])
    assert recall >= 0.95
    print("recall", recall, "found by hashes", neighbours.approximate(df, 64, 0.5).count())


def test_repeated_updates_give_one_row_each(spark):
    target = spark.createDataFrame([("1", "a", "P", "", "s", "b"), ("2", "a", "P", "two", "s", "b"), (None, "a", "P", "none", "s", "b")], "CID string, AIDs string, Proteins string, Compound_Name string, Activity_Enrichment_Status string, Brand string")
    new = [("1", "x", "Q", "", "t", 1), ("1", "y", "Q", "first", "t", 2), ("1", "z", "Q", "second", "u", 3), ("2", "x", "Q", "other", "t", 1), ("2", "y", "Q", None, "t", 2), ("3", "n", "Q", "three", "t", 1)]
    updates = spark.createDataFrame(new, "CID string, AIDs string, Proteins string, Compound_Name string, Activity_Enrichment_Status string, seq int")
    got = {r.CID: (r.AIDs, r.Compound_Name, r.Activity_Enrichment_Status) for r in merge.upsert_compounds(target, updates, "seq").collect()}
    assert got == {"1": ("z", "first", "u"), "2": ("y", "two", "t"), "3": ("n", "three", "t"), None: ("a", "none", "s")}
    assert merge.upsert_compounds(target, updates.drop("seq")).groupBy("CID").count().filter("count > 1").count() == 0
    cache = spark.createDataFrame([("1", "failed", "t0", "x")], "PubChem_CID string, status string, fetched_at string, error_message string")
    results = spark.createDataFrame([("1", "success", None, "a", 1), ("1", "success", None, "b", 2)], "PubChem_CID string, status string, error_message string, Brand string, seq int")
    assert [tuple(r) for r in merge.upsert_cache(cache, results, "t1", "seq").collect()] == [("1", "success", "t1", None, "b")]


def test_null_keys_stay_out_of_the_merge_join(spark):
    target = spark.range(1000).selectExpr("case when id % 10 = 0 then cast(id as string) end as k", "id")
    out = merge.merge_by_key(target, spark.createDataFrame([("10", "hit"), (None, "never")], "k string, v string"), "k")
    assert sorted((r.id, r.v) for r in out.filter("v is not null").collect()) == [(10, "hit")] and out.count() == 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 1000") == 1 and "monotonically_increasing_id" in plan  # evaluated once, and null keys are spread


@pytest.mark.parametrize("wave", [1, 2, 100])
def test_a_failing_chunk_stops_the_run(spark, wave):
    def runner(frame):
        if "5" in set(frame["CID"]):
            raise ValueError("no service")
        return pd.DataFrame({"PubChem_CID": frame["CID"], "v": [1] * len(frame)}).iloc[: 1 if "1" in set(frame["CID"]) else None]

    keys = spark.createDataFrame([(str(i),) for i in range(10)], "k string").repartition(3)
    stop = {r.PubChem_CID: (r.status, r.error_message, r.v) for r in enrich.run_function(keys, runner, ["v"], 2, "stop", wave).collect()}
    assert stop == {"0": ("success", None, "1"), "1": ("failed", "no result returned", None), "2": ("success", None, "1"), "3": ("success", None, "1"), "4": ("failed", "no service", None), "5": ("failed", "no service", None)}
    none = enrich.run_function(keys.limit(0), runner, ["v"], 2, "stop", wave)
    assert none.collect() == [] and none.columns == ["PubChem_CID", "status", "error_message", "v"]


def test_a_failing_chunk_is_marked_or_raises(spark):
    def runner(frame):
        if "3" in set(frame["CID"]):
            raise ValueError("no service")
        return pd.DataFrame({"PubChem_CID": frame["CID"], "v": [1] * len(frame)})

    keys = spark.createDataFrame([(str(i),) for i in range(8)], "k string").coalesce(1)
    mark = {r.PubChem_CID: r.status for r in enrich.run_function(keys, runner, ["v"], 1).collect()}
    assert mark == {str(i): "failed" if i == 3 else "success" for i in range(8)}
    with pytest.raises(Exception, match="no service"):
        enrich.run_function(keys, runner, ["v"], 2, "raise").collect()
    with pytest.raises(ValueError):
        enrich.run_function(keys, runner, ["v"], 2, "other")


def test_csv_records_across_blocks(spark, tmp_path):
    """Quoted line breaks, also where Spark cuts a file: the cells are those of one reader over the whole file."""
    import csv
    import io
    import random

    r = random.Random(2)
    said = lambda: "".join(r.choice(["a", "é", ",", '"', "\n", "\r\n", " ", ""]) for _ in range(r.randint(0, 8)))
    for n, size in ((7, 400), (8, 1), (9, 0)):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=r.choice(["\n", "\r\n"])).writerows([["x", "y", "z"], *[[said() for _ in range(r.randint(1, 4))] for _ in range(size)]])
        (tmp_path / f"aid_{n}.csv").write_bytes(out.getvalue().encode())
    (tmp_path / "aid_10.csv").write_bytes(b"")
    want = set()
    for n in (7, 8, 9):
        lines = csv.reader(io.StringIO((tmp_path / f"aid_{n}.csv").read_bytes().decode(), newline=""))
        header = next(lines)
        want |= {(str(n), i, pos, c, v) for i, line in enumerate(lines) for pos, (c, v) in enumerate(zip(header, line))}
    for block in ("64", "1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if block == "64" else "4m")
        try:
            cells = readers.assay_cells(spark, f"{tmp_path}/*.csv")
            if block == "64":
                assert spark.read.option("lineSep", "\n").text(f"{tmp_path}/*.csv").select("_metadata.file_block_start").distinct().count() > 5
            got = [(c.AID, c.row_no, c.pos, c.column, c.value) for c in cells.collect()]
            assert set(got) == want and len(got) == len(want)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_helper_names_never_clash(spark):
    names = ["hit", "salt", "update_salt", "updated_0", "first", "last", "one", "part", "at", "base", "cid", "key_digest", "digest", "entry", "key", "got", "__part", "__at", "__hit", "row"]
    df = spark.createDataFrame([("1", *names), (None, *names)], "k string, " + ", ".join(f"`{n}` string" for n in names))
    told = lambda out: {tuple(r[n] for n in names) for r in out.collect()}
    for out in (
        merge.merge_by_key(df, spark.createDataFrame([("1", "v")], "k string, new string"), "k"),
        merge.insert_ignore(df, df, ["k"]),
        refine.first_per_group(df, "k", ["hit"]),
        refine.keep_last(df.withColumn("n", F.lit(1)), "k", "n"),
        refine.with_row_ids(df),
        features.with_order_index(df, "k"),
        enrich.enrich(df, "k", spark.createDataFrame([], "PubChem_CID string, status string, fetched_at string, error_message string"), spark.createDataFrame([("1", "x")], "PubChem_CID string, Brand string"))[0],
        links.with_status(df.withColumnRenamed("k", "CID"), spark.createDataFrame([("1",)], "CID string")),
    ):
        assert told(out) == {tuple(names)}, out.columns
    assert identity.data_identity(df, ["k", "digest"]).first().rows == 2
    for f in (lambda: refine.with_row_ids(df, "at"), lambda: features.with_order_index(df, "k", name="AT")):
        with pytest.raises(ValueError):
            f()


def test_identity_counts_copies(spark):
    one, two = spark.createDataFrame([("a",), ("b",)], "x string"), spark.createDataFrame([("a",), ("b",), ("b",)], "x string")
    ids = [identity.data_identity(d, ["x"]).first() for d in (one, two, two.repartition(5))]
    assert ids[0].identity != ids[1].identity and ids[1] == ids[2] and ids[1].rows == 3
