"""One query per operator family over the mapped driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import text
from assayframe.operators import activity, assay, collections, consolidate, enrich, features, identity, links, merge, neighbours, profile, refine
from assayframe.plans.views import view
from assayframe.sources import readers, writers
from assayframe.sources.readers import required
from assayframe.sources.snapshots import Snapshot
from assayframe.streaming import ingest
from assayframe.streaming.ledger import Ledger
from assayframe.streaming.shared import shared_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Bits of the fingerprints made from embeddings and from texts.
EMBEDDING_BITS, TEXT_BITS = 64, 4096
#: The structure population of one activity type.
KIND = "IC50"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _joined(df: DataFrame, *columns: str, sep: str = ",") -> DataFrame:
    return df.withColumns({c: F.array_join(c, sep) for c in columns})



@query
def activity_by_type_unit(spark, sf_dir):
    """The flagship: a filtered activity table per type and unit."""
    rows = activity.filtered(view(spark, sf_dir, "activity"), types=["IC50", "Ki"], outcomes=["Active", "Inactive"], value_range=(0.001, 90.0))
    um = text.micromolar(F.col("Activity_Value"), "Unit")
    return rows.groupBy("Activity_Type", "Unit").agg(F.count("*").alias("n_rows"), F.countDistinct("CID").alias("n_cids"), F.round(F.avg("Activity_Value"), 6).alias("mean_value"), F.round(F.exp(F.avg(F.log(um))), 6).alias("geometric_mean_um"))


@query
def activity_summary(spark, sf_dir):
    out = activity.summary(activity.filtered(view(spark, sf_dir, "activity"), types=["IC50", "EC50", ""], value_range=(None, 80.0)))
    return _joined(out, "activity_types", "outcomes", "units", "relations")


@query
def activity_value_stats(spark, sf_dir):
    return activity.value_stats(activity.filtered(view(spark, sf_dir, "activity"), units=["NANOMOLAR"]))


@query
def activity_cids(spark, sf_dir):
    return activity.cids(activity.filtered(view(spark, sf_dir, "activity"), outcomes=["Active"], value_range=(60.0, None)))


@query
def activity_rows_top(spark, sf_dir):
    return activity.ordered(activity.filtered(view(spark, sf_dir, "activity"), types=["Ki"]), 100).select("AID", "CID", "Result_Tag")


@query
def activity_subset_export(spark, sf_dir):
    return activity.filtered(view(spark, sf_dir, "activity"), units=["MILLIMOLAR", " "], value_range=(10.0, 20.0)).select(*activity.EXPORT_COLUMNS)


@query
def activity_distinct_values(spark, sf_dir):
    return activity.distinct_values(view(spark, sf_dir, "activity"), "Relation")


@query
def refine_project(spark, sf_dir):
    return refine.project_active(view(spark, sf_dir, "part"), ["p_partkey", "gone", "p_name"])


@query
def refine_where_text(spark, sf_dir):
    part = view(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    return refine.refine(part, ["p_partkey", "price"], where=refine.Condition("price", ">", "100"))


@query
def refine_where_numeric(spark, sf_dir):
    messy = view(spark, sf_dir, "messy_numbers")
    return refine.refine(messy, ["seq"], where=refine.Condition("raw", ">=", 40, mode="numeric"))


@query
def refine_group(spark, sf_dir):
    return refine.refine(view(spark, sf_dir, "part"), ["p_brand", "p_partkey", "p_name"], group_by="p_brand")


@query
def refine_order(spark, sf_dir):
    return refine.refine(view(spark, sf_dir, "supplier"), ["s_suppkey", "s_acctbal"], order_by="s_acctbal", ascending=False)


@query
def contains_filter(spark, sf_dir):
    return refine.contains(view(spark, sf_dir, "part"), "p_name", "RING").select("p_partkey", "p_name")


@query
def group_count_with_null(spark, sf_dir):
    part = view(spark, sf_dir, "part").withColumn("brand", F.nullif("p_brand", F.lit("Brand#2")))
    return refine.group_count(part, "brand")


@query
def pruned_scan(spark, sf_dir):
    return required(view(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query
def keep_last_result(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return refine.keep_last(orders, "o_custkey", "o_orderkey")


@query
def traceability_summary(spark, sf_dir):
    return links.traceability(view(spark, sf_dir, "links"))


@query
def enrichment_scope(spark, sf_dir):
    return links.enrichment_scope(view(spark, sf_dir, "links"))


@query
def status_histogram(spark, sf_dir):
    return links.status_histogram(merge.upsert_compounds(view(spark, sf_dir, "compounds"), view(spark, sf_dir, "compound_updates")))


@query
def compound_fold(spark, sf_dir):
    names = view(spark, sf_dir, "part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").cast("string").alias("CID"), F.col("p_name").alias("Title"))
    got = activity.filtered(view(spark, sf_dir, "activity"), types=["Ki"], value_range=(70.0, None))
    return links.fold(view(spark, sf_dir, "links"), names, got)


@query
def enrichment_jobs(spark, sf_dir):
    return _joined(links.jobs(view(spark, sf_dir, "links")), "CIDs")


@query
def link_expansion(spark, sf_dir):
    own = view(spark, sf_dir, "links")
    return links.expand(own.select("Protein", "AID").distinct(), own.select("AID", "CID").distinct())


@query
def expected_cid_restrict(spark, sf_dir):
    jobs = links.jobs(view(spark, sf_dir, "links")).filter("Protein <> 'P1'")  # P1's assays have no job, P2's no expectation
    jobs = jobs.withColumn("CIDs", F.when(F.col("Protein") == "P2", F.array().cast("array<string>")).otherwise(F.col("CIDs")))
    return links.expected_only(view(spark, sf_dir, "activity"), jobs).select("CID", "AID", "Result_Tag", "Order_Key")


def _search(spark, sf_dir):
    own = view(spark, sf_dir, "links")
    titles = view(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("CID"), F.col("p_name").alias("Title"))
    got = activity.filtered(view(spark, sf_dir, "activity"), types=["EC50"])
    known = own.filter("Protein < 'P3'")
    return links.protein_search(own.select("Protein", "AID").distinct(), own.select("AID", "CID").distinct(), titles, got, view(spark, sf_dir, "compounds"), known)


@query
def protein_search(spark, sf_dir):
    return _search(spark, sf_dir)[0]


@query
def protein_search_links(spark, sf_dir):
    return _search(spark, sf_dir)[1]


@query
def merge_by_key(spark, sf_dir):
    part = view(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    updates = view(spark, sf_dir, "lineitem").filter("l_linenumber = 2").groupBy(F.col("l_partkey").alias("k")).agg(F.nullif(F.max("l_returnflag"), F.lit("R")).alias("p_name"), F.max("l_tax").alias("tax"))
    return merge.merge_by_key(part, updates, "p_partkey", "k")


@query
def cache_merge(spark, sf_dir):
    rows = view(spark, sf_dir, "activity").select("CID", "AID", "Result_Tag", "Order_Key")
    only = rows.filter("cast(CID as bigint) % 2 = 1").select("CID")
    return merge.merge_cache(rows, view(spark, sf_dir, "properties"), "CID", only)


@query
def compound_upsert(spark, sf_dir):
    """Some compounds are updated twice: the later AIDs count, and the first name that isn't empty."""
    first = view(spark, sf_dir, "compound_updates").withColumn("Compound_Name", F.when(F.col("CID").like("%1"), "").otherwise(F.col("Compound_Name")))
    again = first.filter("CID like '%1' or CID like '%5'").withColumns({"AIDs": F.lit("newer"), "Compound_Name": F.lit("other")})
    updates = first.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2)))
    return merge.upsert_compounds(view(spark, sf_dir, "compounds"), updates, "seq")


@query
def snapshot_upsert(spark, sf_dir):
    """Compounds kept in buckets and updated in place twice with the same records."""
    table = Snapshot(spark, shared_path(spark, "compounds"), "CID")
    table.create(view(spark, sf_dir, "compounds"))
    for _ in range(2):
        table.update(view(spark, sf_dir, "compound_updates"), merge.upsert_compounds)
    return table.read()


@query
def insert_ignore_links(spark, sf_dir):
    own = view(spark, sf_dir, "links")
    return merge.insert_ignore(own.filter("cast(AID as bigint) % 2 = 0"), view(spark, sf_dir, "activity").select(*links.LINK), links.LINK)


def _keyed(spark, sf_dir):
    """Activity rows' keys; those in millimolar have no unit, so no key."""
    return view(spark, sf_dir, "activity").withColumn("Unit", F.nullif("Unit", F.lit("MILLIMOLAR"))).select(*ingest.KEY)


@query
def insert_ignore_activity(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    known = rows.filter("Result_Tag in ('1', '2', '7')").dropDuplicates(list(ingest.KEY))
    return ingest.new_rows(rows, known).groupBy("Activity_Type", "Unit").agg(F.count("*").alias("n"))


@query
def cache_upsert(spark, sf_dir):
    results = view(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(
        F.col("p_partkey").cast("string").alias("PubChem_CID"),
        F.when(F.col("p_size") % 2 == 0, "success").otherwise("failed").alias("status"),
        F.when(F.col("p_size") % 2 != 0, "no result").alias("error_message"),
        F.upper("p_brand").alias("Brand"),
        F.col("p_size").alias("Size"),
    )
    return merge.upsert_cache(view(spark, sf_dir, "properties"), results, "t1")


@query
def id_normalise(spark, sf_dir):
    return view(spark, sf_dir, "raw_ids").groupBy(text.compound_id("raw").alias("cid")).agg(F.count("*").alias("n"))


@query
def first_seen_ids(spark, sf_dir):
    return refine.first_seen(view(spark, sf_dir, "raw_ids"), text.compound_id("raw"), "seq")


@query
def cached_pending_invalid(spark, sf_dir):
    return enrich.split_keys(view(spark, sf_dir, "raw_ids"), "raw", view(spark, sf_dir, "properties"))


@query
def missing_results(spark, sf_dir):
    return enrich.missing_results(view(spark, sf_dir, "links").select("CID"), view(spark, sf_dir, "properties"))


@query
def keyed_enrichment(spark, sf_dir):
    cache = view(spark, sf_dir, "properties").filter("cast(PubChem_CID as bigint) % 2 = 0")
    source = view(spark, sf_dir, "properties").filter("status = 'success'").select("PubChem_CID", "Brand", "Kind")
    return enrich.enrich(view(spark, sf_dir, "raw_ids"), "raw", cache, source, fetched_at="t1")[0]


@query
def keyed_enrichment_function(spark, sf_dir):
    """The same with a user's function on the executors, which knows no even keys."""

    def runner(frame):
        odd = frame[frame["CID"].astype("int64") % 2 == 1]
        return odd.rename(columns={"CID": "PubChem_CID"}).assign(**{"Double:": odd["CID"].astype("int64") * 2})

    keys = enrich.split_keys(view(spark, sf_dir, "raw_ids"), "raw", view(spark, sf_dir, "properties")).filter("state = 'pending'").select("key")
    return enrich.run_function(keys, runner, ["Double:"])


@query
def enrichment_progress(spark, sf_dir):
    return enrich.progress(view(spark, sf_dir, "properties"))


def _cells(spark, sf_dir):
    return view(spark, sf_dir, "cells").withColumnRenamed("column_name", "column")


@query
def assay_extract(spark, sf_dir):
    return assay.extract(_cells(spark, sf_dir)).drop("Activity_Status")


@query
def assay_failure_class(spark, sf_dir):
    return assay.failures(_cells(spark, sf_dir))


@query
def assay_descriptions(spark, sf_dir):
    return _joined(assay.descriptions(_cells(spark, sf_dir)), "types", "values", sep="; ")


def _source(spark, sf_dir):
    return activity.filtered(view(spark, sf_dir, "activity"), types=[KIND])


@query
def consolidated(spark, sf_dir):
    out = consolidate.consolidate(_source(spark, sf_dir), KIND).withColumn("Geometric_Mean_Activity_uM", F.round("Geometric_Mean_Activity_uM", 6))
    return _joined(out.drop("SMILES_Harmonization_Status"), "Source_CIDs", "Source_AIDs")


@query
def consolidate_metrics(spark, sf_dir):
    return consolidate.Consolidation.of(_source(spark, sf_dir), KIND).metrics()


@query
def consolidate_invariants(spark, sf_dir):
    return consolidate.invariants(consolidate.Consolidation.of(_source(spark, sf_dir), KIND).metrics())


@query
def excluded_conflicts(spark, sf_dir):
    return _joined(consolidate.conflicts(_source(spark, sf_dir)), "Source_CIDs", "Source_AIDs", "Outcomes")


@query
def excluded_non_binary(spark, sf_dir):
    return _joined(consolidate.non_binary(_source(spark, sf_dir)), "Source_CIDs", "Source_AIDs", "Outcomes")


@query
def excluded_unusable(spark, sf_dir):
    return consolidate.unusable(_source(spark, sf_dir))


@query
def population_violations(spark, sf_dir):
    """The unconsolidated rows are no population: what is wrong with them."""
    raw = _source(spark, sf_dir).withColumn("Reference_Selection_Status", F.when(F.col("Activity_Value") > 0, "selected").otherwise("raw"))
    return features.violations(raw)


def _fingerprints(spark, sf_dir):
    on = F.filter(F.sequence(F.lit(0), F.lit(EMBEDDING_BITS - 1)), lambda k: F.get("embedding", k) > 0)
    return view(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.when(F.col("label") < 5, "Active").otherwise("Inactive").alias("outcome"), on.alias("bits"))


@query
def nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(_fingerprints(spark, sf_dir), EMBEDDING_BITS).withColumn("similarity", F.round("similarity", 9))


@query
def class_concordance(spark, sf_dir):
    return neighbours.class_concordance(neighbours.nearest(_fingerprints(spark, sf_dir), EMBEDDING_BITS)).withColumn("concordance", F.round("concordance", 9))


@query
def modelability_index(spark, sf_dir):
    return neighbours.modelability_index(neighbours.nearest(_fingerprints(spark, sf_dir), EMBEDDING_BITS)).withColumn("modelability_index", F.round("modelability_index", 9))


@query
def nearest_neighbours_lsh(spark, sf_dir):
    return neighbours.approximate_all(_fingerprints(spark, sf_dir), EMBEDDING_BITS, least_similarity=0.5)


@query
def ml_export(spark, sf_dir):
    rows, _ = features.export(_fingerprints(spark, sf_dir), method="sign bits")
    return _joined(rows.withColumn("bits", F.transform("bits", lambda b: b.cast("string"))), "bits")


@query
def text_features(spark, sf_dir):
    """Hashed n-grams of all documents: how many bits each has, and their sum."""
    made = features.hashed_ngrams(view(spark, sf_dir, "documents").select("doc_id", "text"), "text", n_bits=TEXT_BITS)
    return made.select("doc_id", F.size("bits").cast("long").alias("n_bits"), F.aggregate("bits", F.lit(0).cast("long"), lambda a, b: a + b).alias("bit_sum"))


@query
def data_identity(spark, sf_dir):
    return identity.data_identity(view(spark, sf_dir, "links"), list(links.LINK), "v1")


@query
def reuse_by_identity(spark, sf_dir):
    """Of the proteins' link sets those whose analysis is already stored."""
    own = view(spark, sf_dir, "links")
    requests = own.groupBy("Protein").agg(F.md5(F.array_join(F.array_sort(F.collect_set("AID")), ",").cast("binary")).alias("identity"))
    results = requests.select("identity", F.when(F.col("Protein") < "P3", "completed").otherwise("running").alias("status"), F.lit("c1").alias("contract"))
    return identity.reusable(requests, results, "c1")


@query
def dataset_profile(spark, sf_dir):
    tables = {n: view(spark, sf_dir, n) for n in TABLES}
    known = spark.createDataFrame([("part", "base", "upload")], "table string, role string, origin string")
    out = profile.profile(tables | {"temp_part": tables["part"]}, known).drop("column_types")
    return _joined(out, "column_names", "status")


@query
def row_expectations(spark, sf_dir):
    counts = profile.row_counts({n: view(spark, sf_dir, n) for n in TABLES})
    expected = counts.filter("table <> 'nation'").withColumn("rows", F.when(F.col("table") == "region", 7).when(F.col("table") == "part", F.lit(None)).otherwise(F.col("rows")))
    gone = spark.createDataFrame([("gone", 1)], "table string, rows long")
    return profile.check_expected(counts, expected.unionByName(gone))


@query
def database_summary(spark, sf_dir):
    return profile.database_summary(spark, {n: view(spark, sf_dir, n) for n in TABLES})


@query
def castability(spark, sf_dir):
    messy = view(spark, sf_dir, "messy_numbers")
    return messy.agg(*[F.sum(text.castable("raw", k).cast("long")).alias(k.lower()) for k in ("TEXT", "INTEGER", "REAL")])


@query
def incompatible_values(spark, sf_dir):
    return profile.incompatible_values(view(spark, sf_dir, "messy_numbers"), "raw", "REAL", limit=None)


@query
def safe_type_change(spark, sf_dir):
    fit = view(spark, sf_dir, "messy_numbers").filter(text.castable("raw", "REAL"))
    return profile.change_type(fit, "raw", "REAL", identifiers=("seq",))


@query
def numeric_values(spark, sf_dir):
    return view(spark, sf_dir, "messy_numbers").select("seq", text.number("raw").alias("value"))


@query
def collection_filter(spark, sf_dir):
    return collections.in_collections(view(spark, sf_dir, "collections"), "collections", ["fr", "good"]).select("doc_id")


@query
def collection_filter_all(spark, sf_dir):
    return collections.in_collections(view(spark, sf_dir, "collections"), "collections", ["fr", "good"], "AND").select("doc_id")


@query
def collection_report(spark, sf_dir):
    return collections.curate(view(spark, sf_dir, "collections"), "structure", "doc_id", "collections", ["de", "bad"], valid=F.col("n_chars") > 500)[2]


@query
def json_props(spark, sf_dir):
    props = F.from_json("props", "k long")
    return view(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(props["k"]).alias("k_sum"), F.count(props["k"]).alias("k_count"))


@query
def incremental_ingest(spark, sf_dir):
    """The activity table streamed in from files, with half of it known before and the first batch replayed: every key once.

    Rows without a unit have no key: those of the known half and those of the stream are all kept, and the replay adds none.
    """
    rows = _keyed(spark, sf_dir)
    files, checkpoint = shared_path(spark, "activity-files"), shared_path(spark, "activity-stream")
    ledger = ingest.activity_ledger(spark, shared_path(spark, "activity-table"))
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(parts, *ingest.KEY).write.parquet(files)
    known = rows.filter("Result_Tag in ('1', '2', '3', '7')")
    ingest.ingest(known, ledger, "known")
    ingest.stream(ingest.activity_stream(spark, files, rows.schema, -(-parts // 2)), ledger, checkpoint).awaitTermination()
    ingest.ingest(known, ledger, "known")
    return ledger.rows().groupBy("Activity_Type", "Outcome", "Unit").agg(F.count("*").alias("n"))


@query
def stored_links(spark, sf_dir):
    """Links inserted into a stored table in two batches: those of even assays, then all."""
    own = view(spark, sf_dir, "activity").select(*links.LINK)
    ledger = Ledger(spark, shared_path(spark, "links-table"), tuple(links.LINK))
    ledger.add(own.filter("cast(AID as bigint) % 2 = 0"), "even")
    ledger.add(own, "all")
    return ledger.rows()


def _exported(spark, sf_dir):
    """Part's names and types as CSV, below a header that has to be normalised."""
    path = shared_path(spark, "csv-export")
    writers.export_csv(view(spark, sf_dir, "part").select(F.col("p_partkey").alias(" part key "), "p_name", "p_type"), path)
    return path


@query
def csv_load(spark, sf_dir):
    return readers.csv_table(spark, _exported(spark, sf_dir)).drop("primary_id")


@query
def csv_row_ids(spark, sf_dir):
    path = shared_path(spark, "csv-export")
    writers.export_csv(view(spark, sf_dir, "part").select(F.col("p_partkey").alias(" part key "), "p_name"), path, order_by=[" part key "])
    return readers.csv_table(spark, path).select("primary_id", "part_key")


@query
def subgroup_export(spark, sf_dir):
    path = shared_path(spark, "subgroup")
    writers.export_subgroup(view(spark, sf_dir, "part"), path, "p_name", "RING", ["p_partkey", "p_name"])
    return spark.read.option("header", True).csv(path)


@query
def activity_export(spark, sf_dir):
    path = shared_path(spark, "activity-export")
    activity.export(activity.filtered(view(spark, sf_dir, "activity"), types=["Ki"]), path)
    return readers.csv_table(spark, path, "line").select("line", "AID", "CID", "Result_Tag")


@query
def derived_table(spark, sf_dir):
    part = view(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), F.when(F.col("p_size") < 10, float("nan")).otherwise(F.col("p_size").cast("double")).alias("share"))
    return writers.derive_table(part, f"derived_{uuid.uuid4().hex}", {"size": "INTEGER"})


@query
def strict_projection(spark, sf_dir):
    return refine.project(view(spark, sf_dir, "part"), ["p_name", "p_partkey"])


@query
def preview_rows(spark, sf_dir):
    return refine.preview(view(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey"), 7)


@query
def aid_cid_source(spark, sf_dir):
    """The links as landed JSON batches; a later batch has the last word on some assays."""
    own = view(spark, sf_dir, "links").groupBy("AID").agg(F.collect_set(F.col("CID").cast("bigint")).alias("CID"))
    entries = lambda df: df.groupBy(F.substring("AID", 1, 2)).agg(F.collect_list(F.struct(F.col("AID").cast("bigint").alias("AID"), "CID")).alias("i"))
    text_ = F.to_json(F.struct(F.struct(F.col("i").alias("Information")).alias("InformationList"))).alias("body")
    body = lambda df, no: entries(df).select(F.lit(no).alias("batch_no"), F.transform("i", lambda x: x["AID"]).alias("asked"), text_)
    first = own.withColumn("CID", F.when(F.col("AID").like("%3"), F.array(F.lit(0).cast("bigint"))).otherwise(F.col("CID")))
    return readers.aid_cids(body(first, 1).unionByName(body(own.filter("AID like '%3'"), 2)))


@query
def title_source(spark, sf_dir):
    """Part names as landed JSON titles, with blanks around them, and upper-cased ones in a later batch."""
    part = view(spark, sf_dir, "part")
    props = lambda df, title: df.groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_partkey").cast("bigint").alias("CID"), title.alias("Title"))).alias("p"))
    body = lambda df, no: df.select(F.lit(no).alias("batch_no"), F.to_json(F.struct(F.struct(F.col("p").alias("Properties")).alias("PropertyTable"))).alias("body"))
    first, later = props(part, F.concat(F.lit("  "), "p_name")), props(part.filter("p_size > 25"), F.upper("p_name"))
    return readers.titles(body(first, 1).unionByName(body(later, 2)))


@query
def taxonomy_source(spark, sf_dir):
    path = shared_path(spark, "taxonomy")
    own = view(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.lit("brand").alias("category"), F.collect_set("p_type").alias("entries"))
    own.write.option("maxRecordsPerFile", 1).json(path)
    return readers.taxonomy(spark, path)


@query
def assay_files(spark, sf_dir):
    """The cells as one ragged CSV per assay, with line breaks in quotes, and back."""
    path = shared_path(spark, "assay-files")
    last = _cells(spark, sf_dir).groupBy("AID", "row_no", "column").agg(F.max_by("value", "pos").alias("value"))
    values = F.map_from_entries(F.collect_list(F.struct("column", F.when(F.col("value") == "n/a", "n/a,\n\"none\"").otherwise(F.col("value")))))
    lines = last.groupBy("AID", "row_no").agg(values.alias("values"))
    header = last.groupBy("AID").agg(F.array_sort(F.collect_set("column")).alias("header"))
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.array_join(F.transform("header", lambda c: quoted(F.col("values")[c])), ",")
    files = writers.write_files(lines.join(header, "AID"), path, F.format_string("AID=%s.csv", "AID"), F.array_join(F.transform("header", quoted), ","), line, F.col("row_no"))
    return readers.assay_cells(spark, files, r"AID=(\d+)").withColumn("value", F.replace("value", F.lit(',\n"none"'), F.lit("")))


@query
def protein_aid_source(spark, sf_dir):
    """The proteins' assays as landed JSON, one document each."""
    path = shared_path(spark, "protein-aids")
    own = view(spark, sf_dir, "links").groupBy("Protein").agg(F.to_json(F.struct(F.struct(F.collect_set(F.col("AID").cast("bigint")).alias("AID")).alias("IdentifierList"))).alias("body"))
    own.write.partitionBy("Protein").text(path)
    return readers.protein_aids(spark, path, r"Protein=([^/]+)")


@query
def neighbour_report(spark, sf_dir):
    path = shared_path(spark, "neighbours")
    neighbours.write_report(neighbours.nearest(_fingerprints(spark, sf_dir), EMBEDDING_BITS), path)
    return spark.read.option("header", True).csv(path).withColumn("similarity", F.round(F.col("similarity").cast("double"), 6))


@query
def chunk_union(spark, sf_dir):
    """Chunks of one growing property table: each has columns that others lack."""
    own = view(spark, sf_dir, "properties")
    good, bad = own.filter("status = 'success'"), own.filter("status <> 'success'")
    return enrich.union_chunks(good.select("PubChem_CID", "status", "Brand"), bad.select("PubChem_CID", "status", "error_message"), good.select("PubChem_CID", F.lit("again").alias("status"), "Kind"))


@query
def metrics_json(spark, sf_dir):
    """The counters as JSON text and back; one text lacks a counter, and gives nulls."""
    told = consolidate.Consolidation.of(_source(spark, sf_dir), KIND).metrics()
    names = sorted(told.columns)
    text_ = consolidate.metrics_to_json(told)
    both = text_.unionByName(text_.select(F.regexp_replace("metrics_json", names[0], "gone").alias("metrics_json")))
    return consolidate.metrics_from_json(both, "metrics_json", names)


@query
def json_lists(spark, sf_dir):
    out = consolidate.with_json_lists(consolidate.consolidate(_source(spark, sf_dir)))
    return out.select("SMILES_Harmonized", "Source_CIDs", "Source_AIDs")


@query
def stored_features(spark, sf_dir):
    """Computed once and stored, restored by source and identity, and computed anew where what is stored is damaged."""
    own = view(spark, sf_dir, "links")
    columns, path = list(links.LINK), shared_path(spark, "features")
    _, manifest = identity.restore_or_compute(None, "links", "v1", lambda: own, path, columns)
    again, _ = identity.restore_or_compute(manifest, "links", "v1", lambda: own.limit(0), shared_path(spark, "features"), columns)
    damaged = manifest.withColumn("path", F.lit(shared_path(spark, "features")))
    again.limit(1).write.parquet(damaged.first()["path"])  # not what was stored: computed anew
    return identity.restore_or_compute(damaged, "links", "v1", lambda: again, shared_path(spark, "features"), columns)[0]


@query
def refusals(spark, sf_dir):
    """What must be refused, beside what must not: a changed source, damaged features, an existing table."""
    own, columns = written(view(spark, sf_dir, "links"), "links"), list(links.LINK)  # looked at many times, made once
    requested = identity.data_identity(own, columns, "v1").first()["identity"]
    path, table = shared_path(spark, "features"), f"derived_{uuid.uuid4().hex}"
    _, manifest = identity.restore_or_compute(None, "links", "v1", lambda: own, path, columns)
    damaged = manifest.withColumn("path", F.lit(shared_path(spark, "features")))
    own.filter("Protein <> 'P1'").write.parquet(damaged.first()["path"])
    own.limit(0).write.saveAsTable(table)
    cases = {
        "unchanged source": lambda: identity.check_unchanged(own, columns, requested, "v1"),
        "changed source": lambda: identity.check_unchanged(own.filter("Protein <> 'P1'"), columns, requested, "v1"),
        "another method": lambda: identity.check_unchanged(own, columns, requested, "v2"),
        "stored features": lambda: identity.read_stored(manifest, "links", "v1", columns),
        "damaged features": lambda: identity.read_stored(damaged, "links", "v1", columns),
        "unknown features": lambda: identity.read_stored(manifest, "links", "v2", columns),
        "existing table": lambda: writers.derive_table(own, table),
    }

    def refused(f) -> bool:
        try:
            f()
        except (ValueError, LookupError):
            return True
        return False

    told = [(name, refused(f)) for name, f in cases.items()]
    spark.sql(f"DROP TABLE {table}")
    n = own.count()
    return spark.createDataFrame([(n, *t) for t in told], "links long, case string, refused boolean")
