"""Compounds, assays and their links: expansion, fold, jobs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions.names import fresh
from assayframe.functions.text import clean
from assayframe.operators.activity import distinct_count, one_row

LINK = ["CID", "AID", "Protein"]


def expand(protein_aids: DataFrame, aid_cids: DataFrame) -> DataFrame:
    """Distinct ``CID, AID, Protein`` from ``(Protein, AID)`` and ``(AID, CID)``.

    Pairs that are distinct on both sides meet in distinct links, so links themselves aren't gathered. Texts of ids take far more memory than in a
    shuffle, by whose bytes Spark joins partitions; so their number is given.
    """
    parts = int(aid_cids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = aid_cids.select("AID", "CID").repartition(parts, "AID", "CID").distinct()
    return protein_aids.select("Protein", "AID").distinct().join(pairs, "AID").select(*LINK)


def joined_set(column: str):
    """Aggregate: a group's distinct non-blank texts, sorted, as one comma-separated text."""
    t = clean(column)
    return F.array_join(F.array_sort(F.collect_set(F.when(t != "", t))), ", ")


def fold(links: DataFrame, names: DataFrame | None = None, enriched: DataFrame | None = None) -> DataFrame:
    """One row per compound: its AIDs and proteins, its name (empty if unknown) and its enrichment status.

    ``names (CID, Title)``; ``enriched`` has the CIDs that got a record, all others are ``partial_or_failed``.
    """
    out = links.groupBy("CID").agg(joined_set("AID").alias("AIDs"), joined_set("Protein").alias("Proteins"))
    if names is None:
        out = out.withColumn("Compound_Name", F.lit(""))
    else:
        one = names.groupBy("CID").agg(F.max("Title").alias("Compound_Name"))
        out = out.join(one, "CID", "left").withColumn("Compound_Name", F.coalesce("Compound_Name", F.lit("")))
    return with_status(out, enriched) if enriched is not None else out


def with_status(compounds: DataFrame, enriched: DataFrame) -> DataFrame:
    name = fresh("got", compounds)
    got = enriched.select("CID").distinct().withColumn(name, F.lit(True))
    status = F.when(F.col(name), "enriched").otherwise("partial_or_failed")
    return compounds.join(got, "CID", "left").withColumn("Activity_Enrichment_Status", status).drop(name)


def jobs(links: DataFrame) -> DataFrame:
    """``Protein, AID, CIDs``: the distinct compounds of each enrichment job, sorted."""
    return links.groupBy("Protein", "AID").agg(F.array_sort(F.collect_set("CID")).alias("CIDs"))


def expected_only(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows whose compound its assay's job expects; a job that expects none lets all pass. Extra job columns are not read."""
    wanted = jobs.select("AID", F.explode("CIDs").alias("CID")).distinct()
    free = jobs.groupBy("AID").agg(F.max(F.size("CIDs")).alias("n")).filter("n <= 0").select("AID")
    return rows.join(wanted, ["AID", "CID"], "left_semi").unionByName(rows.join(free, "AID", "left_semi"))


def traceability(links: DataFrame) -> DataFrame:
    """One row: compounds, assays, links and the proteins. Distinct values are grouped, not expanded row by row."""
    by_cid = links.groupBy("CID").agg(F.count("*").alias("n"), F.collect_set(clean("Protein")).alias("p"))
    texts = F.array_sort(F.array_distinct(F.flatten(F.collect_set("p"))))
    whole = by_cid.agg(F.count("CID").alias("cid_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("link_count"), F.array_join(F.array_remove(texts, ""), ", ").alias("proteins"))
    return one_row(whole, distinct_count(links, "AID", "aid_count")).select("cid_count", "aid_count", "link_count", "proteins")


def status_histogram(compounds: DataFrame, column: str = "Activity_Enrichment_Status") -> DataFrame:
    return compounds.groupBy(F.coalesce(column, F.lit("")).alias("status")).agg(F.count("*").alias("compounds")).orderBy(F.desc("compounds"), "status")


def enrichment_scope(links: DataFrame) -> DataFrame:
    """One row: distinct (protein, assay) jobs, links and proteins."""
    jobs = links.groupBy("Protein", "AID").agg(F.count("*").alias("n"))
    proteins = jobs.groupBy("Protein").agg(F.count("AID").alias("jobs"), F.sum("n").alias("n"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return proteins.agg(count(F.when(F.col("Protein").isNotNull(), F.col("jobs"))).alias("job_count"), count("n").alias("link_count"), F.count("Protein").alias("protein_count"))


def protein_search(aids: DataFrame, cids: DataFrame, titles: DataFrame, activity: DataFrame, compounds: DataFrame, known_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole search over landed data: (compounds, links) with this run's records merged in.

    ``aids (Protein, AID)``, ``cids (AID, CID)``, ``titles (CID, Title)`` and the
    activity rows of this run; see ``sources.readers`` for where they come from.
    """
    from assayframe.operators.merge import insert_ignore, upsert_compounds

    found = expand(aids, cids)
    return upsert_compounds(compounds, fold(found, titles, activity)), insert_ignore(known_links, found, LINK)
