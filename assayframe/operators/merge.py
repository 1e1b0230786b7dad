"""Merges as functions of (target, updates): the caller writes the result to a new place.

Inner keys are compared as they are; an update key that repeats counts by its last sequence, or
is reduced to one row, before the join, so that no target row is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions.digests import key_digest, once, whole_key
from assayframe.functions.names import fresh
from assayframe.operators.refine import keep_last


#: Rows with a null key match nothing; they are spread over so many pairs of key and salt.
NULL_SALTS = 1024


def _one_per(updates: DataFrame, key: str, sequence: str | None) -> DataFrame:
    if sequence:
        return keep_last(updates, key, sequence).drop(sequence)
    rest, one = [c for c in updates.columns if c != key], fresh("one", updates)
    if not rest:
        return updates.distinct()
    return updates.groupBy(key).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias(one)).select(key, *[F.col(f"`{one}`.`{c}`").alias(c) for c in rest])


def _met(target: DataFrame, key: str, updates: DataFrame, update_key: str, how: str) -> tuple[DataFrame, dict[str, Column], Column, Column]:
    """The one join of a merge: the joined rows, the updates' values by name, the update's key, and whether there was an update.

    It is on key and salt: 0 with a key, and else any number, so that null keys don't meet in one task and the target is evaluated once.
    """
    names = {c: fresh(f"updated_{k}", target, updates) for k, c in enumerate(updates.columns)}
    hit, salt, other = (fresh(n, target, updates) for n in ("hit", "salt", "update_salt"))
    zero = F.pmod(F.xxhash64(F.col(f"`{update_key}`")), F.lit(1)).alias(other)  # no literal: of one the optimizer makes a filter, and the join would be on the key alone
    own = updates.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.lit(True).alias(hit), zero)
    spread = target.withColumn(salt, F.when(F.col(f"`{key}`").isNotNull(), F.lit(0).cast("long")).otherwise(1 + F.monotonically_increasing_id() % NULL_SALTS))
    joined = spread.join(own, (spread[f"`{key}`"] == own[names[update_key]]) & (spread[salt] == own[other]), how)
    return joined, {c: F.col(f"`{n}`") for c, n in names.items()}, F.col(f"`{names[update_key]}`"), F.col(f"`{hit}`")


def merge_by_key(target: DataFrame, updates: DataFrame, key: str, update_key: str | None = None, columns: list[str] | None = None, sequence: str | None = None) -> DataFrame:
    """Target rows whose key is in updates get the listed columns overwritten, with null too; new columns are added.

    Without columns to write the target comes back as it is.
    """
    update_key = update_key or key
    columns = [c for c in (columns if columns is not None else updates.columns) if c not in (update_key, sequence)]
    if not columns:
        return target
    own = _one_per(updates.select(update_key, *[F.col(f"`{c}`") for c in columns], *([sequence] if sequence else [])), update_key, sequence)
    joined, new, _, hit = _met(target, key, own, update_key, "left")
    value = lambda c: F.when(hit, new[c]).otherwise(F.col(f"`{c}`") if c in target.columns else F.lit(None)).alias(c)
    return joined.select(*[value(c) if c in columns else F.col(f"`{c}`") for c in target.columns], *[value(c) for c in columns if c not in target.columns])


#: Bookkeeping columns of a property cache (fixed names).
CACHE_COLUMNS = ("PubChem_CID", "status", "fetched_at", "error_message")


def merge_cache(target: DataFrame, cache: DataFrame, key: str, only: DataFrame | None = None) -> DataFrame:
    """Successful cached columns into every target row of the same key text; ``only``, a one-column frame, restricts the keys."""
    good = cache.filter(F.col("status") == "success")
    if only is not None:
        good = good.join(only.select(F.col(only.columns[0]).alias("PubChem_CID")).distinct(), "PubChem_CID", "left_semi")
    return merge_by_key(target, good, key, "PubChem_CID", [c for c in cache.columns if c not in CACHE_COLUMNS])


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the new rows whose key it doesn't hold; of new rows with one key, the least. A key with a null never repeats.

    Keys meet as digests of 16 bytes; for a stored target that shouldn't be shuffled there is ``streaming.ledger``.
    """
    digest = fresh("key_digest", target, new)
    own = once(new, keys, digest)
    whole = target.filter(whole_key(keys)).select(*[F.col(f"`{k}`") for k in keys])
    added = own.join(whole.select(key_digest(whole, keys).alias(digest)), digest, "left_anti").drop(digest)
    return target.unionByName(added, allowMissingColumns=True)


def upsert_compounds(target: DataFrame, updates: DataFrame, sequence: str | None = None) -> DataFrame:
    """By CID: AIDs, Proteins and status are replaced, a name that isn't empty is kept, new compounds are added.

    Of updates that repeat a CID the last by ``sequence`` counts, with the first name that isn't empty; without
    a sequence the greatest row is the last and the least name the first.
    """
    fields = ["AIDs", "Proteins", "Activity_Enrichment_Status"]
    order = [F.col(sequence)] if sequence else []
    named = F.coalesce("Compound_Name", F.lit("")) != ""
    last, first = F.max(F.struct(*order, *fields)).alias("last"), F.min(F.when(named, F.struct(*order, "Compound_Name"))).alias("first")
    once = updates.filter("CID is not null").groupBy("CID").agg(last, first)
    u = once.select("CID", *[F.col(f"last.{c}").alias(c) for c in fields], F.coalesce("first.Compound_Name", F.lit("")).alias("Compound_Name"))
    joined, n, cid, hit = _met(target, "CID", u, "CID", "full_outer")
    new = lambda c: F.when(hit, n[c]).otherwise(F.col(c)).alias(c)
    name = F.when(hit, F.coalesce(F.nullif("Compound_Name", F.lit("")), n["Compound_Name"])).otherwise(F.col("Compound_Name"))
    written = {"CID": F.coalesce("CID", cid).alias("CID"), "Compound_Name": name.alias("Compound_Name"), **{c: new(c) for c in fields}}
    return joined.select(*[written.get(c, F.col(f"`{c}`")) for c in target.columns])


def upsert_cache(cache: DataFrame, results: DataFrame, fetched_at: str, sequence: str | None = None) -> DataFrame:
    """Results by PubChem_CID: values as text, status and time refreshed, columns of earlier results kept where not given anew.

    ``results`` has PubChem_CID, status, error_message and any result columns; a
    failed row changes status, time and message only. Of rows that repeat an id the last by ``sequence`` counts.
    """
    extra = [c for c in results.columns if c not in (*CACHE_COLUMNS, sequence)]
    own = _one_per(results, "PubChem_CID", sequence)
    u = own.select("PubChem_CID", "status", "error_message", *[F.col(f"`{c}`").cast("string").alias(c) for c in extra])
    joined, n, cid, hit = _met(cache, "PubChem_CID", u, "PubChem_CID", "full_outer")
    good = hit & (n["status"] == "success")
    old = lambda c: F.col(f"`{c}`") if c in cache.columns else F.lit(None).cast("string")
    columns = [*[c for c in cache.columns if c not in CACHE_COLUMNS], *[c for c in extra if c not in cache.columns]]
    return joined.select(
        F.coalesce("PubChem_CID", cid).alias("PubChem_CID"),
        F.when(hit, n["status"]).otherwise(old("status")).alias("status"),
        F.when(hit, F.lit(fetched_at)).otherwise(old("fetched_at")).alias("fetched_at"),
        F.when(hit, n["error_message"]).otherwise(old("error_message")).alias("error_message"),
        *[(F.when(good, n[c]).otherwise(old(c)) if c in extra else old(c)).alias(c) for c in columns],
    )
