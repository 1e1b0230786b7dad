"""Incremental enrichment of keys from a property table or a user's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions.names import fresh
from assayframe.functions.text import compound_id, result_column_name
from assayframe.operators.features import with_order_index
from assayframe.streaming.shared import written

CHUNK = 500


def split_keys(df: DataFrame, column: str, cache: DataFrame) -> DataFrame:
    """``key, raw, state``: each distinct value of a column as ``cached``, ``pending`` or ``invalid``.

    Keys are normalised compound ids; an invalid one has a null key and its text in ``raw`` (null for null).
    """
    own = df.select(compound_id(F.col(f"`{column}`")).alias("key"), F.col(f"`{column}`").cast("string").alias("raw"))
    valid = own.filter("key is not null").select("key").distinct()
    good = cache.filter(F.col("status") == "success").select(F.col("PubChem_CID").alias("key")).distinct().withColumn("hit", F.lit(True))
    known = valid.join(good, "key", "left").select("key", F.lit(None).cast("string").alias("raw"), F.when(F.col("hit"), "cached").otherwise("pending").alias("state"))
    bad = own.filter("key is null").select("key", "raw").distinct().withColumn("state", F.lit("invalid"))
    return known.unionByName(bad)


def missing_results(requested: DataFrame, results: DataFrame, message: str = "no result returned") -> DataFrame:
    """Failed cache rows for the requested keys that no result has."""
    left = requested.select(F.col(requested.columns[0]).alias("PubChem_CID")).distinct().join(results.select("PubChem_CID"), "PubChem_CID", "left_anti")
    return left.select("PubChem_CID", F.lit("failed").alias("status"), F.lit(message).alias("error_message"))


def run_function(keys: DataFrame, runner: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], chunk: int = CHUNK, on_error: str = "mark", wave: int | None = None) -> DataFrame:
    """Results of a user's function, which gets one-column frames ``CID`` of at most ``chunk`` keys on the executors.

    It returns frames with PubChem_CID and columns of which ``columns`` are kept,
    as text. Keys that it doesn't return become failed rows, and so do those of a chunk that raises. After
    such a chunk the next ones are run (``on_error`` "mark"), or the run ends and all later ones are left pending, without
    a row ("stop", see ``run_waves``), or the job fails ("raise").
    """
    if on_error not in ("mark", "stop", "raise"):
        raise ValueError("on_error must be mark, stop or raise")
    if chunk <= 0:
        raise ValueError("chunk must be positive")
    own = keys.select(F.col(keys.columns[0]).cast("string").alias("CID")).distinct()
    if on_error == "stop":
        return run_waves(own, runner, columns, chunk, wave)
    return own.mapInPandas(_chunks(runner, columns, chunk, on_error == "raise"), _result_schema(columns)).drop("raised")


def _result_schema(columns: list[str], *more: str) -> str:
    return ", ".join(["PubChem_CID string", "status string", "error_message string", "raised boolean", *[f"`{result_column_name(c)}` string" for c in columns], *more])


def _results(asked: pd.Series, runner, names: list[str], fails: bool) -> pd.DataFrame:
    """A chunk's rows as text, one for each key that was asked for."""
    message, got, raised = "no result returned", pd.DataFrame({"PubChem_CID": []}), False
    try:
        got = runner(pd.DataFrame({"CID": asked}))
        got = got.rename(columns={c: result_column_name(c) for c in got.columns})
    except Exception as error:
        if fails:
            raise
        message, raised = str(error), True
    got = got.assign(PubChem_CID=got["PubChem_CID"].astype(str)).drop_duplicates("PubChem_CID", keep="last").set_index("PubChem_CID")
    told = got.astype(object).where(got.isna(), got.astype(str))  # as text before missing rows turn whole numbers into fractions
    out = told.reindex(asked.astype(str)).reindex(columns=names)
    hit = out.index.isin(got.index)
    out.insert(0, "status", ["success" if h else "failed" for h in hit])
    out.insert(1, "error_message", [None if h else message for h in hit])
    out = out.reset_index(names="PubChem_CID").astype(object).where(lambda x: x.notna(), None)
    out.insert(3, "raised", raised)
    return out


def _chunks(runner, columns: list[str], chunk: int, fails: bool):
    names = [result_column_name(c) for c in columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), chunk):
                yield _results(frame["CID"].iloc[at : at + chunk], runner, names, fails)

    return run


def run_waves(keys: DataFrame, runner, columns: list[str], chunk: int = CHUNK, wave: int | None = None) -> DataFrame:
    """The results of chunks in the order of their keys, up to and with the first that raises; later keys have no row.

    Chunks are numbered, and run in waves of ``wave`` (by default four for each task slot). A wave's results are written before the next one is
    planned. Chunks of the same wave after the first failing one may have run, but nothing of them is kept.
    """
    spark, names = keys.sparkSession, [result_column_name(c) for c in columns]
    wave = wave or 4 * spark.sparkContext.defaultParallelism
    numbered = with_order_index(keys, "CID", name="at")
    numbered = written(numbered.select("CID", F.floor(F.col("at") / chunk).alias("chunk")), "chunks")
    last = numbered.agg(F.max("chunk")).first()[0]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _results(frame["CID"], runner, names, False).assign(chunk=frame["chunk"].iloc[0])

    kept = []
    for start in range(0, last + 1 if last is not None else 0, wave):
        some = numbered.filter((F.col("chunk") >= start) & (F.col("chunk") < start + wave))
        done = written(some.groupBy("chunk").applyInPandas(run, _result_schema(columns, "chunk long")), "wave")
        failed = done.filter("raised").agg(F.min("chunk")).first()[0]
        kept.append(done if failed is None else done.filter(F.col("chunk") <= failed))
        if failed is not None:
            break
    out = kept[0] if kept else spark.createDataFrame([], _result_schema(columns, "chunk long"))
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.drop("raised", "chunk")


def enrich(df: DataFrame, column: str, cache: DataFrame, properties: DataFrame | None = None, runner=None, columns: list[str] | None = None, fetched_at: str = "", on_error: str = "mark") -> tuple[DataFrame, DataFrame]:
    """(table with property columns, refreshed cache): pending keys are looked up in ``properties`` or given to ``runner``.

    Run twice, the second run finds every key cached and changes nothing.
    """
    from assayframe.operators.merge import merge_cache, upsert_cache

    pending = split_keys(df, column, cache).filter("state = 'pending'").select("key")
    if properties is not None:
        found = properties.join(pending.withColumnRenamed("key", "PubChem_CID"), "PubChem_CID", "left_semi")
        found = found.withColumns({"status": F.lit("success"), "error_message": F.lit(None).cast("string")})
        results = found.unionByName(missing_results(pending, found), allowMissingColumns=True)
    else:
        results = run_function(pending, runner, columns or [], on_error=on_error)
    refreshed = upsert_cache(cache, results, fetched_at)
    cid = fresh("cid", df, refreshed)
    keyed = df.withColumn(cid, compound_id(F.col(f"`{column}`")))
    return merge_cache(keyed, refreshed, cid).drop(cid), refreshed


def progress(results: DataFrame) -> DataFrame:
    """One row of counters over result rows: total, success, failed."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    return results.agg(F.count("*").alias("total"), n("success").alias("success"), n("failed").alias("failed"))


def union_chunks(*chunks: DataFrame) -> DataFrame:
    """Chunks of one growing table; columns that a chunk lacks are null there."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out
