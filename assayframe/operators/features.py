"""Analysis populations, bit features and the feature export."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions.text import clean, outcome_label
from assayframe.functions.names import fresh
from assayframe.operators.identity import data_identity
from assayframe.operators.refine import number_partitions
from assayframe.streaming.shared import written

POPULATION_STATUSES = ("selected", "no_eligible_activity")
SHOWN = 5


class PopulationError(ValueError):
    """The rows are no analysis population."""


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def violations(consolidated: DataFrame) -> DataFrame:
    """``rule, value, rows`` of what keeps the table from being a population: empty when it is one."""
    ok = F.col("Reference_Selection_Status").isin(*POPULATION_STATUSES)
    status = consolidated.filter(~F.coalesce(ok, F.lit(False))).groupBy(F.coalesce("Reference_Selection_Status", F.lit("")).alias("value")).agg(F.count("*").alias("rows"))
    outcome = consolidated.filter(outcome_label("Outcome").isNull()).groupBy(clean("Outcome").alias("value")).agg(F.count("*").alias("rows"))
    twice = duplicates(consolidated, "SMILES_Harmonized").withColumnRenamed("SMILES_Harmonized", "value")
    named = lambda d, rule: d.select(F.lit(rule).alias("rule"), "value", "rows")
    return named(status, "selection_status").unionByName(named(outcome, "outcome")).unionByName(named(twice, "duplicate_structure"))


def population(consolidated: DataFrame) -> DataFrame:
    """``id, outcome`` of a checked population; what is wrong is an error that shows the first few."""
    found = violations(consolidated).orderBy("rule", "value").limit(SHOWN).collect()
    if found:
        raise PopulationError("; ".join(f"{r.rule}: {r.value!r} ({r.rows} rows)" for r in found))
    return consolidated.select(F.col("SMILES_Harmonized").alias("id"), outcome_label("Outcome").alias("outcome"))


#: Rows that a range of the order holds, about.
RANGE_ROWS = 500_000


def with_order_index(df: DataFrame, key: str, range_rows: int = RANGE_ROWS, name: str = "row_index") -> DataFrame:
    """Rows numbered from 0 in the order of a unique key.

    Spark cuts the order into ranges by a sample of keys, as many as the row count asks for; the ranges are sorted
    and written once, so no task ever sees more than a range, and a task that is run again numbers no row anew.
    A table that has a column of that name already is an error.
    """
    if fresh(name, df) != name:
        raise ValueError(f"the table has a column {name} already")
    part, at, base = (fresh(n, df) for n in ("part", "at", "base"))
    ranges = max(1, -(-df.count() // range_rows))
    own = df.repartitionByRange(ranges, F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"))
    own = written(own.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "ordered")
    return number_partitions(own, part, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)), name, base, 0, df.columns)


#: Letters of texts that are gone through at a time, about: some 50 MB of numbers.
SLICE_LETTERS = 1 << 20
#: Binary digits of a letter's code point.
LETTER_BITS = 21


def _marks(texts: list[str], n: int, n_bits: int) -> np.ndarray:
    """``row * n_bits + bit`` of the texts' n-grams, each once and in order. A digest is made of each different gram, not in each place."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    many = max(letters.size - n + 1, 0)
    within = np.flatnonzero(rows[:many] == rows[n - 1 :])  # no gram reaches into the next text
    if not within.size:
        return within
    grams, held = letters[within], LETTER_BITS
    for k in range(1, n):
        if held + LETTER_BITS > 63:
            grams, held = pd.factorize(grams)[0], 31
        grams, held = grams << LETTER_BITS | letters[within + k], held + LETTER_BITS
    which = pd.factorize(grams)[0]
    place = np.empty(which.max() + 1, np.int64)
    place[which] = within
    told = letters[place[:, None] + np.arange(n)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    digests = (hashlib.md5(told[k : k + n].encode("utf-8", "surrogateescape"), usedforsecurity=False).digest() for k in range(0, len(told), n))
    bit = np.array([int.from_bytes(d[:4], "big") % n_bits for d in digests], np.int64)
    return _once(rows[within] * n_bits + bit[which])


def _once(marks: np.ndarray) -> np.ndarray:
    marks = np.sort(marks)
    return marks[np.diff(marks, prepend=-1) != 0]


def _ngram_bits(n: int, n_bits: int):
    def run(texts: pa.Array) -> pa.Array:
        out, group, size = [], [], 0

        def told() -> None:
            rows, bits = np.divmod(_marks(group, n, n_bits), n_bits)
            ends = np.searchsorted(rows, np.arange(len(group) + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(ends, bits.astype(np.int32)))

        for t in texts:
            t = (t.as_py() or b"").decode("utf-8", "surrogateescape")
            if group and size + len(t) > SLICE_LETTERS:
                told()
                group, size = [], 0
            if len(t) > SLICE_LETTERS:  # by itself, in pieces that share n - 1 letters
                pieces = [_marks([t[k : k + SLICE_LETTERS + n - 1]], n, n_bits) for k in range(0, len(t), SLICE_LETTERS)]
                out.append(pa.array([_once(np.concatenate(pieces)).astype(np.int32)], pa.list_(pa.int32())))
            else:
                group.append(t)
                size += len(t)
        if group:
            told()
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return run


def hashed_ngrams(df: DataFrame, text: str, n: int = 3, n_bits: int = 256) -> DataFrame:
    """``bits``: the hashed character n-grams of a text, a stand-in where no fingerprints are given. It knows no chemistry."""
    return df.withColumn("bits", F.arrow_udf(_ngram_bits(n, n_bits), "array<int>")(F.col(text).cast("binary")))


def export(fingerprints: DataFrame, identity: str | None = None, method: str = "") -> tuple[DataFrame, DataFrame]:
    """(``row_index, structure_id, id, outcome, y, bits``, one row of metadata); refuses rows that aren't of ``identity``."""
    now = data_identity(fingerprints.select("id", "outcome"), ["id", "outcome"], method).first()["identity"]
    if identity is not None and identity != now:
        raise PopulationError("the population changed since its identity was taken")
    y = F.when(F.col("outcome") == "Active", 1).when(F.col("outcome") == "Inactive", 0)
    rows = with_order_index(fingerprints, "id").select("row_index", F.sha2("id", 256).alias("structure_id"), "id", "outcome", y.alias("y"), "bits")
    meta = rows.agg(F.count("*").alias("rows"), F.sum("y").alias("active_rows")).withColumn("identity", F.lit(now)).withColumn("method", F.lit(method))
    return rows, meta
