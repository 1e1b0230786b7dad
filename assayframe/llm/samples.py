"""Bounded samples of labelled documents for training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm.simhash import differing, fingerprint


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(fold_of(doc_id, folds) == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, per_class: int, max_bytes: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``per_class`` documents of each label outside the held-out fold.

    Those with the least hash of their id are taken, whole, of the texts of at
    most ``max_bytes`` bytes; so what a driver gathers from the sample is bounded
    by 2 x per_class x max_bytes. A document with both labels counts as 1, one whose id
    repeats is taken once, with the least of its texts.
    """
    known = labels.filter(F.col(target).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).alias("label")).filter("doc_id is not null")
    chosen = None
    for y in (0, 1):
        some = known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.filter(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def without_copies(texts: list[str], bits: int = 14) -> list[int]:
    """Indices of a bounded sample's texts, without those that nearly repeat an earlier one (SimHash of word pairs)."""
    fps = np.array([fingerprint(t.encode(), 2) for t in texts], np.int64)
    kept: list[int] = []
    for i, fp in enumerate(fps):
        if not (differing(fps[kept], fp) <= bits).any():
            kept.append(i)
    return kept
