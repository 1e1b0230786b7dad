"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum, combined before its shuffle, and an equi-join on
the node; no neighbourhood is ever gathered in one place. The number of rounds
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; root is the component's least node.

    Self-loops, repeated and reversed edges do no harm; an empty table gives an empty table.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.filter("a <> b").select(most.alias("a"), least.alias("b")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
        large = both.filter("b > a").join(roots, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = written(large.distinct(), "edges")
        roots = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(roots, "a")
        moved = small.filter("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        now = written(moved.unionByName(roots.withColumnRenamed("root", "b")).distinct(), "edges")
        before, state = state, _state(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
