"""Connected components of an edge list by alternating large-star and small-star steps.

Both steps are a min-aggregation by node and a join with its result, so no
node's neighbours are ever gathered in one row, and every round works on a
written table.  The number of rounds grows with the logarithm of the longest
chain, not with the size of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shelf import Shelf


def connected_components(spark: SparkSession, edges: DataFrame, shelf: Shelf, max_rounds: int = 60) -> DataFrame:
    """Components of ``edges`` (bigint columns ``a``, ``b``): rows (``node``, ``component``).

    ``component`` is the smallest node of the component.  Self-loops and
    repeated edges change nothing; rows with a null end are ignored; an empty
    edge list gives an empty result.
    """
    now = shelf.put(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).distinct()
        new = shelf.put(small)
        shelf.drop(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0
