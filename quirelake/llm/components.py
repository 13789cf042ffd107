"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import cut_lineage, sweep


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, root long) for every node of the edges (a, b); root is the component's smallest node.

    Each round hangs neighbours onto smaller ones: minima are pre-aggregated before the shuffle and
    joined back, so a hub's edges can be split among tasks. Rounds grow with the logarithm of the
    longest path. Each round is cut off in the checkpoint folder. Null ends and self-loops link nothing;
    no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.filter("a is not null and b is not null and a <> b").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
        large = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v > u
        large = large.join(lowest, large.u == lowest.a).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        )
        edges = cut_lineage(small.select("e.*").filter("a <> b").distinct())
        del both, lowest, large, least, small
        sweep(edges.sparkSession)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
