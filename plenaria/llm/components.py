"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread_join


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s"),
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Ties each larger neighbour of a node to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    tied = spread_join(both.filter("v > u"), scratch(least, "least"), "u", n)
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Ties each node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = scratch(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    tied = spread_join(down, least, "u", n)
    return (
        tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of an edge between two nodes.

    Nodes are of any ordered type. Loops, repeated edges and edges with a null end say nothing; no
    edges give no rows. Each round only sends edges keyed by one end and aggregates minima before
    the shuffle; the edges of a hub meet its minimum where they are. Minima and the result of each step are
    written to the shared scratch folder. Rounds end when a pair of steps changes nothing, after about log(n) of them.
    """
    kept = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    kept = scratch(kept, "edges")
    before = _signature(kept)
    while before[0]:
        # each step is written: a plan of both holds its parts many times over, and the driver holds the plan
        kept = scratch(_large_star(kept, before[0]), "edges")
        kept = scratch(_small_star(kept, before[0]), "edges")
        after = _signature(kept)
        if after == before:
            break
        before = after
    roots = kept.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.distinct())
