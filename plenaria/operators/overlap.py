"""The k pairs of sets that share most members, without counting all pairs.

Sets come as rows (owner, item). A bound comes first: the k-th overlap among the largest sets of both sides is one that the
k-th best pair reaches at least. With it, sets of fewer items are left out, and of the others only a prefix is indexed:
items are ranked by how many owners have them, the rarest first, and two sets that share ``least`` items share one of the
first ``size - least + 1`` of each. Frequent items are last in that order, so those of a third of all owners seldom join;
where they do, their owners are split into blocks. Candidates are then counted exactly.

The largest sets need not be those that share most. So where the bound is low, higher overlaps are tried first, from half of
the largest set down by halves: if k pairs reach one of them, all of the best do, and frequent items haven't joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch

#: Largest sets of each side whose overlaps give the bound.
SEEDS = 64
#: Owners of one item on the left that one task meets with those on the right.
BLOCK = 1024


def counted(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, overlap) of ``pairs`` (a, b): items of both for which the left's ``lo`` is less than the right's ``hi``."""
    met = pairs.join(left, "a").join(right, ["b", "item"]).filter("lo < hi")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))


def _largest(rows: DataFrame, owner: str) -> DataFrame:
    sizes = rows.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(sizes.orderBy(F.desc("n"), owner).limit(SEEDS).select(owner)), owner)  # SEEDS rows


def bound(left: DataFrame, right: DataFrame, k: int, allowed: Column) -> int:
    """An overlap that k allowed pairs reach at least; 1 if the largest sets have fewer pairs."""
    met = _largest(left, "a").join(_largest(right, "b"), "item").filter(allowed & (F.col("lo") < F.col("hi")))
    best = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(k).select("n").collect()
    return best[-1]["n"] if len(best) == k else 1


def _prefix(rows: DataFrame, owner: str, owners: DataFrame, least: int) -> DataFrame:
    """(owner, item): what is indexed of the sets of ``least`` items or more."""
    sized = rows.join(rows.groupBy(owner).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least), owner).join(owners, "item")
    rarest = Window.partitionBy(owner).orderBy("owners", "item")
    return sized.withColumn("nth", F.row_number().over(rarest)).filter(F.col("nth") <= F.col("size") - least + 1).select(owner, "item")


def candidates(left: DataFrame, right: DataFrame, least: int, allowed: Column) -> DataFrame:
    """(a, b): every allowed pair that may share ``least`` items, and others."""
    owners = right.groupBy("item").agg(F.count(F.lit(1)).alias("owners"))
    a, b = _prefix(left, "a", owners, least), _prefix(right, "b", owners, least)
    blocks = a.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    a = a.join(blocks, "item").withColumn("block", F.pmod(F.xxhash64("a"), "blocks").cast("int")).drop("blocks")
    b = b.join(blocks, "item").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return a.join(b, ["item", "block"]).filter(allowed).select("a", "b").distinct()


def top_overlaps(left: DataFrame, right: DataFrame, k: int, allowed: Column, order: list) -> DataFrame:
    """(a, b, overlap): the ``k`` pairs of most shared items, ties by ``order``. ``left``: (a, item, lo), ``right``: (b, item,
    hi), an owner having each item once; an item counts for a pair if lo < hi. ``allowed``: which pairs count, of a and
    b. Only pairs that share something are there."""
    least = bound(left, right, k, allowed)
    sizes = [rows.groupBy(o).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0 for rows, o in ((left, "a"), (right, "b"))]
    reach = max(least, min(sizes) // 2)
    while True:
        found = counted(candidates(left, right, reach, allowed), left, right).filter(F.col("overlap") >= reach)
        best = scratch(found.orderBy(F.desc("overlap"), *order).limit(k), "overlaps")
        if reach == least or best.count() == k:
            return best
        reach = max(least, reach // 2)
