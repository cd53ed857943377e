"""The neighbour graph of vectors, and a layout of it in two dimensions.

The graph is exact. Vectors are dealt to blocks of a bounded size, and each block is compared with each by products of
matrices, some rows at a time; a vector sends its ``k`` nearest of a block, and keeps the ``k`` nearest of all. Work grows with
the square of the vectors, but the memory of a task does not grow with them. Descent by neighbours of neighbours is not used:
vectors of many directions, none near another, have nearest neighbours that it misses.

The layout. Edges are weighted by distance in the scale of their vector's neighbourhood, made symmetric, and the two
leading eigenvectors of the normalised graph (next to the trivial one) are found by power iteration: joins of edges with
coordinates, and sums. That is where neighbour-graph projections commonly begin; attraction and repulsion of single
points are not simulated. Only sums leave the tasks: neither vectors nor edges are collected.

The same vectors, seed and k give the same graph and layout. Vectors without a direction are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import scratch
from .evaluation import SEED

NEIGHBOURS = 15
#: Vectors of a block, about, and distances that are held at once.
BLOCK, HELD = 1 << 16, 1 << 22
#: Blocks are not made smaller than this to occupy all cores.
LEAST_BLOCK = 1 << 10
#: Power steps, and how many are planned together.
STEPS, CHAINED = 24, 6
DIGITS = 6


def _units(embeddings: DataFrame) -> DataFrame:
    v = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    rows = embeddings.select("doc_id", v.alias("_v")).filter("size(_v) > 0").withColumn("_n", norm).filter("_n > 0 AND NOT isnan(_n)")
    return rows.select("doc_id", F.transform("_v", lambda x: (x / F.col("_n")).cast("float")).alias("unit"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _edge_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("u", id_type), T.StructField("v", id_type), T.StructField("d", T.DoubleType())])


def _best(d: np.ndarray, k: int) -> np.ndarray:
    """Which are the k least of each row, of equals the first ones."""
    if k >= d.shape[1]:
        return np.isfinite(d)
    last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    best = (d <= last) & np.isfinite(d)
    over = np.flatnonzero(best.sum(axis=1) > k)  # rows of more equals than are wanted
    if len(over):
        less, ties = d[over] < last[over], d[over] == last[over]
        best[over] = less | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= k - less.sum(axis=1, keepdims=True)))
    return best


def _between(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Edges from each vector of a block to the k nearest of another one. Rows of one id lie in one block."""
    left, right = left.sort_by("doc_id").combine_chunks(), right.sort_by("doc_id").combine_chunks()
    ids = pa.chunked_array([*left.column("doc_id").chunks, *right.column("doc_id").chunks]).combine_chunks()
    code = np.asarray(ids.dictionary_encode().indices.fill_null(-1))
    u, v = code[: len(left)], code[len(left) :]
    most = int(np.unique(v, return_counts=True)[1].max())
    a, b = (_matrix(x.column("unit").combine_chunks()) for x in (left, right))
    several = most > 1 or len(np.unique(u)) < len(u)
    step, found = max(1, HELD // len(b)), []
    for at in range(0, len(a), step):
        d = np.round(1 - a[at : at + step] @ b.T, DIGITS)
        if len(np.intersect1d(u[at : at + step], v)):
            d[u[at : at + step, None] == v] = np.inf
        i, j = np.nonzero(_best(d, k * most))
        found.append((at + i, j, d[i, j]))
    i, j, d = (np.concatenate(x) for x in zip(*found))
    if several:
        order = np.lexsort((d, v[j], u[i]))
        i, j, d = i[order], j[order], d[order]
        first = np.concatenate([[True], (u[i][1:] != u[i][:-1]) | (v[j][1:] != v[j][:-1])])[: len(i)]
        i, j, d = i[first], j[first], d[first]
    return pa.table([left.column("doc_id").take(pa.array(i)), right.column("doc_id").take(pa.array(j)), pa.array(d)], ["u", "v", "d"])


def neighbour_graph(embeddings: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(u, v, d): the ``k`` nearest of each vector by cosine distance (``doc_id``, ``vector``), of equals those of least id."""
    units = scratch(_units(embeddings), "units")
    dim = units.agg(F.mode(F.size("unit"), True).alias("dim")).first()["dim"] or 0
    units = units.filter(F.size("unit") == dim)
    n = units.count()
    # as many blocks as give each core a pair of them, if they are not too small for that
    wide = math.isqrt(units.sparkSession.sparkContext.defaultParallelism) + 1
    blocks = max(-(-n // block), min(wide, -(-n // LEAST_BLOCK)), 1)
    dealt = units.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.select(F.col("own").alias("a"), every.alias("b"), "doc_id", "unit")
    right = dealt.select(every.alias("a"), F.col("own").alias("b"), "doc_id", "unit")
    schema = _edge_schema(units.schema["doc_id"].dataType)

    def between(one: pa.Table, other: pa.Table) -> pa.Table:
        return _between(one, other, k) if one.num_rows and other.num_rows else to_arrow_schema(schema).empty_table()

    edges = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(between, schema)
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return scratch(edges.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "edges")


def _weighted(edges: DataFrame) -> DataFrame:
    """(u, v, a): the graph made symmetric and normalised, and each vector's degree."""
    by = Window.partitionBy("u")
    near, far = F.min("d").over(by), F.max("d").over(by)
    w = F.exp(-(F.col("d") - F.col("near")) / (F.col("far") - F.col("near") + 1e-6))
    one_way = edges.withColumns({"near": near, "far": far}).select("u", "v", w.alias("w"))
    both = one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    # w + w' - w w' of the two ways, or the one there is.
    return both.groupBy("u", "v").agg((1 - F.product(1 - F.col("w"))).alias("w"))


def spectral_layout(edges: DataFrame, seed: int = SEED, steps: int = STEPS) -> DataFrame:
    """(doc_id, x, y) for each vector of the graph, from -10 to 10."""
    links = scratch(_weighted(edges), "links")
    degrees = links.groupBy("u").agg(F.sum("w").alias("deg"))
    other = degrees.select(F.col("u").alias("v"), F.col("deg").alias("deg_v"))
    norm = F.col("w") / F.sqrt(F.col("deg") * F.col("deg_v"))
    links = scratch(links.join(degrees, "u").join(other, "v").select("u", "v", norm.alias("a")), "links")
    total = degrees.agg(F.sum("deg")).first()[0]
    if total is None:
        return edges.select(F.col("u").alias("doc_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def drawn(n: int) -> Column:
        return F.xxhash64("u", F.lit(seed), F.lit(n)) / F.lit(2.0**63)

    at = degrees.select("u", F.sqrt(F.col("deg") / total).alias("t"), drawn(1).alias("x"), drawn(2).alias("y"))
    for _ in range(-(-steps // CHAINED)):
        for _ in range(CHAINED):
            far = at.select(F.col("u").alias("v"), F.col("x").alias("xv"), F.col("y").alias("yv"))
            sums = links.join(far, "v").groupBy("u").agg(F.sum(F.col("a") * F.col("xv")).alias("xs"), F.sum(F.col("a") * F.col("yv")).alias("ys"))
            at = at.join(sums, "u").select("u", "t", ((F.col("x") + F.col("xs")) / 2).alias("x"), ((F.col("y") + F.col("ys")) / 2).alias("y"))
        at = scratch(at, "coordinates")
        pairs = {a + b: F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xt", "yt", "xx", "yy", "xy")}
        s = at.agg(*pairs.values()).first().asDict()
        # x without the trivial vector, then y without both; each of unit length.
        x_size = math.sqrt(max(s["xx"] - s["xt"] ** 2, 0)) or 1.0
        x = (F.col("x") - s["xt"] * F.col("t")) / x_size
        yx = (s["xy"] - s["xt"] * s["yt"]) / x_size
        y_size = math.sqrt(max(s["yy"] - s["yt"] ** 2 - yx**2, 0)) or 1.0
        at = at.select("u", "t", x.alias("x"), ((F.col("y") - s["yt"] * F.col("t") - yx * x) / y_size).alias("y"))
    placed = scratch(at.select(F.col("u").alias("doc_id"), (F.col("x") / F.col("t")).alias("x"), (F.col("y") / F.col("t")).alias("y")), "placed")
    most = placed.agg(F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y")).first()
    return placed.select("doc_id", *(F.round(F.col(c) * 10 / (most[c] or 1.0), 4).alias(c) for c in ("x", "y")))
