"""Exact nearest neighbours through an inverted file.

Vectors are dealt to the cells of a k-means over unit vectors and stored in a table partitioned by cell, beside a table of
cells: centre, radius, number of rows. A query reads the nearest cells until they hold k rows; the k-th score bounds
what is left to find, and a cell whose centre is so far off that none of its rows can reach it, by the triangle
inequality, isn't read at all. So the result is that of a full scan whatever the cells are, ties included.

Centres may be fitted to a sample (``SAMPLE`` rows), since only how much can be skipped depends on them; every row is
indexed. There are at most ``MOST_CELLS`` cells, so what the driver and the tasks get of them is bounded by that times the
dimension. Vectors without a direction (null, of another dimension, all zero) have a cell of their own, which is read last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import cosine, rounded
from . import vectors
from .evaluation import SEED, seeded_sample

SAMPLE = 100_000
MOST_CELLS = 1024
#: Rows of the sample for each cell, so that fitting costs a number of products that grows with the rows.
SAMPLE_PER_CELL = 100
#: Scores that differ by less count as equal where cells are skipped.
SLACK = 2e-6
#: Digits of a score by which neighbours are ordered, so that the order of additions decides no tie.
DIGITS = 6
#: About so many rows and queries meet in one task's group.
ROW_BLOCK, QUERY_BLOCK = 4096, 1024
NOWHERE = -1

_CELLS = "cell int, n long, radius double, centre array<double>"


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a direction, their unit vectors)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not dim:
        return np.zeros(len(column), bool), np.zeros((0, 0))
    good = np.array([v is not None and len(v) == dim and None not in v for v in column.to_pylist()], bool)
    flat = np.array(column.filter(pa.array(good)).flatten().to_pylist(), np.float64).reshape(-1, dim)
    norms = np.sqrt((flat * flat).sum(axis=1))
    some = np.isfinite(norms) & (norms > 0)
    good[np.flatnonzero(good)[~some]] = False
    return good, flat[some] / norms[some, None]


def _tops(units: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The most that a row of each cell can score with each query."""
    away = np.sqrt(np.maximum((units * units).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * units @ centres.T, 0))
    near = np.maximum(away - radii[None], 0)
    return 1 - near * near / 2


@dataclass
class Report:
    """What a search read."""

    cells: int
    cells_read: int
    rows: int
    rows_read: int

    @property
    def share(self) -> float:
        return self.rows_read / self.rows if self.rows else 0.0


def build(embeddings: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Write the index of ``embeddings`` (doc_id, vector and other columns) to the folder ``path``. cells: how many, by
    default the square root of the number of rows, at most ``MOST_CELLS``."""
    spark = embeddings.sparkSession
    named = embeddings.withColumn("vector", F.col("vector").cast("array<double>"))
    directed = named.filter("size(vector) > 0 AND exists(vector, x -> x <> 0) AND NOT exists(vector, x -> x IS NULL OR isnan(x))")
    size = directed.agg(F.count(F.lit(1)).alias("n"), F.mode(F.size("vector"), True).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    centres = np.zeros((0, dim))
    if n:
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        unit = directed.filter(F.size("vector") == dim).select("doc_id", F.transform("vector", lambda x: x / norm).alias("unit"))
        k = min(MOST_CELLS, cells or max(1, round(n**0.5)))
        # A limit leaves one partition: the sample is dealt out again.
        features = seeded_sample(unit, min(sample, SAMPLE_PER_CELL * k)).repartition(spark.sparkContext.defaultParallelism, "doc_id").select(array_to_vector("unit").alias("features")).cache()
        centres = np.array(KMeans(k=k, seed=SEED, maxIter=20).fit(features).clusterCenters()) if k > 1 else unit.limit(1).toPandas()["unit"].tolist()
        centres = np.asarray(centres, np.float64)
        features.unpersist()
    columns = embeddings.columns

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, units = _units(batch.column("vector"), dim)
            cell, away = np.full(len(good), NOWHERE, np.int32), np.zeros(len(good))
            if len(units):
                distance = 1 - _tops(units, centres, np.zeros(len(centres)))  # half of the square
                cell[good] = distance.argmin(1)
                away[good] = np.sqrt(np.maximum(2 * distance.min(1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(cell)], [*batch.schema.names, "away", "cell"])

    schema = T.StructType([*embeddings.schema.fields, T.StructField("away", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    rows = embeddings.mapInArrow(dealt, schema)
    # Rebalanced: small cells share a task, a cell of many rows is split over tasks and files.
    spark.sql("SELECT /*+ REBALANCE(cell) */ * FROM {rows}", rows=rows).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    held = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    at = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    held.join(F.broadcast(at), "cell", "left").select("cell", "n", "radius", "centre").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # at most MOST_CELLS + 1 rows
    return VectorIndex(spark, path, [*columns], schema)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, columns: list[str], schema: T.StructType):
        self.spark, self.path, self.columns = spark, path, columns
        self.rows = spark.read.schema(schema).parquet(f"{path}/rows")
        held = spark.read.schema(_CELLS).parquet(f"{path}/cells").collect()
        self.size = sum(r["n"] for r in held)
        self.nowhere = sum(r["n"] for r in held if r["cell"] == NOWHERE)
        held = sorted((r for r in held if r["cell"] != NOWHERE), key=lambda r: r["cell"])
        self.cells = np.array([r["cell"] for r in held], np.int32)
        self.n = np.array([r["n"] for r in held], np.int64)
        self.radii = np.array([r["radius"] for r in held])
        self.centres = np.array([r["centre"] for r in held]).reshape(len(held), len(held[0]["centre"]) if held else 0)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        schema = spark.read.parquet(f"{path}/rows").schema
        return cls(spark, path, [c for c in schema.names if c not in ("away", "cell")], schema)

    def search(self, query: list[float], top_k: int = 10, filters: dict | None = None) -> tuple[DataFrame, Report]:
        """What ``vectors.search`` finds among all rows, and what was read for it."""
        unit = np.asarray(query, np.float64)
        norm = np.sqrt((unit * unit).sum())
        total = len(self.cells) + bool(self.nowhere)
        if not len(self.cells) or unit.size != self.centres.shape[1] or not norm > 0:
            return vectors.search(self.rows.select(*self.columns), query, top_k, filters), Report(total, total, self.size, self.size)
        tops = _tops(unit[None] / norm, self.centres, self.radii)[0]
        order = np.argsort(-tops, kind="stable")
        anchor = F.array(*(F.lit(float(x)) for x in query))
        take = int(np.searchsorted(np.cumsum(self.n[order]), top_k) + 1)
        while True:
            taken = order[:take]
            rows = self.rows.filter(F.col("cell").isin([int(c) for c in self.cells[taken]]))
            for name, value in (filters or {}).items():
                rows = rows.filter(F.col(name) == value)
            found = rows.select(cosine(F.col("vector"), anchor).alias("s")).orderBy(F.desc("s")).limit(top_k).collect()
            if len(found) == top_k or take >= len(order):
                break
            take *= 2  # the filters left too few
        if len(found) == top_k:
            needed = np.flatnonzero(tops >= found[-1]["s"] - SLACK)
            read = [int(c) for c in self.cells[needed]]
        else:
            read = [int(c) for c in self.cells] + [NOWHERE]
        best = vectors.search(self.rows.filter(F.col("cell").isin(read)).select(*self.columns), query, top_k, filters)
        both = set(read) | {int(c) for c in self.cells[taken]}
        held = dict(zip(self.cells.tolist(), self.n.tolist())) | {NOWHERE: self.nowhere}
        return best, Report(total, len(both), self.size, sum(held[c] for c in both))

    def join(self, queries: DataFrame, k: int = 10, exclude_self: bool = True) -> DataFrame:
        """(query_id, doc_id, score, rank): the k nearest rows of each row of ``queries`` (query_id, one of its own, and
        vector), by score of
        ``DIGITS`` digits, then doc_id; without the row of the same id, if ``exclude_self``. Exact: a first pass over the
        nearest cells gives a bound for each query, a second one reads what may still reach it. Queries and rows meet by
        cell and by blocks of both, so neither a cell of many rows nor one of many queries is one task's. A query
        without a direction has no neighbours, a row without one is nobody's."""
        cells, n, radii, centres = self.cells, self.n, self.radii, self.centres
        want = k + exclude_self
        id_type = queries.schema["query_id"].dataType
        if not len(cells):
            none = T.StructType([T.StructField("query_id", id_type), self.rows.schema["doc_id"], *T.DataType.fromDDL("score double, rank int").fields])
            return self.spark.createDataFrame([], none)

        def deal(first: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    good, units = _units(batch.column("vector"), centres.shape[1])
                    at = np.flatnonzero(good)
                    if not len(at):
                        continue
                    tops = _tops(units, centres, radii)
                    order = np.argsort(-tops, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    early = np.zeros(tops.shape, bool)
                    np.put_along_axis(early, order, before < want, axis=1)
                    if first:
                        q, c = np.nonzero(early)
                    else:
                        bound = np.array([-np.inf if b is None else b for b in batch.column("bound").to_pylist()])[at]
                        q, c = np.nonzero(~early & (tops >= bound[:, None] - SLACK))
                    step = max(1, (8 << 20) // (8 * centres.shape[1]))
                    for i in range(0, len(q), step):
                        rows = pa.array(at[q[i : i + step]])
                        unit = pa.array(list(units[q[i : i + step]]), pa.list_(pa.float64()))
                        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(rows), unit, pa.array(cells[c[i : i + step]])], ["query_id", "unit", "cell"])

            return run

        dealt = T.StructType([T.StructField("query_id", id_type), *T.DataType.fromDDL("unit array<double>, cell int").fields])
        given = queries.select("query_id", "vector")
        near = self._met(given.mapInArrow(deal(True), dealt), k, exclude_self)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        bound = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        far = self._met(given.join(bound, "query_id", "left").select("query_id", "vector", "bound").mapInArrow(deal(False), dealt), k, exclude_self)
        return near.unionByName(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def _met(self, pairs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """(query_id, doc_id, score): the k best of each group of rows for each query that was dealt to its cell."""
        asked = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_blocks"))
        held = self.spark.createDataFrame([(int(c), int(-(-m // ROW_BLOCK))) for c, m in zip(self.cells, self.n)], "cell int, r_blocks int")
        blocks = F.broadcast(held.join(asked, "cell"))  # a row for each cell
        seed = F.xxhash64
        left = pairs.join(blocks, "cell").withColumn("q", F.pmod(seed("query_id", "unit"), "q_blocks")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)))
        right = self.rows.select("cell", "doc_id", "vector").join(blocks, "cell").withColumn("r", F.pmod(seed("doc_id", "vector"), "r_blocks").cast("int"))
        right = right.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - F.lit(1).cast("long"))))
        dim = self.centres.shape[1]
        query_type, row_type = pairs.schema["query_id"].dataType, self.rows.schema["doc_id"].dataType
        out = T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", row_type), T.StructField("score", T.DoubleType())])

        def score(asked: pa.Table, there: pa.Table) -> pa.Table:
            # Rows in order of id, so that a stable sort by score breaks ties.
            there = there.sort_by("doc_id")
            good, units = _units(there.column("vector"), dim)
            ids = there.column("doc_id").combine_chunks().filter(pa.array(good))
            q = np.array(asked.column("unit").combine_chunks().flatten().to_pylist(), np.float64).reshape(-1, dim)
            scores = q @ units.T
            scores = np.round(scores + 1e-9 * np.sign(scores), DIGITS)
            if exclude_self:
                place = {v: i for i, v in enumerate(asked.column("query_id").to_pylist())}
                own = [(place[v], j) for j, v in enumerate(ids.to_pylist()) if v in place]
                scores[[i for i, _ in own], [j for _, j in own]] = -np.inf
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(scores, best, axis=1)
            at, kept = np.repeat(np.arange(len(q)), best.shape[1]), np.isfinite(found.ravel())
            return pa.Table.from_arrays(
                [asked.column("query_id").combine_chunks().take(pa.array(at[kept])), ids.take(pa.array(best.ravel()[kept])), pa.array(found.ravel()[kept])],
                names=["query_id", "doc_id", "score"],
            )

        keys = ["cell", "r", "q"]
        left, right = left.select(*keys, "query_id", "unit"), right.select(*keys, "doc_id", "vector")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: score(a, b) if a.num_rows and b.num_rows else _empty(out), out)


def _empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """What ``VectorIndex.join`` finds, by comparing every query with every row: for tests, and for few rows."""
    a = queries.select("query_id", F.col("vector").cast("array<double>").alias("_q"))
    b = embeddings.select("doc_id", F.col("vector").cast("array<double>").alias("_v"))
    pairs = a.join(b, F.size("_q") == F.size("_v")).withColumn("score", rounded(cosine(F.col("_q"), F.col("_v")), DIGITS)).filter("score IS NOT NULL")
    pairs = pairs.filter("query_id <> doc_id") if exclude_self else pairs
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")
