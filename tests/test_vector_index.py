"""The inverted file against full scans: ties, copies, vectors without a direction, filters, and what is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenaria.operators import vector_index, vectors

SCHEMA = "doc_id long, vector array<float>, party string, year int"


def made(spark, n=600, dim=8, groups=12, seed=3, wide=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        v = centres[i % groups] + wide * rng.normal(size=dim)
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.1, 9)], f"P{i % 3}", 2000 + i % 4))
    return rows


ODD = [(9000, None, "P0", 2000), (9001, [0.0] * 8, "P0", 2000), (9002, [1.0, 2.0], "P0", 2000), (9003, [], "P0", 2001), (9004, [1.0] * 7 + [None], "P0", 2000)]


@pytest.fixture(scope="module")
def rows():
    return made(None) + ODD + [(8000 + i, [1.0] * 8, "copy", 2000) for i in range(80)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    return vector_index.build(table, str(tmp_path_factory.mktemp("index") / "i"), cells=14)


def same(a, b):
    return [(r.doc_id, None if r.score is None else round(r.score, 9)) for r in a.collect()] == [(r.doc_id, None if r.score is None else round(r.score, 9)) for r in b.collect()]


@pytest.mark.parametrize("k, filters", [(1, None), (10, None), (7, {"party": "P1"}), (5, {"party": "P2", "year": 2003}), (90, {"party": "copy"}), (10_000, None), (3, {"party": "none"})])
def test_search_equals_the_scan(table, index, rows, k, filters):
    usable = table.filter("size(vector) = 8 AND NOT exists(vector, x -> x IS NULL)") if k == 10_000 else table
    for query in (rows[0][1], [1.0] * 8, [-x for x in rows[17][1]]):
        found, report = index.search(query, k, filters)
        if k == 10_000:
            found = found.filter("size(array(doc_id)) = 1 AND doc_id NOT IN (9000, 9002, 9003, 9004)")
        assert same(found, vectors.search(usable, query, k, filters))
        assert report.rows == len(rows) and 0 < report.rows_read <= report.rows


def test_most_rows_are_not_read(index, rows):
    _, report = index.search(rows[5][1], 10)
    assert report.cells_read < report.cells / 2 and report.share < 0.4
    found, _ = index.search(rows[5][1], 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    again = vector_index.VectorIndex.open(index.spark, index.path)
    assert again.columns == index.columns and same(again.search(rows[5][1], 10)[0], found)


def test_queries_without_a_direction_read_all(table, index):
    for query in ([0.0] * 8,):
        found, report = index.search(query, 3)
        assert report.share == 1 and found.count() == 3


@pytest.mark.parametrize("exclude", [True, False])
def test_join_equals_all_pairs(spark, table, index, monkeypatch, exclude):
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 16)  # the copies and the hot cells are split
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 5)
    asked = table.filter("doc_id % 7 = 0 OR doc_id >= 8000").select(F.col("doc_id").alias("query_id"), "vector")
    got = sorted(map(tuple, index.join(asked, 6, exclude).collect()))
    clean = table.filter("size(vector) = 8 AND NOT exists(vector, x -> x IS NULL)")
    want = sorted(map(tuple, vector_index.nearest(clean, asked.filter("size(vector) = 8 AND NOT exists(vector, x -> x IS NULL)"), 6, exclude).collect()))
    assert got == want and len({r[0] for r in got}) == asked.count() - 5


def test_more_neighbours_than_rows_and_no_rows(spark, tmp_path):
    few = spark.createDataFrame(made(None, 5, 4, 2), SCHEMA)
    index = vector_index.build(few, str(tmp_path / "few"))
    asked = few.select(F.col("doc_id").alias("query_id"), "vector")
    assert index.join(asked, 10).count() == 20
    none = vector_index.build(few.limit(0), str(tmp_path / "none"))
    assert none.join(asked, 3).count() == 0 and none.search([1.0, 2.0], 3)[0].count() == 0
    odd = vector_index.build(spark.createDataFrame(ODD[:2], SCHEMA), str(tmp_path / "odd"))
    assert odd.search([1.0] * 8, 5)[0].count() == 2 and odd.join(asked, 3).count() == 0


def test_sample_is_dealt_out_and_grows_with_the_cells(spark, tmp_path, monkeypatch):
    seen = []

    class Spy(vector_index.KMeans):
        def fit(self, dataset, params=None):
            seen.append((dataset.count(), dataset.rdd.getNumPartitions()))
            return super().fit(dataset, params)

    monkeypatch.setattr(vector_index, "KMeans", Spy)
    rows = spark.range(1000).selectExpr("id AS doc_id", "array(cos(id), sin(id)) AS vector")
    index = vector_index.build(rows, str(tmp_path), cells=3)
    assert seen == [(3 * vector_index.SAMPLE_PER_CELL, spark.sparkContext.defaultParallelism)] and index.size == 1000
