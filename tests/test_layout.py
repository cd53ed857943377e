"""The neighbour graph against exact neighbours, and its layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenaria.operators import evaluation, layout, vector_index

SCHEMA = "doc_id long, vector array<float>, party string"


@pytest.fixture(scope="module")
def clouds(spark):
    """Three clouds of uneven size, one third of all in copies of one vector; vectors without a direction among them."""
    rng = np.random.default_rng(11)
    centres = np.eye(12)[:3] * 4
    rows = [(i, (centres[i % 3] + rng.normal(size=12)).tolist(), f"P{i % 3}") for i in range(600)]
    rows += [(1000 + i, (centres[0] + 0.5).tolist(), "P0") for i in range(300)]
    rows += [(2000, None, "none"), (2001, [0.0] * 12, "none")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def graph(clouds):
    return layout.neighbour_graph(clouds, 10)


def test_recall_of_the_graph(spark, clouds, graph):
    usable = clouds.filter("doc_id < 2000")
    apart = usable.filter("doc_id < 1000")
    exact = vector_index.nearest(usable, apart.select(F.col("doc_id").alias("query_id"), "vector"), 10)
    found = graph.filter("u < 1000")
    # Copies are ties: what counts is whether a neighbour is as near as the tenth.
    least = exact.groupBy(F.col("query_id").alias("u")).agg(F.min("score").alias("least"))
    good = found.join(least, "u").filter(1 - F.col("d") >= F.col("least") - 2e-6).count()
    assert good / exact.count() >= 0.9
    assert graph.groupBy("u").count().filter("count <> 10").count() == 0 and graph.filter("u = v").count() == 0
    assert graph.select("u").distinct().count() == 900
    assert graph.groupBy("u", "v").count().filter("count > 1").count() == 0


def test_layout_separates_clouds_and_is_the_same_again(clouds, graph):
    points = layout.spectral_layout(graph, steps=24)
    got = {r.doc_id: (r.x, r.y) for r in points.collect()}
    assert len(got) == 900 and max(abs(c) for p in got.values() for c in p) <= 10
    assert got == {r.doc_id: (r.x, r.y) for r in layout.spectral_layout(graph, steps=24).collect()}
    groups = [np.array([got[i] for i in got if i < 1000 and i % 3 == g]) for g in range(3)]
    middles = [np.median(g, axis=0) for g in groups]
    own = sum((np.linalg.norm(g[:, None] - np.array(middles)[None], axis=2).argmin(1) == k).sum() for k, g in enumerate(groups))
    assert own >= 0.95 * 600


def test_same_graph_for_other_partitions(spark, clouds):
    few = clouds.filter("doc_id < 90")
    edges = [sorted(map(tuple, layout.neighbour_graph(df, 4).collect())) for df in (few.coalesce(1), few.repartition(3, "party"))]
    assert edges[0] == edges[1]


def test_few_and_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert layout.neighbour_graph(none, 3).count() == 0 and layout.spectral_layout(layout.neighbour_graph(none, 3)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.5, 0.5], "b")], SCHEMA)
    edges = layout.neighbour_graph(two, 3)
    assert sorted((r.u, r.v) for r in edges.collect()) == [(1, 2), (2, 1)]
    assert layout.spectral_layout(edges, steps=6).count() == 2


def test_graph_of_vectors_none_near_another(spark):
    """Descent by neighbours of neighbours found about half of the nearest ones of such vectors."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(3000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), "P") for i, v in enumerate(m)], SCHEMA)
    edges = layout.neighbour_graph(rows, 15, block=700)
    got = {u: set(v) for u, v in edges.groupBy("u").agg(F.collect_list("v")).collect()}
    units = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.argsort(np.where(np.eye(3000, dtype=bool), -2, units @ units.T), axis=1)[:, -15:]
    assert sum(len(got[i] & set(near[i].tolist())) for i in range(3000)) >= 0.999 * 45000


def test_graph_of_rows_that_share_an_id(spark):
    rows = [(i % 20, [1.0, i / 10.0], "P") for i in range(40)]
    edges = layout.neighbour_graph(spark.createDataFrame(rows, SCHEMA), 6).collect()
    assert len(edges) == 120 == len({(r.u, r.v) for r in edges}) and all(r.u != r.v for r in edges)


def test_clustering_reports_from_a_bounded_number_of_partitions(spark, clouds):
    """Each step of k-means sends something to the driver from each partition, so their number must not grow with the table."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        points = evaluation.evaluate(clouds.filter("doc_id < 60"), plot=True)["points"]
        assert points.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
