"""Evaluation of embedding models: clustering, agreement with labels, separation, and a tournament."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from html import escape

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..sources.base import numbered_rows

log = logging.getLogger(__name__)
SEED = 42
#: Partitions of the vectors that are clustered.
PARTITIONS_PER_CORE = 2


def seeded_sample(df: DataFrame, n: int, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows without replacement, the same ones on every run: those of least digest."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def adjusted_rand_index(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row, ``ari`` (4 digits): agreement of two labelings from their contingency table; 1.0 if
    chance leaves no room."""
    pairs = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))

    def choose2(c):
        return c * (c - 1) / 2.0

    cells = pairs.agg(F.sum(choose2(F.col("n"))).alias("cells"), F.sum("n").alias("total"))
    rows = pairs.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("a"))
    columns = pairs.groupBy(predicted).agg(F.sum("n").alias("n")).agg(F.sum(choose2(F.col("n"))).alias("b"))
    expected = F.try_divide(F.col("a") * F.col("b"), choose2(F.col("total")))
    room = (F.col("a") + F.col("b")) / 2.0 - expected
    value = F.when(F.coalesce(room, F.lit(0.0)) == 0, F.lit(1.0)).otherwise((F.col("cells") - expected) / room)
    return cells.crossJoin(rows).crossJoin(columns).select(rounded(value, 4).alias("ari"))  # one row each


def encode_labels(df: DataFrame, label: str = "party") -> DataFrame:
    """``label_id``: the number of the label among all in order; a null one is Unknown. Labels are
    numbered once each, by ranges of their order, then joined."""
    named = df.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit("Unknown")))
    numbered = numbered_rows(named.select(label).distinct(), [label], "label_id")
    return named.join(numbered.withColumn("label_id", F.col("label_id").cast("int")), label)


def evaluate(embeddings: DataFrame, model_name: str = "", sample: int | None = None, plot: bool | str = False) -> dict:
    """Cluster all vectors, or a sample of so many, into as many groups as they have parties; ``ari`` against the parties,
    ``silhouette`` (cosine) of the clusters, counts and, with ``plot``, ``points`` (doc_id, party,
    cluster, x, y): by principal components, or with ``plot="graph"`` by the layout of the neighbour graph, which leaves
    vectors without a direction out. No vectors: ValueError."""
    rows = encode_labels(embeddings if sample is None else seeded_sample(embeddings, sample)).withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    # k-means reports to the driver from each partition in each step: no more of them than keep the cores occupied
    rows = rows.coalesce(PARTITIONS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism).cache()
    try:
        n = rows.count()
        if not n:
            raise ValueError("no vectors to evaluate")
        parties = rows.select("label_id").distinct().count()
        clustered = KMeans(k=max(2, parties), seed=SEED, maxIter=300).fit(rows).transform(rows)
        ari = adjusted_rand_index(clustered, "label_id", "prediction").first()["ari"]
        silhouette = None
        if clustered.select("prediction").distinct().count() > 1:
            silhouette = round(ClusteringEvaluator(metricName="silhouette", distanceMeasure="cosine").evaluate(clustered), 4)
        found = {"model_name": model_name, "ari": ari, "silhouette": silhouette, "n_samples": n, "n_parties": parties}
        if plot == "graph":
            from . import layout

            at = layout.spectral_layout(layout.neighbour_graph(clustered))
            found["points"] = clustered.select("doc_id", "party", F.col("prediction").alias("cluster")).join(at, "doc_id")
        elif plot:
            reduced = PCA(k=2, inputCol="features", outputCol="_xy").fit(clustered).transform(clustered)
            xy = vector_to_array("_xy")
            found["points"] = reduced.select("doc_id", "party", F.col("prediction").alias("cluster"), xy[0].alias("x"), xy[1].alias("y"))
        return found
    finally:
        rows.unpersist()


#: Colours of the parties in a plot, in order of their names; from the first again where they are more.
COLOURS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")


def write_plot(points: DataFrame, path: str, title: str = "", most: int = 20_000) -> None:
    """Write ``points`` as a page with a scatter plot, to be opened in a browser: coloured by party, each point showing its
    id, party and cluster. A page of more than ``most`` points is of no use: of more, so many are drawn, chosen by digest."""
    if points.count() > most:
        points = seeded_sample(points, most)
    spark = points.sparkSession
    span = points.agg(*(f(c).alias(f.__name__ + c) for c in ("x", "y") for f in (F.min, F.max))).first()
    at = {c: (F.col(c) - (span["min" + c] or 0.0)) * (960 / ((span["max" + c] or 0.0) - (span["min" + c] or 0.0) or 1.0)) + 20 for c in ("x", "y")}
    named = encode_labels(points.select("doc_id", "party", "cluster", "x", "y"))
    colour = F.element_at(F.array(*map(F.lit, COLOURS)), (F.col("label_id") % len(COLOURS) + 1).cast("int"))
    safe = [F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")) for c in ("doc_id", "party", "cluster")]
    mark = '<circle cx="%.1f" cy="%.1f" r="4" fill="%s" fill-opacity="0.6"><title>%s, %s, cluster %s</title></circle>'
    marks = named.select(F.format_string(mark, at["x"], 1000 - at["y"], colour, *safe).alias("value"))
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><svg viewBox="0 0 1000 1000" width="1000" height="1000">'
    page = spark.createDataFrame([(head,)], "value string").unionByName(marks).unionByName(spark.createDataFrame([("</svg></body></html>",)], "value string"))
    page.coalesce(1).write.mode("overwrite").text(path)  # parts in their order, at most ``most`` rows


def tournament(candidates: Mapping[str, DataFrame], sample: int | None = None) -> tuple[str, list[dict]]:
    """(best model, all results): each candidate by its own vectors. The highest ARI wins, the first of
    equals; a candidate that fails is left out; none left: RuntimeError."""
    results = []
    for name, vectors in candidates.items():
        try:
            results.append(evaluate(vectors, name, sample))
        except Exception as e:
            log.warning("candidate %s failed: %s", name, e)
    if not results:
        raise RuntimeError("no candidate could be evaluated")
    return max(results, key=lambda r: r["ari"])["model_name"], results
