"""Batch job: a yearly report of each party's tone and of where it stands among the others.

Reads speeches (an order is a speech of its customer, whose segment is the party) and their vectors; writes a row for each
year and party: speeches, mean and deviation of their sentiment and its change since the party's last year, vectors,
how far their mean has moved since the last year that has one, and the party that is nearest in the year. The output
is partitioned by year. A run replaces the years that it reports and no others, so it can be run again, or for
some years only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenaria.functions.scalar import cosine_distance, rounded, stdev0
from plenaria.operators import vectors

from .base import command_line, log, observed

REPORT = """party string, n_speeches long, avg_sentiment double, std_sentiment double, sentiment_change double, n_vectors long,
velocity double, year_from int, nearest_party string, nearest_distance double, year int"""


def _speeches(orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    people = customers.join(F.broadcast(nations.select("n_nationkey")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are few
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("doc_id"),
        F.year("o_orderdate").alias("year"),
        F.col("c_mktsegment").alias("party"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 250000.0 - 1.0).alias("sentiment"),
    )


def _within(start_year: int, end_year: int) -> Column:
    after = F.lit(True) if not start_year else F.col("year") >= start_year
    return after if not end_year else after & (F.col("year") <= end_year)


def party_report(
    spark: SparkSession, orders: str, customers: str, nations: str, embeddings: str, out: str, start_year: int = 0, end_year: int = 0
) -> DataFrame:
    """Write the report for the years asked for to ``out``; the whole report as it stands."""
    speeches = _speeches(
        spark.read.parquet(orders).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"),
        spark.read.parquet(customers).select("c_custkey", "c_nationkey", "c_mktsegment"),
        spark.read.parquet(nations),
    )
    if end_year:
        speeches = speeches.filter(F.col("year") <= end_year)
    before = Window.partitionBy("party").orderBy("year")
    mean = rounded(F.avg("sentiment"), 4)
    tone = speeches.groupBy("year", "party").agg(
        F.count(F.lit(1)).alias("n_speeches"), mean.alias("avg_sentiment"), rounded(stdev0(F.col("sentiment")), 4).alias("std_sentiment")
    )
    tone = tone.withColumn("sentiment_change", rounded(F.col("avg_sentiment") - F.lag("avg_sentiment").over(before), 4))
    stored = spark.read.parquet(embeddings).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    means = vectors.centroids(stored.join(speeches.select("doc_id", "year", "party"), "doc_id"))
    moved = vectors.velocity(means).select("year", "party", "velocity", "year_from")
    # One row for each party and year, so the pairs of a year are few.
    other = means.select("year", F.col("party").alias("other"), F.col("centroid").alias("_other"))
    distance = rounded(cosine_distance(F.col("centroid"), F.col("_other")), 6)
    near = means.join(other, "year").filter("party <> other").select("year", "party", F.struct(distance.alias("d"), "other").alias("n"))
    near = near.groupBy("year", "party").agg(F.min("n").alias("n")).select("year", "party", F.col("n.other").alias("nearest_party"), F.col("n.d").alias("nearest_distance"))
    cell = ["year", "party"]
    report = tone.join(means.select(*cell, "n_vectors"), cell, "left").join(moved, cell, "left").join(near, cell, "left").filter(_within(start_year, end_year))
    report = report.withColumn("n_vectors", F.coalesce("n_vectors", F.lit(0)))
    names = [p.split()[0] for p in REPORT.split(",")]
    rows, counts = observed(report.select(*names), speeches=F.sum("n_speeches"), vectors=F.sum("n_vectors"))
    # A year is one small file: its rows are the parties.
    rows.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(out)
    log.info("party_report: %s speeches and %s vectors read, %s rows written to %s", *(counts.get.get(k) or 0 for k in ("speeches", "vectors", "rows")), out)
    return spark.read.schema(REPORT).parquet(out)


if __name__ == "__main__":
    command_line(party_report, "party_report.toml")
