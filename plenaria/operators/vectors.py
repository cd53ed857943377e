"""Exact vector operators on (doc_id, vector, party, year, country_code) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cosine, cosine_distance, rounded

LEAST_VECTORS = 5


def centroids(embeddings: DataFrame, least: int = LEAST_VECTORS) -> DataFrame:
    """Mean vector of each (year, party) with at least ``least`` vectors; a null party is Unknown.

    One aggregation by (year, party, position), so partial sums are made before the shuffle.
    """
    rows = embeddings.withColumn("party", F.coalesce(F.col("party").cast("string"), F.lit("Unknown")))
    by_place = (
        rows.select("year", "party", F.posexplode("vector").alias("pos", "v"))
        .groupBy("year", "party", "pos")
        .agg(F.avg(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    )
    return (
        by_place.filter(F.col("n") >= least)
        .groupBy("year", "party")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("s"), F.max("n").alias("n_vectors"))
        .select("year", "party", "n_vectors", F.col("s.v").alias("centroid"))
    )


def _between(means: DataFrame, start: int | None, end: int | None) -> DataFrame:
    means = means if start is None else means.filter(F.col("year") >= start)
    return means if end is None else means.filter(F.col("year") <= end)


def drift(means: DataFrame, party_a: str, party_b: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Cosine distance of two parties' centroids in each year that both have one."""
    rows = _between(means, start, end)
    a = rows.filter(F.col("party") == party_a).select("year", F.col("party").alias("party_a"), F.col("centroid").alias("_a"))
    b = rows.filter(F.col("party") == party_b).select("year", F.col("party").alias("party_b"), F.col("centroid").alias("_b"))
    distance = rounded(cosine_distance(F.col("_a"), F.col("_b")), 6)
    return a.join(b, "year").select("year", "party_a", "party_b", distance.alias("cosine_distance")).orderBy("year")


def velocity(means: DataFrame, party: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Distance of a party's centroid from that of the last year that has one; gaps are allowed."""
    rows = _between(means, start, end)
    rows = rows if party is None else rows.filter(F.col("party") == party)
    w = Window.partitionBy("party").orderBy("year")
    return (
        rows.withColumn("_before", F.lag("centroid").over(w))
        .withColumn("year_from", F.lag("year").over(w))
        .filter("_before IS NOT NULL")
        .select(
            "year",
            "party",
            rounded(cosine_distance(F.col("_before"), F.col("centroid")), 6).alias("velocity"),
            "year_from",
            F.col("year").alias("year_to"),
        )
    )


def pairwise(means: DataFrame, year: int) -> DataFrame:
    """(party, other, distance) of all parties of a year, zero for a party with itself. There is one
    row per party, so the pairs are few; the join is on the year."""
    own = means.filter(F.col("year") == year).select("year", "party", "centroid")
    other = own.select("year", F.col("party").alias("other"), F.col("centroid").alias("_other"))
    distance = F.when(F.col("party") == F.col("other"), F.lit(0.0)).otherwise(cosine_distance(F.col("centroid"), F.col("_other")))
    return own.join(other, "year").select("party", "other", rounded(distance, 6).alias("distance"))


def distance_matrix(means: DataFrame, year: int) -> DataFrame:
    """The wide form of ``pairwise``: a row and a column per party, in order."""
    return pairwise(means, year).groupBy("party").pivot("other").agg(F.first("distance")).orderBy("party")


def search(
    embeddings: DataFrame, query: list[float], top_k: int = 10, filters: dict | None = None, vector: str = "vector"
) -> DataFrame:
    """The ``top_k`` rows most similar to ``query`` among those that equal all ``filters``; all columns
    but the vector, and ``score``. Exact, one pass: each task keeps its best k."""
    rows = embeddings
    for name, value in (filters or {}).items():
        rows = rows.filter(F.col(name) == value)
    anchor: Column = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", cosine(F.col(vector), anchor)).drop(vector).orderBy(F.desc_nulls_last("score"), "doc_id").limit(top_k)


def vectors_for_country(embeddings: DataFrame, country: str, year: int | None = None) -> DataFrame:
    rows = embeddings.filter(F.col("country_code") == country)
    return rows if year is None else rows.filter(F.col("year") == year)
