"""Newline-delimited JSON posts as raw documents, native throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .base import existing


def documents(posts: DataFrame, handles: DataFrame, country: str) -> DataFrame:
    """``posts`` (parsed lines) of the authors in ``handles`` (author_id, speaker_id, name, party, role);
    posts of others are left out. The join is left to Spark, which broadcasts ``handles`` if small."""
    tokens = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    metrics = F.transform_values(F.coalesce("public_metrics", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))), lambda k, v: v.cast("string"))
    base = F.create_map(F.lit("platform"), F.lit("twitter"), F.lit("tweet_id"), F.col("id"))
    return posts.join(handles, "author_id").select(
        F.concat(F.lit("tw_"), "id").alias("doc_id"),
        F.lit("twitter").alias("source"),
        F.lit(country.upper()).alias("country_code"),
        F.coalesce("lang", F.lit("unk")).alias("language"),
        "text",
        "speaker_id",
        F.col("name").alias("speaker_name"),
        "party",
        "role",
        F.to_date(F.try_to_timestamp("created_at")).alias("date"),
        F.lit("twitter").alias("session_id"),
        F.lit(None).cast("string").alias("subcorpus"),
        F.map_concat(base, F.map_filter(metrics, lambda k, v: ~k.isin("platform", "tweet_id"))).alias("metadata"),
        tokens.alias("token_count"),
    )


class PostSource:
    """All ``*.ndjson`` below a folder. Lines that are no JSON object, or have no id, are left out."""

    source_name = "twitter"

    def __init__(self, country: str, handles: DataFrame):
        self.country, self.handles = country.upper(), handles

    def schema(self) -> T.StructType:
        return schemas.RAW_DOCUMENT

    def lines(self, spark: SparkSession, path: str) -> DataFrame:
        return (
            spark.read.schema(schemas.POST_LINES)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.ndjson")
            .option("mode", "DROPMALFORMED")
            .json(existing(spark, path))
            .filter("id IS NOT NULL")
        )

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        return documents(self.lines(spark, path), self.handles, self.country)
