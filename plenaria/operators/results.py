"""Extraction results by content: each text is asked about once, whoever brings it and however often.

A result belongs to the digest of a text and to what made it: the names of the backends, a version, and the options that
change what they find. Results are a Parquet table partitioned by that; a run extracts from the texts that have no
result there, appends what it found in one write, and joins every document with its text's result. So a run that is
repeated, or comes upon copies, asks no backend again, and all tables that are made of results are made of the same.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from . import extraction

RESULTS = T.StructType([T.StructField("text_hash", T.StringType()), *(f for f in schemas.EXTRACTION.fields if f.name != "doc_id"), T.StructField("made_by", T.StringType())])


def made_by(entity_backend=None, reply_backend=None, version: str = "1", **options) -> str:
    """What results of these backends and options are kept under. A backend that finds something else than it did needs
    another name or version."""
    names = [getattr(b, "extractor_name", getattr(b, "__name__", type(b).__name__)) for b in (entity_backend or extraction.RuleEntities, reply_backend or extraction.LexiconReplies)]
    said = "-".join(f"{k}={v}" for k, v in sorted(options.items()) if v is not None)
    return "-".join([*names, version, hashlib.sha256(said.encode()).hexdigest()[:12]])


def stored(spark: SparkSession, path: str, label: str) -> DataFrame:
    """The results under ``label``, one for each text; none where there is no table yet."""
    spark.createDataFrame([], RESULTS).write.mode("append").partitionBy("made_by").parquet(path)  # the folder, if it is new
    found = spark.read.schema(RESULTS).parquet(path).filter(F.col("made_by") == label)
    return found.drop("made_by").dropDuplicates(["text_hash"])  # two runs at once may have asked about the same text


def missing(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(text_hash, text) of the different texts that ``known`` lacks. Copies are reduced where they are; then both sides
    meet by digest."""
    one_each = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    return one_each.join(known.select("text_hash"), "text_hash", "left_anti")


def extract_once(documents: DataFrame, path: str, entity_backend=None, reply_backend=None, version: str = "1", **options) -> DataFrame:
    """Extraction results of ``documents`` (doc_id, text), a row each, from the table at ``path``, to which those of
    texts that it lacks are added first. options: those of ``extraction.extract``."""
    spark = documents.sparkSession
    label = made_by(entity_backend, reply_backend, version, **options)
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    new = missing(texts, stored(spark, path, label)).withColumnRenamed("text_hash", "doc_id")
    found = extraction.extract(new, entity_backend, reply_backend, **options).withColumnRenamed("doc_id", "text_hash")
    found.withColumn("made_by", F.lit(label)).select(*RESULTS.names).write.mode("append").partitionBy("made_by").parquet(path)
    return texts.drop("text").join(stored(spark, path, label), "text_hash").select(*schemas.EXTRACTION.names)
