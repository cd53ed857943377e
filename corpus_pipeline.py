"""Corpus pipeline: quality classifier, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again
as the next one's ``docs``. All but the last return the columns of ``docs``. Decisions are addressed to
rows by what they hold, not by doc_id, so rows without an id, and different texts of one id, are each
judged by their own text, whatever else is in the table. Only repeated passages need an order of
documents: rows without an id are left whole there, and rows of one id take nothing from each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.llm import classifier, decontam, pack, simhash, suffix
from plenaria.llm.common import scratch, small_join, table


def _free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to those at hand, doesn't reject."""
    name = _free_name(docs, "_quality_score")
    scored = classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")), name)
    return scored.filter(F.col(name) >= classifier.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of least doc_id (rows without one come last), then
    of least md5 of its text, then of least JSON of all its columns, if rows repeat both."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    found = simhash.near_duplicates(docs, _digest=digest).select("component", "doc_id", "_digest")
    rows = found.groupBy("component", "doc_id", "_digest").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_digest", "n")).alias("s"))
    # a row's place is a number of 64 bits made of both; that two share it is left to chance, and would keep a copy
    name, repeats = _free_name(docs, "_place"), _free_name(docs, "_repeats")
    places = scratch(first.select(F.xxhash64(F.col("s.doc_id"), F.col("s._digest")).alias(name), F.col("s.n").alias(repeats)), "places")
    marked = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), digest))
    once = places.filter(F.col(repeats) == 1).select(name)
    kept = small_join(marked, once, name, "left_semi", F.lit(32)).select(*docs.columns)
    several = places.filter(F.col(repeats) > 1).select(name).distinct()
    if several.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    again = small_join(marked, several, name, "left_semi", F.lit(32))
    return kept.unionByName(again.groupBy(name).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that a document of smaller id says as well."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", F.struct(F.lit(True).alias("_held"), *rest).alias("_rest"))
    kept = suffix.remove_repeats(held, ["_rest"], ("kept",))
    columns = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return kept.select(*(columns.get(c, F.col("_rest")[c]).alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no passage of the benchmark."""
    digest, name = F.md5("text"), _free_name(docs, "_digest")
    leaked = decontam.leaks(docs, table(spark, sf_dir, "benchmark"), key=digest).select(F.col("doc_id").alias(name))
    leaked = scratch(leaked.distinct(), "leaked")
    return small_join(docs.withColumn(name, digest), leaked, name, "left_anti", F.lit(64)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return pack.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]

#: Training and tokenizing have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next one reads it."""
    docs = table(spark, sf_dir, "documents", even=True)
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
