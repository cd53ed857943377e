"""Incremental job: new speeches are measured, searched for entities, topics and sentiment, and added to a table.

Documents are a stream of files: Spark's checkpoint knows which ones were taken, so a run takes only what is new, in one
batch or several, and ends. A speech is added once: of rows that repeat an id the least (by language, source and text)
within a batch, and the first batch's over batches. Documents without an id are told apart by their text.

The output is partitioned by country, year and batch. A batch that was cut off is given again by Spark under the same
number and replaces exactly its own partitions, so nothing is there twice. A batch's new rows are written once
with what was extracted from them; texts are sent over the network only to find repeated ids. Dates are those of the
order of the same number; a speech without one has no year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenaria.functions.scalar import rounded, word_count
from plenaria.operators import extraction, graph

from .base import command_line, log, observed

SPEECHES = """speech_id string, party string, language string, n_words int, ttr double, flesch_kincaid_grade double,
gunning_fog double, n_entities int, n_topics int, sentiment double, country_code string, year int, batch long"""
METRICS = ("ttr", "flesch_kincaid_grade", "gunning_fog")
INPUT = "doc_id long, text string, lang string, source string"


def _streamed(path: str) -> str:
    """``path`` as a pattern that only it fits: a stream reads a pattern's files, be it a file or a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _speeches(rows: DataFrame, dates: DataFrame, least_words: int) -> DataFrame:
    """Rows of the output, without their batch, of documents with ``speech_id``, one each."""
    given = rows.select(F.col("speech_id").alias("doc_id"), F.col("doc_id").alias("number"), "source", "lang", "text")
    given = given.withColumn("n_words", F.coalesce(word_count(F.col("text")), F.lit(0)))
    made = extraction.extract(given, least_words=least_words, keep=["number", "source", "lang", "n_words"])
    return made.join(dates, "number", "left").select(
        F.col("doc_id").alias("speech_id"), F.col("source").alias("party"), F.lower("lang").alias("language"), F.col("n_words").cast("int").alias("n_words"),
        *(F.try_element_at("complexity_metrics", F.lit(m)).alias(m) for m in METRICS),
        F.size("named_entities").alias("n_entities"), F.size("topics").alias("n_topics"), rounded(F.col("sentiment_score"), 6).alias("sentiment"),
        F.upper("lang").alias("country_code"), "year",
    )


def speech_ingest(
    spark: SparkSession, documents: str, orders: str, out: str, checkpoint: str, least_words: int = extraction.LEAST_WORDS, files_per_batch: int = 0
) -> DataFrame:
    """Add what is new in ``documents`` to ``out``; the whole output as it stands."""
    # The output exists from the first run on, so that every batch can look for what is there.
    names = spark.createDataFrame([], SPEECHES).columns
    empty = spark.createDataFrame([], SPEECHES)
    empty.write.mode("append").partitionBy("country_code", "year", "batch").parquet(out)

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        dates = session.read.parquet(orders).select(F.col("o_orderkey").alias("number"), F.year("o_orderdate").alias("year"))
        known = session.read.schema(SPEECHES).parquet(out).filter(F.col("batch") != number).select("speech_id").distinct()
        named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.sha2(F.coalesce("text", F.lit("")), 256)))
        one_each = graph.first_of(batch.withColumn("speech_id", named), ["speech_id"], ["lang", "source", "text"])
        new = _speeches(one_each.join(known, "speech_id", "left_anti"), dates, least_words)
        rows, counts = observed(new.withColumn("batch", F.lit(number).cast("long")).select(*names), words=F.sum("n_words"), entities=F.sum("n_entities"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country_code", "year", "batch").parquet(out)
        log.info("speech_ingest: batch %s of %s, %s speeches of %s words added to %s", number, documents, *(counts.get.get(k) or 0 for k in ("rows", "words")), out)

    reader = spark.readStream.schema(INPUT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(_streamed(documents)).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SPEECHES).parquet(out)


if __name__ == "__main__":
    command_line(speech_ingest, "speech_ingest.toml")
