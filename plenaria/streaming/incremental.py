"""Incremental runs: drain what is new in a folder, batch by batch, and stop."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import work_dir

log = logging.getLogger(__name__)


@dataclass
class Report:
    """What a drain did: batches and rows taken, and the errors of batches that failed."""

    batches: int = 0
    rows: int = 0
    errors: list[str] = field(default_factory=list)
    seconds: float = 0.0

    @property
    def rate(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0


def drain(
    spark: SparkSession, path: str, schema: T.StructType, process: Callable[[DataFrame, int], None], checkpoint: str,
    max_batches: int = -1, files_per_batch: int | None = None, pattern: str = "*.parquet",
) -> Report:
    """Pass the files below ``path`` that no earlier run with this ``checkpoint`` has taken to ``process``,
    until none is left or ``max_batches`` are done (-1: no limit).

    What a batch does must be idempotent: a batch that was cut off is given again. A batch that fails
    is logged, counted and put aside beside the checkpoint; later ones go on, and the next run gives it
    again before all else. An interrupt stops the query and reports what was done.
    """
    report, began = Report(), time.time()
    aside = f"{checkpoint.rstrip('/')}-failed"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(aside)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        if 0 <= max_batches <= report.batches:
            break
        batch, name = spark.read.schema(schema).parquet(status.getPath().toString()), status.getPath().getName()
        try:
            process(batch, int(name))
            report.rows += batch.count()
            fs.delete(status.getPath(), True)
        except Exception as e:  # it stays aside
            log.warning("batch %s failed again: %s", name, e)
            report.errors.append(f"{name}: {e}")
        report.batches += 1

    def work(batch: DataFrame, number: int) -> None:
        if 0 <= max_batches <= report.batches:
            raise _Enough
        n = batch.count()
        if not n:
            return
        try:
            process(batch, number)
            report.rows += n
        except Exception as e:  # the next batch may be sound
            log.warning("batch %s failed: %s", number, e)
            report.errors.append(f"{number}: {e}")
            batch.write.mode("overwrite").parquet(f"{aside}/{number}")
        report.batches += 1

    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(path).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
    except Exception:
        if not 0 <= max_batches <= report.batches:
            raise
    report.seconds = time.time() - began
    return report


class _Enough(Exception):
    """Ends a query after the batches asked for; the batch at hand is given again next time."""


def append_new(out: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch's work: append to the Parquet folder ``out`` the rows whose key it lacks, one of each."""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            rows = rows.join(spark.read.schema(batch.schema).parquet(out).select(*keys), keys, "left_anti")
        rows.write.mode("append").parquet(out)

    return work


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Count and sum by type in tumbling windows of event time; for streams, with a watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def drained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table taken in by a drain, then counted by type."""
    base = work_dir(spark, "drain")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    drain(spark, sf_dir, schema, append_new(f"{base}/out", ["event_id"]), f"{base}/checkpoint", pattern="events.parquet")
    return spark.read.schema(schema).parquet(f"{base}/out").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )
