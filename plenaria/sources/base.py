"""What a source of raw documents offers, and helpers that sources share."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import scratch


class Source(Protocol):
    source_name: str

    def load(self, spark: SparkSession, path: str) -> DataFrame: ...

    def schema(self) -> T.StructType: ...


def existing(spark: SparkSession, path: str) -> str:
    """``path`` if it exists for Spark, local or remote; else FileNotFoundError, at once."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    return path


def numbered_rows(df: DataFrame, order: list[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``, a number from 0 for each row of every group ``by`` in ``order``.

    Rows are dealt by ranges of group and order and written, so that the ranges hold still; only counts by
    range and group are added up in one place, so a group of any size is numbered by many tasks.
    """
    keys = [*by, *order]
    ranged = scratch(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    starts = counts.select(F.col("_range").alias("_in"), *(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), start)
    same = [F.col("_range") == F.col("_in"), *(F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by))]
    local = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    return ranged.join(starts, same).withColumn("_local", local).select(*df.columns, (F.col("_start") + F.col("_local") - 1).alias(name))


def numbered_batches(df: DataFrame, size: int, order: list[str], by: list[str]) -> DataFrame:
    """``df`` with ``batch``, a number from 0 for each ``size`` rows of every group ``by`` in order."""
    numbered = numbered_rows(df, order, "_number", by)
    return numbered.withColumn("batch", F.floor(F.col("_number") / size).cast("long")).drop("_number")
